"""Registered queries of the corpus operators and their SQL."""

from __future__ import annotations

from .alignment import op13_alignment
from .decontaminate import op5_decontaminate
from .hard_negatives import OP11_SQL, op11_hard_negatives
from .packing import op12_packing
from .quality import op2_quality_rules
from .secrets import op7_secret_scan
from .sentencepiece_codec import op3_sentencepiece
from .simhash import op1_simhash
from .suffix_dedup import op4_suffix_dedup
from .token_count import op6_token_counts
from .toxicity import op8_toxicity
from .url_filter import OP9_SQL, op9_url_filter
from .warc import OP10_SQL, op10_warc


def _pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_simhash, op2_quality_rules, op3_sentencepiece, op4_suffix_dedup, op5_decontaminate, op6_token_counts, op7_secret_scan, op8_toxicity, op9_url_filter, op10_warc, op11_hard_negatives, op12_packing, op13_alignment)} | {"pipeline": _pipeline}
ORACLE_SQL = {"op9_url_filter": OP9_SQL, "op10_warc": OP10_SQL, "op11_hard_negatives": OP11_SQL}
