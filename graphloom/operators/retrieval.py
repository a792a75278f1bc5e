"""Containment, evidence assembly, query strategies."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import scan
from .index import SENT_DOCS, dealt, terms

#: Tokens of a passage by which containment is looked up.
RARE = 3


def containing(corpus: DataFrame, queries: DataFrame, postings: DataFrame | None = None, keep: Callable[[DataFrame], DataFrame] = lambda df: df, searched: scan.Scan | None = None) -> DataFrame:
    """(qid, doc_id) of documents whose contents hold the query text literally. postings: (token, doc_id, ...) of the corpus, if there are;
    else the texts are read as they are (scan.holding). searched: a scan of them that is used often, whose counts serve here too.

    A document that holds a text holds all its inner tokens (those at its ends may be parts of words there). So a text
    is looked up by its RARE inner tokens of fewest documents, all of which a candidate must have, and the candidates are
    verified. Texts of fewer than three tokens have no inner token; they are few and short, and meet all documents.
    keep makes tables of the few words and pairs that are looked up, so Spark knows their sizes and leaves postings and texts
    where they are."""
    if postings is None:
        return scan.holding(corpus, queries, keep, searched.frequencies(keep) if searched and searched.often else None)
    own = queries.where("query <> ''").select("qid", "query", terms(F.col("query")).alias("w")).withColumn("inner", F.array_distinct(F.slice("w", 2, F.greatest(F.size("w") - 2, F.lit(0)))))
    asked = own.select("qid", F.explode("inner").alias("token"))
    words = postings.select("doc_id", "token").join(asked.select("token").distinct(), "token", "left_semi")
    df = words.groupBy("token").agg(F.count("*").alias("df"))
    rank = F.row_number().over(Window.partitionBy("qid").orderBy("df", "token"))
    rare = keep(asked.join(df, "token").withColumn("r", rank).where(F.col("r") <= RARE).select("qid", "token"))
    need = own.select("qid", F.least(F.size("inner"), F.lit(RARE)).alias("need")).where("need > 0")
    # a token that no document has leaves its text without enough matches
    met = keep(words.join(rare, "token").groupBy("qid", "doc_id").agg(F.count("*").alias("n")).join(need, "qid").where("n >= need").select("qid", "doc_id"))
    # met first meets the texts, beside which it is small: nothing is known of its size once it has met the queries
    found = met.join(corpus.select("doc_id", "contents"), "doc_id").join(own.select("qid", "query"), "qid").where(F.contains("contents", F.col("query"))).select("qid", "doc_id")
    short = own.where("size(inner) = 0").select("qid", "query")
    return found.unionByName(short.join(corpus.select("doc_id", "contents"), F.contains("contents", F.col("query"))).select("qid", "doc_id"))


def among(corpus: DataFrame, found: DataFrame) -> DataFrame:
    """The documents that a table (doc_id, ...) names. The others' texts stay where they are however many ids there are: these are sent to
    all tasks, some SENT_DOCS at a time."""
    ids = found.select("doc_id").distinct()
    n = max(1, math.ceil(found.count() / SENT_DOCS))
    out = None
    for k in range(n):
        own = corpus.join(F.broadcast(ids.where(dealt(k, n)) if n > 1 else ids), "doc_id", "left_semi")
        out = own if out is None else out.unionByName(own)
    return out


def beside(corpus: DataFrame, found: DataFrame) -> DataFrame:
    """Rows of a table (doc_id, ...) with the contents of their documents. These stay where they are; the rows are sent to all tasks, some
    SENT_DOCS at a time."""
    n = max(1, math.ceil(found.count() / SENT_DOCS))
    out = None
    for k in range(n):
        own = corpus.select("doc_id", "contents").join(F.broadcast(found.where(dealt(k, n)) if n > 1 else found), "doc_id")
        out = own if out is None else out.unionByName(own)
    return out


def held_by(corpus: DataFrame, hits: DataFrame, queries: DataFrame) -> DataFrame:
    """(qid, doc_id) of hits whose document holds the query text literally. hits: (qid, doc_id, ...). No other documents are looked at."""
    asked = hits.select("qid", "doc_id").distinct().join(queries.where("query <> ''").select("qid", "query").distinct(), "qid")
    return beside(corpus, asked).where(F.contains("contents", F.col("query"))).select("qid", "doc_id").distinct()


def gold_flag(hits: DataFrame, gold: DataFrame) -> DataFrame:
    """is_gold 0 or 1; gold: (qid, doc_id)."""
    return hits.join(gold.select("qid", "doc_id", F.lit(1).alias("g__")).distinct(), ["qid", "doc_id"], "left").select(*hits.columns, F.coalesce("g__", F.lit(0)).alias("is_gold"))


def passages(corpus: DataFrame, max_words: int = 500) -> DataFrame:
    """Title, text and evidence line of each document, in Unicode NFC and without white space at the ends;
    texts of more than max_words words are cut. evidence is null where there is no text (R4: such hits are skipped)."""
    nfc = T.nfc()
    read = corpus.withColumns({"title": T.strip(nfc(T.passage_title(F.col("contents")))), "text": T.strip(nfc(T.cap_words(T.passage_text(F.col("contents")), max_words)))})
    return read.withColumn("evidence", F.when(F.col("text") != "", T.evidence(F.col("title"), F.col("text"))))


def gold_zip(samples: DataFrame, ids: str = "gold_id_list", texts: str = "gold_evidence_list") -> DataFrame:
    """(index, ord, title, evidence, n_gold): ids and texts side by side, as far as the shorter list goes; n_gold
    counts all ids, for they all count against the cap (Q24)."""
    nfc = T.nfc()
    n = F.least(F.size(ids), F.size(texts))
    pairs = samples.select("index", F.size(ids).alias("n_gold"), F.posexplode(F.arrays_zip(F.slice(ids, 1, n).alias("i"), F.slice(texts, 1, n).alias("t"))).alias("ord", "x"))
    read = pairs.select("index", "ord", T.strip(nfc(F.col("x.i"))).alias("title"), T.strip(nfc(F.col("x.t"))).alias("text"), "n_gold")
    return read.select("index", "ord", "title", T.evidence(F.col("title"), F.col("text")).alias("evidence"), "n_gold")


def titles(hits: DataFrame, key: str = "qid") -> DataFrame:
    """(key, titles): distinct titles of evidence lines, sorted (Q19); lines without one don't count."""
    own = hits.where(F.startswith("evidence", F.lit("(Title: "))).select(key, T.title_of(F.col("evidence")).alias("t"))
    return own.groupBy(key).agg(F.array_sort(F.collect_set("t")).alias("titles"))


def assemble(gold: DataFrame, hits: DataFrame, setting: str = "open-book", top_k: int = 5, total: bool = False) -> DataFrame:
    """(qid, pos, doc_id, is_gold, evidence). gold and hits: (qid, ord, doc_id, evidence), ord from 0.

    Gold passages come first and count against top_k; hits that repeat a passage are
    dropped, first occurrence kept; total mode lifts the cap.
    """
    if setting not in ("gold", "open-book", "open-book+gold"):
        raise ValueError(setting)
    gold_ids = gold.select("qid", "doc_id", F.lit(1).alias("g__")).distinct()
    parts = []
    if "gold" in setting:
        parts.append(gold.select("qid", F.lit(0).alias("src"), "ord", "doc_id", "evidence"))
    if "open-book" in setting:
        parts.append(hits.select("qid", F.lit(1).alias("src"), "ord", "doc_id", "evidence"))
    rows = (parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])).where("src = 0 or evidence is not null")
    by_text = Window.partitionBy("qid", "evidence").orderBy("src", "ord")
    # gold passages all stay, hits only if new
    fresh = rows.withColumn("r", F.row_number().over(by_text)).where("src = 0 or r = 1")
    own = Window.partitionBy("qid")
    placed = fresh.withColumns({"n_gold": F.sum((F.col("src") == 0).cast("int")).over(own), "k": F.row_number().over(Window.partitionBy("qid", "src").orderBy("ord"))})
    if not total:
        placed = placed.where((F.col("src") == 0) | (F.col("k") <= F.greatest(F.lit(0), F.lit(top_k) - F.col("n_gold"))))
    placed = placed.join(gold_ids, ["qid", "doc_id"], "left")
    pos = F.row_number().over(own.orderBy("src", "ord")) - 1
    return placed.select("qid", pos.alias("pos"), "doc_id", F.coalesce("g__", F.lit(0)).alias("is_gold"), "evidence")


def evidence_text(assembled: DataFrame, limit: int = 40_000) -> DataFrame:
    """(qid, text): evidence in order, cut to `limit` characters."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", "evidence"))), lambda x: x["evidence"])
    return assembled.groupBy("qid").agg(F.substring(F.array_join(ordered, "\n"), 1, limit).alias("text"))


def numbered(assembled: DataFrame) -> DataFrame:
    """The block that the search agent reads."""
    ordered = F.array_sort(F.collect_list(F.struct("pos", "evidence")))
    line = lambda x, i: F.concat(F.lit("Doc "), (i + 1).cast("string"), x["evidence"])
    return assembled.groupBy("qid").agg(F.array_join(F.transform(ordered, line), "\n").alias("block"))


#: names of the strategies, and what stands before triples and before a hop's text in a query (fixed values)
STRATEGIES = ("question", "cot_reasoning", "triplets", "combined", "multihop_triplets", "question_triplets")
TRIPLETS, QUESTION_TRIPLETS, SEARCHING = "\n\nTriplets:\n", "\n\nQuestion Triplets:\n", "\n\nSearching for: "


def strategy_queries(samples: DataFrame, strategy: str, agent: bool = False, nudge: bool = False) -> DataFrame:
    """(index, hop, triple, query, thinking) for a sample's question, cot_reasoning, cot_def_triples,
    cot_triples, question_def_triples, question_triples. Where there are no triples the question is asked alone, but
    the multihop strategy asks nothing (Q17). thinking counts only for a nudged agent (Q14)."""
    if strategy not in STRATEGIES:
        raise ValueError(strategy)
    q, no = F.col("question"), F.lit(None).cast("string")
    both = lambda kind: F.concat(*[F.coalesce(F.col(f"{kind}_{c}"), F.array().cast("array<string>")) for c in ("def_triples", "triples")])
    told = F.when(T.strip(F.coalesce("cot_reasoning", F.lit(""))) != "", F.col("cot_reasoning"))
    thinking = (told if strategy in ("cot_reasoning", "combined", "multihop_triplets") and agent and nudge else no).alias("thinking")
    if strategy == "multihop_triplets":
        hops = samples.select("*", F.posexplode(both("cot")).alias("hop", "triple"))
        return hops.select("index", "hop", "triple", F.concat(q, F.lit(SEARCHING), T.triple_query(F.col("triple"))).alias("query"), thinking)
    query = q
    if strategy in ("triplets", "combined", "question_triplets"):
        kind, head = ("question", QUESTION_TRIPLETS) if strategy == "question_triplets" else ("cot", TRIPLETS)
        query = F.when(F.size(both(kind)) > 0, F.concat(q, F.lit(head), F.array_join(both(kind), "\n"))).otherwise(q)
    return samples.select("index", F.lit(0).alias("hop"), no.alias("triple"), query.alias("query"), thinking)


def multihop_union(hits: DataFrame) -> DataFrame:
    """(index, hop, rank, doc_id, ...) -> each document once, at its first hop and rank."""
    first = hits.groupBy("index", "doc_id").agg(F.min(F.struct("hop", "rank")).alias("f"))
    pos = F.row_number().over(Window.partitionBy("index").orderBy("f.hop", "f.rank", "doc_id")) - 1
    return first.select("index", pos.alias("pos"), "doc_id", F.col("f.hop").alias("hop"))


def turn_results(turns: DataFrame, total: bool = False) -> DataFrame:
    """Documents of the last turn, or of all turns, each once in order. turns: (qid, turn, rank, doc_id)."""
    if not total:
        turns = turns.join(turns.groupBy("qid").agg(F.max("turn").alias("turn")), ["qid", "turn"], "left_semi")
    first = turns.groupBy("qid", "doc_id").agg(F.min(F.struct("turn", "rank")).alias("f"))
    return first.select("qid", (F.row_number().over(Window.partitionBy("qid").orderBy("f.turn", "f.rank", "doc_id")) - 1).alias("pos"), "doc_id")
