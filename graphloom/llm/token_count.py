"""Operator 6: token counts of documents from flat, unindexed token files.

A token file is nothing but identifiers of fixed width, each document ended by
the end-of-document identifier. Its bytes are cut into blocks without regard to
documents. Every block is searched for the identifier by one vectorised compare;
of a block only the separators' places leave the worker. Documents that cross
blocks are stitched by a prefix scan over the blocks of a file: a document's end
less the end of the one before it, whichever block that is in.

Defined results: null and empty texts are documents of no tokens. Tokens after a
file's last separator are an unfinished document and counted as such
(finished = false). Ids may repeat: rows are told apart by file and place.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._spark import Scratch, by_bytes, small_batches, table

#: Bytes of one block.
BLOCK = 1 << 17
EOD = 50256
WIDTH = np.dtype("<u2")


@lru_cache(maxsize=1)
def encoding(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def separators(block: np.ndarray, eod: int = EOD) -> np.ndarray:
    """Places of the separator in a block of identifiers."""
    return np.flatnonzero(block == eod)


def write_flat(docs: DataFrame, tokenizer: str, eod: int = EOD) -> DataFrame:
    """docs (doc_id, text) -> the blocks of one token file per partition, and a manifest:
    (file_id, kind 0, block_no, payload) and (file_id, kind 1, place, doc_id)."""
    small_batches(docs.sparkSession)
    schema = "file_id int, kind int, at bigint, doc_id bigint, payload binary"

    def run(batches):
        enc, rest, block, place = encoding(tokenizer), bytearray(), 0, 0
        sep = np.array([eod], WIDTH).tobytes()

        def out(kind, at, ids, payloads):
            return pa.RecordBatch.from_arrays([pa.array([file_id] * len(at), pa.int32()), pa.array([kind] * len(at), pa.int32()), pa.array(at, pa.int64()), pa.array(ids, pa.int64()), pa.array(payloads, pa.binary())], names=["file_id", "kind", "at", "doc_id", "payload"])

        file_id = 0
        for b in by_bytes(batches, 2):
            file_id = b.column(0)[0].as_py()
            ids = b.column(1).to_pylist()
            yield out(1, list(range(place, place + len(ids))), ids, [None] * len(ids))
            place += len(ids)
            for text in b.column(2).to_pylist():
                if text:
                    rest += np.array(enc.encode_ordinary(text), WIDTH).tobytes()
                rest += sep
                if len(rest) >= BLOCK:
                    n = len(rest) // BLOCK
                    cut = [bytes(rest[i * BLOCK : (i + 1) * BLOCK]) for i in range(n)]
                    del rest[: n * BLOCK]
                    yield out(0, list(range(block, block + n)), [None] * n, cut)
                    block += n
        if rest:
            yield out(0, [block], [None], [bytes(rest)])

    return docs.selectExpr("spark_partition_id() file_id", "cast(doc_id as bigint) doc_id", "cast(text as string) text").mapInArrow(run, schema)


def read_flat(spark: SparkSession, path: str, block: int = BLOCK) -> DataFrame:
    """Token files on disk as blocks: (file_id string, at, payload). A file is read whole
    by one task, so files should be shards of at most a few hundred MB."""

    def run(batches):
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for i in range(0, max(1, len(content)), block):
                    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([i // block], pa.int64()), pa.array([content[i : i + block]], pa.binary())], names=["file_id", "at", "payload"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "file_id string, at bigint, payload binary")


def scan_blocks(blocks: DataFrame, eod: int = EOD, keep: str = "") -> DataFrame:
    """Blocks -> (file_id, at, n, ends array<int>): tokens and separators' places; rows of no payload pass with n null."""
    kind = dict(blocks.dtypes)
    cols = ["file_id", "at"] + ([keep] if keep else [])
    schema = ", ".join(f"{c} {kind[c]}" for c in cols) + ", n bigint, ends array<int>"

    def run(batches):
        for b in by_bytes(batches, len(cols)):
            n, ends = [], []
            for p in b.column(len(cols)).to_pylist():
                if p is None:
                    n.append(None)
                    ends.append(None)
                    continue
                if len(p) % WIDTH.itemsize:
                    raise ValueError("a block of a broken identifier")
                tokens = np.frombuffer(p, WIDTH)
                n.append(len(tokens))
                ends.append(separators(tokens, eod).astype(np.int32))
            yield pa.RecordBatch.from_arrays([*b.columns[: len(cols)], pa.array(n, pa.int64()), pa.array(ends, pa.list_(pa.int32()))], names=[*cols, "n", "ends"])

    return blocks.select(*cols, "payload").mapInArrow(run, schema)


def stitch(scanned: DataFrame) -> DataFrame:
    """Scanned blocks -> one row per document: (file_id, place, n_tokens, finished).

    The scan goes over blocks, not tokens: a row of a few numbers per block. Each
    block learns the tokens and separators before it and where the last document
    before it ended."""
    before = Window.partitionBy("file_id").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    head = scanned.withColumns({"size__": F.col("n"), "docs__": F.size("ends").cast("bigint")}).withColumns({"first__": F.coalesce(F.sum("size__").over(before), F.lit(0)), "place__": F.coalesce(F.sum("docs__").over(before), F.lit(0))})
    # absolute end (one past the separator) of the block's last document; null if it ends none
    head = head.withColumn("last__", F.when(F.col("docs__") > 0, F.col("first__") + F.element_at("ends", -1) + 1)).withColumn("begin__", F.coalesce(F.max("last__").over(before), F.lit(0)))
    lengths = F.transform("ends", lambda e, k: F.when(k == 0, F.col("first__") + e - F.col("begin__")).otherwise(e - F.get("ends", k - 1) - 1))
    whole = head.where("docs__ > 0").select("file_id", "place__", F.posexplode(lengths).alias("k", "n_tokens"))
    whole = whole.select("file_id", (F.col("place__") + F.col("k")).alias("place"), "n_tokens", F.lit(True).alias("finished"))
    tail = head.groupBy("file_id").agg(F.sum("size__").alias("size"), F.sum("docs__").alias("place"), F.coalesce(F.max("last__"), F.lit(0)).alias("last")).where("size > last").select("file_id", "place", (F.col("size") - F.col("last")).alias("n_tokens"), F.lit(False).alias("finished"))
    return whole.unionByName(tail)


def count_tokens(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, n_tokens): the documents as token files, the files scanned, the ids joined by place. The files are
    rows of bytes here (write_flat), cut without regard to documents; read_flat gives the same rows of files on disk."""
    flat = write_flat(docs, tokenizer)
    # one pass: the blocks go from the tokenizer to the scan, manifest rows beside them
    with Scratch(docs.sparkSession) as s:
        scanned = s.result(scan_blocks(flat.withColumn("tag", F.struct("kind", "doc_id")), keep="tag"))
    counts = stitch(scanned.where("tag.kind = 0").select("file_id", "at", "n", "ends"))
    names = scanned.where("tag.kind = 1").select("file_id", F.col("at").alias("place"), F.col("tag.doc_id").alias("doc_id"))
    return names.join(counts, ["file_id", "place"]).select("doc_id", "n_tokens")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), default_tokenizer())
