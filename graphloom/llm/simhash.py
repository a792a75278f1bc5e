"""Operator 1: SimHash near-duplicates by pivot distance tables.

Every fingerprint carries its Hamming distances to PIVOTS reference fingerprints
(rows of a Walsh code, so that their coordinates are independent). By the
triangle inequality two fingerprints within a radius differ by at most that
radius in every coordinate, so a pair whose largest coordinate difference is
greater is discarded, and only survivors are compared bit by bit.

Pairs come from buckets, never from a cross join: with radius r a fingerprint is
cut into r + 2 blocks, and any two within r agree on at least two of them, so the
keys are all choices of two blocks. Buckets of more than BUCKET fingerprints are
not paired: for them every fingerprint names its midpoints (itself, and with one
bit flipped; radius 2), and those that share one are within the radius. A
midpoint has at most 65 neighbours, so no group grows with the data. The two
ways together lose no link.

Equal fingerprints are one node, whatever the number of documents. Components
come from alternating star contraction on the executors.

Defined results: a null or empty text, or one without a word, has fingerprint 0
and is linked like any other. Rows of a null doc_id keep their row; their
component is the smallest id that the others give, null if none. Repeated rows
give repeated rows.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import Scratch, by_bytes, connected_components, table, texts

SEED = 42
PIVOTS = 16
RADIUS = 2
#: Fingerprints in a bucket up to which its pairs are formed.
BUCKET = 64


def shingle_hashes(raw: bytes, size: int) -> np.ndarray:
    """XXH64 of every run of `size` words of the lower-cased (A-Z) text, repeats included."""
    words = raw.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) <= size:
        runs = [b" ".join(words)]
    else:
        runs = map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False))
    digest = xxhash.xxh64_intdigest
    return np.array([digest(x, SEED) for x in runs], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """Bits that are set in over half the hashes."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = hashes[i : i + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits((2 * ones > len(hashes)).astype(np.uint8), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, size: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp bigint): the 64 bits as a signed number."""

    def run(batches):
        for b in by_bytes(batches, 1):
            fp = np.array([fingerprint(shingle_hashes(t, size)) for t in texts(b.column(1))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp, pa.int64())], names=["doc_id", "fp"])

    return docs.selectExpr(f"cast(`{id_col}` as bigint) doc_id", f"cast(`{text_col}` as string) text").mapInArrow(run, "doc_id bigint, fp bigint")


def pivots(n: int = PIVOTS) -> list[int]:
    """Rows 1..n of the 64-bit Walsh code: bit j is the parity of i AND j."""
    rows = [sum((((i & j).bit_count() & 1) << j) for j in range(64)) for i in range(1, n + 1)]
    return [x - (1 << 64) if x >> 63 else x for x in rows]


def pivot_table(fp: Column, n: int = PIVOTS) -> Column:
    """array<tinyint>: distances to the pivots."""
    return F.array(*[F.bit_count(fp.bitwiseXOR(F.lit(p))).cast("tinyint") for p in pivots(n)])


def _near(a: str, b: str, radius: int, n: int = PIVOTS) -> Column:
    """Largest coordinate difference first, then the distance itself."""
    out = F.lit(True)
    for i in range(n):
        out = out & (F.abs(F.get(f"{a}.pivots", F.lit(i)) - F.get(f"{b}.pivots", F.lit(i))) <= radius)
    return out & (F.bit_count(F.col(f"{a}.fp").bitwiseXOR(F.col(f"{b}.fp"))) <= radius)


def block_keys(fp: Column, radius: int) -> Column:
    """array<struct<t, k>>: for each choice of two of radius + 2 blocks, the bits in them."""
    n = radius + 2
    edges = [64 * i // n for i in range(n + 1)]
    masks = [((1 << edges[i + 1]) - 1) ^ ((1 << edges[i]) - 1) for i in range(n)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    return F.array(*[F.struct(F.lit(t).cast("tinyint").alias("t"), fp.bitwiseAND(F.lit(signed(masks[i] | masks[j]))).alias("k")) for t, (i, j) in enumerate(combinations(range(n), 2))])


def links(fps: DataFrame, s: Scratch, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """Distinct fingerprints (fp) -> edges (u, v) that connect the same fingerprints as all links do."""
    if radius != 2:
        raise ValueError("the exact way for large buckets is that of radius 2")
    keyed = fps.select("fp", F.explode(block_keys(F.col("fp"), radius)).alias("b"))
    sizes = keyed.groupBy("b").count().where("count > 1")
    some = s.keep(keyed.join(sizes, "b"))
    small = some.where(F.col("count") <= bucket).select("b", F.struct("fp", pivot_table(F.col("fp")).alias("pivots")).alias("x"))
    pairs = small.alias("p").join(small.alias("q"), F.col("p.b") == F.col("q.b")).where("p.x.fp < q.x.fp")
    pairs = pairs.select(F.col("p.x").alias("p"), F.col("q.x").alias("q")).where(_near("p", "q", radius)).select(F.col("p.fp").alias("u"), F.col("q.fp").alias("v"))
    crowded = some.where(F.col("count") > bucket).select("fp").distinct()
    flips = [0] + [1 << i if i < 63 else -(1 << 63) for i in range(64)]
    around = crowded.select("fp", F.explode(F.transform(F.array(*map(F.lit, flips)), lambda m: F.col("fp").bitwiseXOR(m))).alias("mid"))
    met = around.groupBy("mid").agg(F.collect_set("fp").alias("s")).where("size(s) > 1")  # a midpoint has 65 neighbours at most
    stars = met.select(F.array_min("s").alias("u"), F.explode("s").alias("v")).where("u <> v")
    return pairs.unionByName(stars)


def components(prints: DataFrame, s: Scratch, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp) -> and component_id, the smallest doc_id reachable. prints is read twice: a table."""
    nodes = s.keep(prints.groupBy("fp").agg(F.min("doc_id").alias("low")))
    roots = connected_components(links(nodes.select("fp"), s, radius), s).withColumnRenamed("node", "fp")
    rooted = s.keep(nodes.join(roots, "fp", "left").select("fp", "low", F.coalesce("root", "fp").alias("root")))
    lowest = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    names = s.result(rooted.join(lowest, "root").select("fp", "component_id"))
    return prints.join(names, "fp", "left")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    with Scratch(spark) as s:
        prints = s.result(fingerprints(table(spark, sf_dir, "documents")))
        out = components(prints, s)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
