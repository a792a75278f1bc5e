"""Operator 11: hard negatives by a vector-approximation file.

Every vector's components are whole numbers, and fall into CELLS cells by dimension.
The approximation file holds a vector's cells, two dimensions a byte. For an anchor,
two tables give the least and the most that any pair of cells can add to an inner
product; summed over the bytes they bound the score of a vector without a look at
its components. Only vectors whose bounds may put them into a result are scored: the
first POSITIVES of the anchor's label, then for each positive the first NEGATIVES of
other labels in its window of scores.

Anchors are sent to the workers in slices of at most some ANCHORS; a slice is a pass over
the file for its positives, and one for the windows. A task keeps each anchor's
best rows so far, which raise the bound for the rows that follow, and hands on those
alone; Spark merges the tasks' rows. So an anchor meets all rows in blocks, no pairs
are formed by a join, and neither a label nor a common vector is a group in one task.

Cells end at the quantiles of a sample of SAMPLE vectors (by a hash of the row); all
vectors are in the file, and a cell's bounds are the extremes of all rows, so
the sample has no part in the result.

Defined results: rows without vec_id take no part; components beyond +-2^26 (after
the factor 256) count as that; vectors of unequal length as if zeros followed; an
empty vector scores 0. Rows that share a vec_id are rows of their own, but not each
other's positives; equal anchors give equal rows. An empty table gives none.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._spark import Scratch, shared_dir, table

#: Cells of a dimension: two fit a byte.
CELLS = 16
SAMPLE = 16_384
ANCHORS = 20_000
#: Vectors that a task compares at a time.
ROWS = 8192
FACTOR, MOST = 256, 1 << 26
POSITIVES, NEGATIVES = 5, 10
#: Window of a positive's score, in percent.
LOW, HIGH = 30, 90


def clean(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, q): rows that take part, every seventh id under the next label, components as whole numbers."""
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform("embedding", lambda x: F.greatest(F.lit(-float(MOST)), F.least(F.lit(float(MOST)), F.floor(x.cast("double") * FACTOR).cast("double"))).cast("int"))
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("bigint").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()).where(sound)
    return rows.select("vec_id", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"), whole.alias("q"))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Lists of whole numbers as rows of dims numbers, zeros behind short ones."""
    sizes = np.diff(column.offsets.to_numpy())
    out = np.zeros((len(column), dims), np.int32)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(column)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def cell_of(q: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Cell of each component; ends: the upper ends of all cells but the last, by dimension."""
    return np.stack([np.searchsorted(ends[d], q[:, d], "left") for d in range(q.shape[1])], axis=1).astype(np.uint8)


class File:
    """The approximation file of a table: rows (vec_id, label, q binary, cells binary), and the cells' extremes."""

    def __init__(self, vectors: DataFrame, s: Scratch):
        rows = clean(vectors)
        longest = rows.agg(F.max(F.size("q"))).first()[0]
        self.empty = longest is None
        if self.empty:
            return
        dims = self.dims = max(2, longest + longest % 2)
        sample = rows.orderBy(F.xxhash64("vec_id", "label", "q")).select("q").limit(SAMPLE).toArrow()
        known = _matrix(sample["q"].combine_chunks(), dims)
        ends = np.quantile(known, np.arange(1, CELLS) / CELLS, axis=0, method="inverted_cdf").T.copy()

        def approximate(batches):
            for b in batches:
                q = _matrix(b.column(2), dims)
                cells = cell_of(q, ends)
                packed = cells[:, 0::2] * CELLS + cells[:, 1::2]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), _binary(q.astype("<i4")), _binary(packed)], names=["vec_id", "label", "q", "cells"])

        self.rows = s.keep(rows.mapInArrow(approximate, "vec_id bigint, label bigint, q binary, cells binary"))

        def extremes(batches):
            low, high = np.full((dims, CELLS), np.iinfo(np.int32).max, np.int64), np.full((dims, CELLS), np.iinfo(np.int32).min, np.int64)
            for b in batches:
                q = _numbers(b.column(0), dims, "<i4")
                cells = cell_of(q, ends)
                for d in range(dims):
                    np.minimum.at(low[d], cells[:, d], q[:, d])
                    np.maximum.at(high[d], cells[:, d], q[:, d])
            d, c = np.nonzero(low <= high)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (d, c, low[d, c], high[d, c])], names=["d", "c", "low", "high"])

        got = self.rows.select("q").mapInArrow(extremes, "d bigint, c bigint, low bigint, high bigint").groupBy("d", "c").agg(F.min("low").alias("low"), F.max("high").alias("high")).toArrow()  # at most dims * CELLS rows
        self.low, self.high = np.zeros((dims, CELLS), np.int64), np.zeros((dims, CELLS), np.int64)
        d, c = got["d"].to_numpy(), got["c"].to_numpy()
        self.low[d, c], self.high[d, c] = got["low"].to_numpy(), got["high"].to_numpy()


def _binary(rows: np.ndarray) -> pa.Array:
    wide = rows.shape[1] * rows.itemsize
    return pa.array([r.tobytes() for r in rows], pa.binary()) if wide else pa.array([b""] * len(rows), pa.binary())


def _numbers(column: pa.Array, wide: int, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), wide)


class Bounds:
    """What a byte of two cells can add to an anchor's inner product, at least and at most."""

    def __init__(self, low: np.ndarray, high: np.ndarray):
        self.low, self.high = low, high

    def tables(self, anchor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        a = anchor.astype(np.int64)[:, None]
        ends = a * self.low, a * self.high
        return tuple((f(*ends)[0::2, :, None] + f(*ends)[1::2, None, :]).reshape(len(anchor) // 2, CELLS * CELLS) for f in (np.minimum, np.maximum))

    @staticmethod
    def sums(cells: np.ndarray, tables: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(least, most) score of rows; cells: a line of bytes for every two dimensions."""
        return tuple(sum(t[k].take(cells[k]) for k in range(len(cells))) for t in tables)


def _scores(q: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """Exact inner products: in floating point where no sum can leave 53 bits."""
    a = anchor.astype(np.int64)
    if int(np.abs(a).max(initial=0)) * int(np.abs(q).max(initial=0)) * len(a) < 1 << 53:
        return np.rint(q.astype(np.float64) @ a.astype(np.float64)).astype(np.int64)
    return q.astype(np.int64) @ a


class Best:
    """The first k of (score, vec_id): higher scores, then smaller ids."""

    def __init__(self, k: int):
        self.k, self.score, self.id = k, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def least(self) -> int | None:
        """The last score, once there are k."""
        return int(self.score[-1]) if len(self.score) == self.k else None

    def add(self, score: np.ndarray, ids: np.ndarray) -> None:
        score, ids = np.concatenate([self.score, score]), np.concatenate([self.id, ids])
        order = np.lexsort((ids, -score))[: self.k]
        self.score, self.id = score[order], ids[order]


def _floor_of(lower: np.ndarray, k: int, known: int | None) -> int | None:
    """A score that at least k rows reach, if it can be told: by the rows so far, or by these rows' lower bounds."""
    if len(lower) >= k:
        here = int(np.partition(lower, len(lower) - k)[len(lower) - k])
        return here if known is None else max(here, known)
    return known


def first_positives(best: Best, ids: np.ndarray, q: np.ndarray, cells: np.ndarray, anchor: np.ndarray, bounds: Bounds) -> int:
    """Rows of the anchor's label, other than its own id, into its best; how many were scored."""
    low, high = bounds.sums(cells, bounds.tables(anchor))
    least = _floor_of(low, best.k, best.least())
    at = np.flatnonzero(high >= least) if least is not None else np.arange(len(ids))
    best.add(_scores(q[at], anchor), ids[at])
    return len(at)


def window(score: int) -> tuple[int, int]:
    """Scores s with LOW * score <= 100 s <= HIGH * score; empty for a negative score."""
    return -(-LOW * score // 100), HIGH * score // 100


def first_negatives(best: list[Best], positives: list[int], ids: np.ndarray, q: np.ndarray, cells: np.ndarray, anchor: np.ndarray, bounds: Bounds) -> int:
    """Rows of other labels into the best of each positive's window; how many were scored."""
    low, high = bounds.sums(cells, bounds.tables(anchor))
    wanted, windows = np.zeros(len(ids), bool), [window(p) for p in positives]
    for own, (lo, hi) in zip(best, windows, strict=True):
        if lo <= hi:
            least = _floor_of(low[(low >= lo) & (high <= hi)], own.k, own.least())
            wanted |= (high >= (lo if least is None else max(lo, least))) & (low <= hi)
    at = np.flatnonzero(wanted)
    score, own_ids = _scores(q[at], anchor), ids[at]
    for own, (lo, hi) in zip(best, windows, strict=True):
        inside = (score >= lo) & (score <= hi)
        own.add(score[inside], own_ids[inside])
    return len(at)


def _blocks(batches, dims: int):
    """(ids, labels, q, cells by pair of dimensions) of ROWS rows or fewer, sorted by label."""
    held, n = [], 0

    def flush():
        ids, labels = (np.concatenate([b.column(i).to_numpy() for b in held]) for i in range(2))
        q, cells = (np.concatenate([_numbers(b.column(i), wide, kind) for b in held]) for i, wide, kind in ((2, dims, "<i4"), (3, dims // 2, "u1")))
        order = np.argsort(labels, kind="stable")
        return ids[order], labels[order], q[order], np.ascontiguousarray(cells[order].T)

    for batch in batches:
        for at in range(0, len(batch), ROWS):
            b = batch.slice(at, ROWS)
            if n + len(b) > ROWS and held:
                yield flush()
                held, n = [], 0
            held.append(b)
            n += len(b)
    if held:
        yield flush()


def _positives(sent, dims: int):
    def run(batches):
        ids, labels, vectors, bounds = sent.value
        best = [Best(POSITIVES) for _ in ids]
        for rows, own, q, cells in _blocks(batches, dims):
            for i, (a, label) in enumerate(zip(ids.tolist(), labels.tolist(), strict=True)):
                lo, hi = np.searchsorted(own, [label, label + 1])
                # rows of the anchor's own id are not its positives
                if lo < hi:
                    others = np.flatnonzero(rows[lo:hi] != a) + lo
                    first_positives(best[i], rows[others], q[others], cells[:, others], vectors[i], bounds)
        yield _rows(((i, 0, b) for i, b in enumerate(best)))

    return run


def _negatives(sent, dims: int):
    def run(batches):
        ids, labels, vectors, bounds, scores = sent.value
        best = [[Best(NEGATIVES) for _ in p] for p in scores]
        for rows, own, q, cells in _blocks(batches, dims):
            for i, label in enumerate(labels.tolist()):
                lo, hi = np.searchsorted(own, [label, label + 1])
                for part in (slice(0, lo), slice(hi, len(rows))):
                    if best[i] and part.start < part.stop:
                        first_negatives(best[i], scores[i], rows[part], q[part], cells[:, part], vectors[i], bounds)
        yield _rows(((i, k, b) for i, own in enumerate(best) for k, b in enumerate(own)))

    return run


def _rows(best) -> pa.RecordBatch:
    """(anchor, place, score, vec_id) of what a task has found."""
    held = [(i, k, b) for i, k, b in best if len(b.id)]
    size = [len(b.id) for _, _, b in held]
    columns = [np.repeat(np.array([x[j] for x in held], np.int64), size) for j in range(2)]
    columns += [np.concatenate([getattr(b, c) for _, _, b in held]) if held else np.zeros(0, np.int64) for c in ("score", "id")]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["anchor", "place", "score", "vec_id"])


FOUND = "anchor bigint, place bigint, score bigint, vec_id bigint"
RESULT = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"


def _first(found: DataFrame, k: int) -> DataFrame:
    """The tasks' rows merged: the first k by anchor and place, with their rank from 1."""
    order = Window.partitionBy("anchor", "place").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def mine(vectors: DataFrame, every: int = 100) -> DataFrame:
    """Hard negatives (columns of RESULT) for anchors: the rows whose vec_id is divisible by `every`."""
    spark = vectors.sparkSession
    with Scratch(spark) as s:
        file = File(vectors, s)
        if file.empty:
            return spark.createDataFrame([], RESULT)
        # equal anchors are one, and as many rows in the end
        anchors = s.keep(file.rows.where(F.col("vec_id") % every == 0).groupBy("vec_id", "label", "q").agg(F.count("*").alias("copies")))
        slices = max(1, math.ceil(anchors.count() / ANCHORS))
        path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
        spark.createDataFrame([], RESULT).write.parquet(path)
        for k in range(slices):
            own = anchors.where(F.pmod(F.xxhash64("vec_id", "label", "q"), F.lit(slices)) == k).toArrow()
            if not own.num_rows:
                continue
            ids, labels, copies = (own[c].to_numpy() for c in ("vec_id", "label", "copies"))
            base = ids, labels, _numbers(own["q"].combine_chunks(), file.dims, "<i4"), Bounds(file.low, file.high)
            sent = spark.sparkContext.broadcast(base)
            found = _first(file.rows.mapInArrow(_positives(sent, file.dims), FOUND), POSITIVES).orderBy("anchor", "rank").toArrow()
            scores: list[list[int]] = [[] for _ in range(len(ids))]
            named: list[list[int]] = [[] for _ in range(len(ids))]
            for i, score, vec_id in zip(*(found[c].to_pylist() for c in ("anchor", "score", "vec_id")), strict=True):
                scores[i].append(score)
                named[i].append(vec_id)
            full = spark.sparkContext.broadcast((*base, scores))
            got = _first(file.rows.mapInArrow(_negatives(full, file.dims), FOUND), NEGATIVES)
            pairs = [(i, p, int(ids[i]), v, x, int(copies[i])) for i in range(len(ids)) for p, (v, x) in enumerate(zip(named[i], scores[i], strict=True))]
            told = spark.createDataFrame(pa.table({c: pa.array([r[j] for r in pairs], pa.int64()) for j, c in enumerate(("anchor", "place", "anchor_id", "positive_id", "positive_score", "copies"))}))
            rows = got.join(told, ["anchor", "place"]).withColumn("copy", F.explode(F.expr("sequence(1, copies)")))
            rows.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")).write.mode("append").parquet(path)
            sent.destroy()
            full.destroy()
        return spark.read.schema(RESULT).parquet(path)


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine(table(spark, sf_dir, "embeddings"))


OP11_SQL = """
with v as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, [floor(256 * x::double) for x in embedding] as q
  from embeddings
  where vec_id is not null and label is not null and embedding is not null and len([x for x in embedding if x is null or not isfinite(x)]) = 0
), s as (
  select a.vec_id as anchor_id, b.vec_id, a.label = b.label as same, list_dot_product(a.q, b.q)::bigint as score
  from v a join v b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id
), p as (
  select anchor_id, vec_id as positive_id, score as positive_score from s where same
  qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5
)
select p.anchor_id, p.positive_id, (row_number() over w)::int as rank, s.vec_id as negative_id, p.positive_score, s.score as negative_score
from p join s on s.anchor_id = p.anchor_id and not s.same and 100 * s.score between 30 * p.positive_score and 90 * p.positive_score
window w as (partition by p.anchor_id, p.positive_id order by s.score desc, s.vec_id)
qualify rank <= 10
"""
