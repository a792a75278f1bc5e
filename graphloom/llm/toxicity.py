"""Operator 8: toxic passages as maximum-scoring segments of token log-odds.

Training: words of labelled rows (a bounded sample: at most SAMPLE rows of each
label, in the order of a hash of their id) are counted by label, once a row, so
that one long text doesn't make its words look typical. A word's weight is its
log-odds ratio under an informative Dirichlet prior, centred on the sample's word
frequencies; words whose z-score is under MIN_Z share one negative
weight. Scoring: one linear scan per text finds all maximal segments of positive
total (Ruzzo and Tompa). A segment's score S turns to an E-value K n exp(-lambda S),
with Karlin and Altschul's lambda for clean text and the K that makes the best
segments of the clean sample's texts that have any most likely (their E-values are
then 1 on average). The bits by which segments are under SIGNIFICANT are summed, and a
two-parameter logistic calibration turns the evidence to a score from 0 to 1. It is fitted on the sample, each
row weighted by how many labelled rows of its class it stands for, so the classes have
their true shares whatever the sample's size.

Defined results: null and empty texts hold no segment and get the score of no
evidence. Without labels of both kinds every score is 0. Repeated labels of a
document count as toxic if any is; null labels are left out.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import by_bytes, small_batches, table

#: Labelled rows of each class that the model is fitted on, at most.
SAMPLE = 8000
MIN_Z = 3.0
PRIOR = 500.0
WORD = re.compile(r"[^\W_]+")
#: E-value over which a segment isn't significant.
SIGNIFICANT = 0.05


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[DataFrame, dict[int, float]]:
    """(text, y) of the sample, and by class how many labelled rows a row stands for; held-out rows (crc32 of the id mod
    5 = 0) never enter."""
    y = labels.where("doc_id is not null and toxic is not null and pmod(crc32(cast(doc_id as string)), 5) <> 0").groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("y"))
    pick = lambda k: y.where(F.col("y") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    few = pick(1).unionByName(pick(0))  # at most 2 * sample rows: small enough to broadcast
    rows = docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text").join(F.broadcast(few), "doc_id").select("text", "y")
    shares = {r["y"]: r["count"] / min(r["count"], sample) for r in y.groupBy("y").count().collect()}  # two rows
    return rows, shares


class Model:
    """Word weights, the weight of all other words, lambda, K and the calibration."""

    def __init__(self, weights: dict[str, float], other: float, lam: float, k: float, a: float = 1.0, b: float = 0.0):
        self.weights, self.other, self.lam, self.k, self.a, self.b = weights, other, lam, k, a, b

    def segments(self, text: str) -> list[tuple[float, int, int]]:
        """All maximal scoring segments (score, first word, end word), in time linear in the words.

        Runs of words of the shared negative weight are one step each."""
        get, other = self.weights.get, self.other
        stack: list[tuple[float, float, int, int, int]] = []  # left sum, right sum, first, end, nearest below of a smaller left sum
        total, at = 0.0, 0
        for i, w in [(i, w) for i, w in enumerate(map(get, WORD.findall(text.lower()))) if w is not None]:
            total += other * (i - at)
            left, total, at = total, total + w, i + 1
            if w <= 0:
                continue
            first, j = i, len(stack) - 1
            while True:
                while j >= 0 and stack[j][0] >= left:  # what lies between an entry and its link has no smaller left sum
                    j = stack[j][4]
                if j < 0 or stack[j][1] >= total:
                    break
                left, _, first, _, below = stack[j]
                del stack[j:]
                j = below
            stack.append((left, total, first, i + 1, j))
        return [(r - x, i, j) for x, r, i, j, _ in stack]

    def evidence(self, text: str | None) -> float:
        if not text:
            return 0.0
        found = self.segments(text)
        if not found:
            return 0.0
        # the bits of each segment's E-value, over its text's words, under the significant one
        n = math.log(self.k * self.size(text) / SIGNIFICANT)
        return sum(max(0.0, self.lam * s - n) for s, _, _ in found) / math.log(2)

    @staticmethod
    def size(text: str) -> float:
        """Words of a text, roughly, by its length."""
        return len(text) / 6 + 1

    def tail(self, text: str | None) -> float | None:
        """n exp(-lambda M) of a text's best segment: by extreme-value theory 1 / K on average over clean texts. None without a segment."""
        best = max((s for s, _, _ in self.segments(text or "")), default=None)
        return None if best is None else self.size(text) * math.exp(-self.lam * best)

    def score(self, text: str | None) -> float:
        z = self.a * math.log1p(self.evidence(text)) + self.b
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, z))))


def log_odds(counts: DataFrame, n1: float, n0: float) -> DataFrame:
    """(word, y1, y0) -> weights and z-scores, by built-in functions."""
    a = F.lit(0.5) + F.lit(PRIOR) * (F.col("y1") + F.col("y0")) / F.lit(n1 + n0)
    one, zero = F.col("y1") + a, F.col("y0") + a
    delta = F.log(one / (F.lit(n1 + PRIOR) - one)) - F.log(zero / (F.lit(n0 + PRIOR) - zero))
    return counts.select("word", "y1", "y0", delta.alias("delta"), (delta / F.sqrt(1 / one + 1 / zero)).alias("z"))


def karlin_lambda(weights: np.ndarray, shares: np.ndarray, other: float) -> float:
    """The positive root of sum(p exp(lambda s)) = 1 over clean text."""
    rest = 1 - shares.sum()
    f = lambda x: float((shares * np.exp(x * weights)).sum() + rest * math.exp(x * other) - 1)
    lo, hi = 1e-3, 1.0
    while f(hi) < 0 and hi < 64:
        hi *= 2
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (lo, mid) if f(mid) > 0 else (mid, hi)
    return lo


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on at most 2 * sample labelled rows; only the words of significant weight in them and one number per sampled row
    reach the driver."""
    small_batches(docs.sparkSession)
    rows, shares = training_rows(docs, labels, sample)
    words = rows.select("y", F.explode(F.array_distinct(F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), lambda w: w != ""))).alias("word"))
    counts = words.groupBy("word").agg(F.sum("y").alias("y1"), F.sum(1 - F.col("y")).alias("y0"))
    counts = counts.cache()
    n1, n0 = (float(x or 0) for x in counts.agg(F.sum("y1"), F.sum("y0")).first())
    if not n1 or not n0:
        counts.unpersist()
        return Model({}, -1.0, 1.0, 1.0, 0.0, -50.0)
    best = log_odds(counts, n1, n0).where((F.col("z") >= MIN_Z) & (F.col("delta") > 0)).orderBy(F.desc("z"), "word").collect()
    counts.unpersist()
    weights = {r["word"]: r["delta"] for r in best}
    p1, p0 = sum(r["y1"] for r in best) / n1, sum(r["y0"] for r in best) / n0
    other = min(-0.02, math.log((1 - p1) / (1 - p0)))
    clean = np.array([(r["y0"] + 0.5) / (n0 + len(best)) for r in best])
    values = np.array([r["delta"] for r in best])
    model = Model(weights, other, karlin_lambda(values, clean, other) if best else 1.0, 1.0)
    n, total = _each(rows.where("y = 0"), model, Model.tail).agg(F.count("e"), F.sum("e")).first()
    model.k = (n + 1) / ((total or 0.0) + 1)  # one text of K = 1 beside, so that there is a K where no clean text has a segment
    got = _each(rows, model, Model.evidence).collect()
    x, y = np.log1p(np.array([r["e"] for r in got])), np.array([r["y"] for r in got], float)
    model.a, model.b = _logistic(x, y, np.where(y > 0, shares.get(1, 1.0), shares.get(0, 1.0)))
    return model


def _each(rows: DataFrame, model: Model, measure) -> DataFrame:
    """(e, y): a number of each sampled row."""
    sent = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in by_bytes(batches, 0):
            yield pa.RecordBatch.from_arrays([pa.array([measure(sent.value, t) for t in b.column(0).to_pylist()], pa.float64()), b.column(1)], names=["e", "y"])

    return rows.mapInArrow(run, "e double, y int")


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Newton's method with a small ridge on the slope, rows weighted."""
    w, m, c = np.zeros(2), np.column_stack([x, np.ones_like(x)]), weight / weight.mean()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(m @ w, -30, 30)))
        g = m.T @ (c * (p - y)) + np.array([0.01, 0.001]) * w
        h = (m * (c * p * (1 - p))[:, None]).T @ m + np.diag([0.01, 0.001])
        step = np.linalg.solve(h, g)
        w -= np.clip(step, -5, 5)
        if abs(step).max() < 1e-6:
            break
    return float(max(w[0], 1e-3)), float(w[1])


def score_table(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) of every row."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in by_bytes(batches, 1):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([sent.value.score(t) for t in b.column(1).to_pylist()], pa.float64())], names=["doc_id", "score"])

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text").mapInArrow(run, "doc_id bigint, score double")


def drop_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """Rows and columns of docs whose score is under 0.5."""
    from pyspark.sql.functions import arrow_udf

    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @arrow_udf("double")
    def score(column: pa.Array) -> pa.Array:
        return pa.array([sent.value.score(t) for t in column.to_pylist()], pa.float64())

    return docs.where(score(F.col("text").cast("string")) < 0.5)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score_table(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", F.expr("pmod(crc32(cast(doc_id as string)), 5) = 0").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
