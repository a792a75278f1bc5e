"""Operator 12: documents packed into token sequences by cutting-stock column generation.

A document's tokens, with an end id, are a length to be cut from sequences of CAPACITY
tokens. Lengths are counted in CLASSES classes of WIDTH tokens, so the whole corpus is
a histogram of bounded size. A linear program over patterns (how many documents of
each class share a sequence) wants the fewest sequences; its columns come from a
knapsack by dynamic programming over the duals. Patterns are used as often as the
solution says, rounded down; what is left of the histogram is packed first fit,
longest first. Documents have a rank in their class (a task counts its own, a prefix
sum over tasks puts them in line), and the rank tells the sequence and the place in it.

A class counts as long as its longest length, so sequences keep holes. Documents longer
than a sequence have to be cut anyway: end to end they are a stream that fills the holes
first, then sequences of its own, and last sequences of powers of two, which need no
padding. Where the long documents are too few for the holes, the longest of the others
join them. So documents that fit are whole, but for those few, and there is no padding.
Holes and stream are both intervals of one line; they meet by equal chunks of it.

Only the histogram (CAPACITY rows), sums and the patterns are on the driver.

Defined results: a null or empty text is its end id alone. Null ids and repeated rows
are documents of their own. An empty table gives no piece.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._bpe import WordMerges, units
from ._spark import Scratch, by_bytes, table
from ._tokens import Parts

CAPACITY, WIDTH = 4096, 32
CLASSES = CAPACITY // WIDTH
#: Bytes of text that are encoded at a time, and tokens of the stream that are one join key.
BYTES, CHUNK = 4 << 20, 2 * CAPACITY
#: Pivots of the linear program per class: any basis is a plan, so it may end early.
PIVOTS = 60


class Words:
    """ids of texts: the tokenizer's own, then the end id. Each distinct word is encoded once."""

    def __init__(self, path: str, end: int):
        from tokenizers import Tokenizer

        tokenizer, self.end = Tokenizer.from_file(path), end
        self.parts = Parts(WordMerges(tokenizer))
        #: two bytes an id, if they do
        self.kind = "<u2" if max(tokenizer.get_vocab_size(), end + 1) <= 1 << 16 else "<u4"

    def __call__(self, texts: list[str | None]) -> list[np.ndarray]:
        _, (ids,) = self.parts([units(t) if t else [] for t in texts])
        return [np.append(x, self.end) for x in ids]


@lru_cache(maxsize=2)
def load(path: str, end: int) -> Words:
    return Words(path, end)


# --- the plan: a linear program over patterns


def knapsack(value: np.ndarray, units: int) -> tuple[float, np.ndarray]:
    """The most valuable pattern: class c takes c units and has value[c]; value[0] is unused."""
    best, taken = np.zeros(units + 1), np.zeros(units + 1, np.int64)
    for u in range(1, units + 1):
        gain = value[1 : u + 1] + best[u - 1 :: -1][:u]
        c = int(np.argmax(gain))
        best[u], taken[u] = (gain[c], c + 1) if gain[c] > best[u - 1] else (best[u - 1], 0)
    pattern, u = np.zeros(units + 1, np.int64), units
    while u > 0:
        pattern[taken[u]] += 1
        u -= max(int(taken[u]), 1)
    pattern[0] = 0
    return float(best[units]), pattern


def generate_columns(demand: np.ndarray, units: int) -> tuple[np.ndarray, np.ndarray]:
    """(patterns, how often each is used): the linear program's solution, demand[c] documents of class c in the fewest sequences."""
    rows = np.flatnonzero(demand)
    basis = np.zeros((len(rows), len(rows)))
    np.fill_diagonal(basis, units // rows)
    use = demand[rows] / (units // rows)
    for _ in range(PIVOTS * len(rows)):
        value = np.zeros(units + 1)
        value[rows] = np.linalg.solve(basis.T, np.ones(len(rows)))
        worth, pattern = knapsack(value, units)
        if worth <= 1 + 1e-9:
            break
        column = np.linalg.solve(basis, pattern[rows].astype(float))
        ratio = np.where(column > 1e-9, use / np.where(column > 1e-9, column, 1), np.inf)
        out = int(np.argmin(ratio))
        step = ratio[out]
        use = np.maximum(use - step * column, 0)
        use[out] = step
        basis[:, out] = pattern[rows]
    patterns = np.zeros((len(rows), units + 1), np.int64)
    patterns[:, rows] = np.rint(basis.T).astype(np.int64)
    return patterns, use


def first_fit(left: np.ndarray, units: int) -> list[np.ndarray]:
    """Patterns for what is left, longest first, each into the fullest sequence that still takes it."""
    open_: dict[int, list[np.ndarray]] = {}
    done = []
    for c in range(units, 0, -1):
        for _ in range(int(left[c])):
            room = next((r for r in range(c, units + 1) if open_.get(r)), None)
            if room is None:
                own, room = np.zeros(units + 1, np.int64), units
                done.append(own)
            else:
                own = open_[room].pop()
            own[c] += 1
            open_.setdefault(room - c, []).append(own)
    return done


def patterns_for(demand: np.ndarray, units: int) -> tuple[np.ndarray, np.ndarray]:
    """(patterns, copies) that hold exactly the demand."""
    if not demand.any():
        return np.zeros((0, units + 1), np.int64), np.zeros(0, np.int64)
    patterns, use = generate_columns(demand, units)
    # rounding errors of the solution mustn't use a class up twice
    copies, left = np.floor(use + 1e-6).astype(np.int64), demand.astype(np.int64).copy()
    for i, p in enumerate(patterns):
        held = p > 0
        copies[i] = min(copies[i], int((left[held] // p[held]).min())) if held.any() else 0
        left -= copies[i] * p
    rest = first_fit(left, units)
    both = np.concatenate([patterns, np.array(rest, np.int64).reshape(-1, units + 1)])
    both, of = np.unique(both, axis=0, return_inverse=True)
    total = np.zeros(len(both), np.int64)
    np.add.at(total, of.ravel(), np.concatenate([copies, np.ones(len(rest), np.int64)]))
    return both[total > 0], total[total > 0]


@dataclass(frozen=True)
class Plan:
    """demand: documents by class that are packed whole, by rank; sequences: how many they take. Sorted by class and rank:
    the ranks from `first` on lie `each` to a sequence, from sequence `sequence` and place `place` on."""

    demand: np.ndarray
    sequences: int
    key: np.ndarray
    first: np.ndarray
    each: np.ndarray
    sequence: np.ndarray
    place: np.ndarray

    def locate(self, kind: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(sequence, place) of documents by class and rank."""
        i = np.searchsorted(self.key, kind * RANKS + rank, "right") - 1
        copy, k = (rank - self.first[i]) // self.each[i], (rank - self.first[i]) % self.each[i]
        return self.sequence[i] + copy, self.place[i] + k


RANKS = 1 << 52


def make_plan(lengths: np.ndarray, counts: np.ndarray, stream: int, capacity: int = CAPACITY, width: int = WIDTH) -> Plan:
    """lengths and counts: the histogram of documents of at most `capacity` tokens; stream: tokens of the longer ones. As many
    of the longest classes go to the stream as its tokens need to fill every hole."""
    units = capacity // width
    kind = -(-lengths // width)
    have, tokens = (np.bincount(kind, w, units + 1).astype(np.int64) for w in (counts, counts * lengths))
    upper = np.arange(units + 1) * width
    lower = np.maximum(upper - width + 1, 0)
    gone, wanted = np.zeros(units + 1, np.int64), 0
    while True:
        demand = have - gone
        patterns, copies = patterns_for(demand, units)
        # bounds: which lengths of a class go isn't known here
        stays = np.maximum(tokens - gone * upper, demand * lower).sum()
        filling = stream + np.maximum(gone * lower, tokens - demand * upper).sum()
        holes = capacity * int(copies.sum()) - int(stays)
        if filling >= holes or not demand.any():
            break
        wanted = max(2 * wanted, holes - stream)
        gone, need = np.zeros(units + 1, np.int64), wanted
        for c in range(units, 0, -1):
            if need > 0:
                gone[c] = min(have[c], -(-need // lower[c]))
                need -= gone[c] * lower[c]
    base, rows = np.cumsum(copies) - copies, []
    rank = np.zeros(units + 1, np.int64)
    for p, n, s in zip(patterns, copies.tolist(), base.tolist(), strict=True):
        place = 0
        for c in np.flatnonzero(p).tolist()[::-1]:
            rows.append((c, int(rank[c]), int(p[c]), s, place))
            rank[c] += n * int(p[c])
            place += int(p[c])
    c, first, each, s, place = (np.array(x, np.int64) for x in zip(*sorted(rows), strict=True)) if rows else (np.zeros(0, np.int64),) * 5
    return Plan(demand, int(copies.sum()), c * RANKS + first, first, each, s, place)


# --- the corpus


def encode(docs: DataFrame, path: str, end: int, capacity: int, width: int) -> DataFrame:
    """(doc_id, n, crc, ids, kind, local): a document's ids, their number and CRC-32; of those that fit a sequence the class and the rank
    among the task's documents of that class."""

    def run(batches):
        tokens, seen = load(path, end), np.zeros(capacity // width + 1, np.int64)
        for b in by_bytes(batches, 1, BYTES):
            ids = tokens(b.column(1).to_pylist())
            n = np.array([len(x) for x in ids], np.int64)
            kind = np.where(n <= capacity, -(-n // width), 0)
            local = np.zeros(len(n), np.int64)
            for c in np.unique(kind).tolist():
                at = np.flatnonzero(kind == c)
                local[at] = seen[c] + np.arange(len(at))
                seen[c] += len(at)
            crc = [zlib.crc32(x.astype("<u4").tobytes()) for x in ids]
            raw = pa.array([x.astype(tokens.kind).tobytes() for x in ids], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), pa.array(crc, pa.int64()), raw, pa.array(kind), pa.array(local)], names=["doc_id", "n", "crc", "ids", "kind", "local"])

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text").mapInArrow(run, "doc_id bigint, n bigint, crc bigint, ids binary, kind bigint, local bigint")


def _ranked(encoded: DataFrame, s: Scratch) -> DataFrame:
    """encoded, kept, with key (its upper bits are the task that wrote it), part and rank: the task's first rank of the class and the local one."""
    kept = s.keep(encoded.withColumn("key", F.monotonically_increasing_id()).withColumn("part", F.shiftright("key", 33)))
    before = F.sum("count").over(Window.partitionBy("kind").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    starts = s.keep(kept.groupBy("kind", "part").agg(F.count("*").alias("count")).select("kind", "part", F.coalesce(before, F.lit(0)).alias("start")))
    return kept.join(starts, ["kind", "part"]).withColumn("rank", F.col("start") + F.col("local"))


def _in_line(rows: DataFrame, block: str, order: str, size: str) -> DataFrame:
    """rows with `at`: the sum of the sizes before it, blocks in order; a block's rows are few."""
    sums = rows.groupBy(block).agg(F.sum(size).alias("sum__"))
    # blocks are as many as tasks, or a 65536th of the sequences
    before = F.sum("sum__").over(Window.orderBy(block).rowsBetween(Window.unboundedPreceding, -1))
    own = F.sum(size).over(Window.partitionBy(block).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    starts = sums.select(block, F.coalesce(before, F.lit(0)).alias("start__"))
    return rows.withColumn("own__", F.coalesce(own, F.lit(0))).join(starts, block).withColumn("at", F.col("start__") + F.col("own__")).drop("own__", "start__")


def _chunks(rows: DataFrame) -> DataFrame:
    return rows.withColumn("chunk", F.explode(F.expr(f"sequence(at div {CHUNK}, (at + size - 1) div {CHUNK})")))


def _cut(path: str, end: int, payload: str) -> Callable:
    """Rows of a document's pieces, with the payload of each."""

    def run(batches):
        kind = load(path, end).kind
        for b in by_bytes(batches, 2):
            out = []
            for doc, n, raw, cuts in zip(*(c.to_pylist() for c in b.columns), strict=True):
                ids = np.frombuffer(raw, kind).astype("<u4")
                for c in cuts:
                    own = ids[c["start"] : c["start"] + c["length"]].tobytes()
                    out.append((doc, c["start"], c["length"], zlib.crc32(own) if payload == "crc" else own, n, c["sequence_id"], c["offset"]))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64() if payload == "crc" else pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            columns = zip(*out, strict=True) if out else [()] * 7
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], names=["doc_id", "start", "length", payload, "doc_tokens", "sequence_id", "offset"])

    return run


def _wide(path: str, end: int):
    """Four-byte ids of those that were kept in two."""

    @F.arrow_udf("binary")
    def widen(column: pa.Array) -> pa.Array:
        kind = load(path, end).kind
        return pa.array([np.frombuffer(x, kind).astype("<u4").tobytes() for x in column.to_pylist()], pa.binary())

    return widen


def pack(docs: DataFrame, path: str, end: int = 2, capacity: int = CAPACITY, width: int = WIDTH, payload: str = "ids") -> DataFrame:
    """(doc_id, start, length, ids or crc, doc_tokens, sequence_id, offset) of every piece. payload "ids": the piece's
    ids, little-endian, four bytes each; "crc": their CRC-32."""
    spark = docs.sparkSession
    with Scratch(spark) as s:
        rows = _ranked(encode(docs, path, end, capacity, width), s)
        lengths = rows.where("kind > 0").groupBy("n").count().toArrow()
        stream = rows.where("kind = 0").agg(F.sum("n")).first()[0] or 0
        plan = make_plan(lengths["n"].to_numpy().astype(np.int64), lengths["count"].to_numpy().astype(np.int64), stream, capacity, width)
        demand = F.array(*[F.lit(int(x)) for x in plan.demand])
        whole = (F.col("kind") > 0) & (F.col("rank") < F.get(demand, F.col("kind").cast("int")))
        sent = spark.sparkContext.broadcast(plan)

        @F.arrow_udf("struct<sequence: bigint, place: bigint>")
        def locate(kind: pa.Array, rank: pa.Array) -> pa.Array:
            return pa.StructArray.from_arrays([pa.array(x) for x in sent.value.locate(kind.to_numpy(), rank.to_numpy())], names=["sequence", "place"])

        own = F.col("crc") if payload == "crc" else _wide(path, end)(F.col("ids"))
        before = F.coalesce(F.sum("n").over(Window.partitionBy("sequence_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        located = rows.where(whole).select("doc_id", "n", own.alias(payload), locate("kind", "rank").alias("x")).select("doc_id", "n", payload, F.col("x.sequence").alias("sequence_id"), "x.place")
        placed = s.keep(located.select("doc_id", F.lit(0).cast("bigint").alias("start"), F.col("n").alias("length"), payload, F.col("n").alias("doc_tokens"), "sequence_id", before.alias("offset")))
        # holes of those sequences, then sequences of the stream alone
        holes = placed.groupBy("sequence_id").agg(F.sum("length").alias("offset")).where(F.col("offset") < capacity).select("sequence_id", "offset", (capacity - F.col("offset")).alias("size"), F.shiftright("sequence_id", 16).alias("block"))
        holes = s.keep(_in_line(holes, "block", "sequence_id", "size").drop("block"))
        filling = s.keep(_in_line(rows.where(~whole).select("key", "part", F.col("n").alias("size")), "part", "key", "size").drop("part"))
        to_fill, there = ((t.agg(F.sum("size")).first()[0] or 0) for t in (holes, filling))
        more = max(0, there - to_fill)
        alone = spark.range(more // capacity).select((F.col("id") + plan.sequences).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"), F.lit(capacity).cast("bigint").alias("size"), (F.col("id") * capacity + to_fill).alias("at"))
        tails, at = [], to_fill + more // capacity * capacity
        for bit in range(capacity.bit_length() - 1, -1, -1):
            if more % capacity >> bit & 1:
                tails.append((plan.sequences + more // capacity + len(tails), 0, 1 << bit, at))
                at += 1 << bit
        last = spark.createDataFrame(tails, "sequence_id bigint, offset bigint, size bigint, at bigint")
        line = holes.select(last.columns).unionByName(alone).unionByName(last)
        h, f = _chunks(line).alias("h"), _chunks(filling).alias("f")
        lo, hi = F.greatest("h.at", "f.at"), F.expr("least(h.at + h.size, f.at + f.size)")
        met = h.join(f, F.col("h.chunk") == F.col("f.chunk")).where((lo < hi) & (F.expr(f"greatest(h.at, f.at) div {CHUNK}") == F.col("h.chunk")))
        cuts = met.select("f.key", F.struct((lo - F.col("f.at")).alias("start"), (hi - lo).alias("length"), F.col("h.sequence_id").alias("sequence_id"), (F.col("h.offset") + lo - F.col("h.at")).alias("offset")).alias("cut"))
        by_doc = cuts.groupBy("key").agg(F.collect_list("cut").alias("cuts"))
        kind = "bigint" if payload == "crc" else "binary"
        pieces = rows.where(~whole).select("key", "doc_id", "n", "ids").join(by_doc, "key").select("doc_id", "n", "ids", "cuts").mapInArrow(_cut(path, end, payload), f"doc_id bigint, start bigint, length bigint, {payload} {kind}, doc_tokens bigint, sequence_id bigint, offset bigint")
        return s.result(placed.unionByName(pieces))


def sequences(pieces: DataFrame) -> DataFrame:
    """(sequence_id, length, ids): the pieces of each sequence, end to end."""
    ordered = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(ordered, F.lit(b"").cast("binary"), lambda a, x: F.concat(a, x["ids"]))
    return pieces.groupBy("sequence_id").agg(F.sum("length").alias("length"), joined.alias("ids"))


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    return pack(table(spark, sf_dir, "documents"), P.path("word_bpe_49k.json"), payload="crc").withColumnRenamed("crc", "ids_crc32")
