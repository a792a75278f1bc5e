"""Operator 5: benchmark decontamination by windows of an item's size.

For every benchmark item, windows of as many 5-word shingles as the item has slide
over a text. A window's similarity is that of the two shingle multisets (sum of
smaller counts over sum of larger counts), and must reach THRESHOLD.

Every window of an item's size has a SimHash, counted incrementally: bit counts are
prefix sums over the text, and a window's are the difference of two. Fingerprints are cut
into RADIUS + 1 blocks; a window within RADIUS bits of an item's fingerprint has at least
one block of it, so looking up each block finds all of them. The items that this
proposes are verified by their exact similarity.

Windows at the threshold may be farther than any radius that blocks can stand for, as
where a word that repeats is replaced by another. Those come from a second source: an
index of the items' shingles (a window that shares none has similarity 0), for items
whose best window is beyond the radius, or whose size the text doesn't reach. So
the two sources together find all, and each item has one of them.

The items are sent to the workers in slices of at most SLICE items and about
SLICE_BYTES of text, one at a time; a larger benchmark takes one pass over the
documents per slice.

Defined results: null and empty texts match nothing, and neither do items without
words; items of null id are left out. Items under five words count as one shingle of their own length. A
document is a row per item found in it. Repeated rows give repeated rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import Scratch, by_bytes, flat_utf8, small_batches, table
from ._words import bit_rows, shingle_hashes, simhash, word_hashes

SHINGLE = 5
#: Numerator and denominator: compared in whole numbers.
THRESHOLD = 4, 5
#: Bits of 64 by which a window's fingerprint may differ from an item's to be looked up, in one block more.
RADIUS = 3
#: Windows that are fingerprinted at a time.
WINDOWS = 1 << 14
#: Items, and bytes of their texts, that go to the workers at a time.
SLICE, SLICE_BYTES = 20_000, 8 << 20
#: Bits of the prefilter table for shared shingles.
TABLE_BITS = 20
#: Bytes of text that are hashed at a time: that takes some 40 times their memory.
BYTES = 1 << 20


class Items:
    """Benchmark items of one shingle size: block index of their fingerprints by item size, and index of their shingles."""

    def __init__(self, ids: list[int], hashes: list[np.ndarray], k: int):
        self.ids, self.k = ids, k
        self.counts = [Counter(h.tolist()) for h in hashes]
        self.sizes = [len(h) for h in hashes]
        self.of: dict[int, list[int]] = {}
        for i, c in enumerate(self.counts):
            for h in c:
                self.of.setdefault(h, []).append(i)
        self.known = np.sort(np.array(list(self.of), np.uint64))
        self.table = np.zeros(1 << TABLE_BITS, bool)
        self.table[(self.known & np.uint64((1 << TABLE_BITS) - 1)).astype(np.int64)] = True

        self.prints = np.array([simhash(h) for h in hashes], np.uint64)
        self.blocks = {}
        for m in sorted(set(self.sizes)):
            own = np.flatnonzero(np.array(self.sizes) == m)
            self.blocks[m] = own, _block_index(self.prints[own])

    def shared(self, shingles: np.ndarray) -> np.ndarray:
        """Places of shingles that some item has."""
        maybe = np.flatnonzero(self.table[(shingles & np.uint64((1 << TABLE_BITS) - 1)).astype(np.int64)])
        at = np.searchsorted(self.known, shingles[maybe])
        return maybe[self.known[np.minimum(at, len(self.known) - 1)] == shingles[maybe]]

    def proposed(self, s: np.ndarray) -> Iterator[tuple[np.ndarray, int, int]]:
        """(starts, size, item) of windows of an item's size within RADIUS bits of it."""
        for m, at, prints in window_prints(s, list(self.blocks)):
            own, blocks = self.blocks[m]
            # four bytes a window, one of each block's value
            some = np.flatnonzero(blocks.take(prints.view("<u2"), mode="clip").view("<u4") & _EACH)
            if len(some):
                for i in own.tolist():
                    near = some[np.bitwise_count(prints[some] ^ self.prints[i]) <= RADIUS]
                    if len(near):
                        yield at + near, m, i

    def find(self, s: np.ndarray, hits: np.ndarray, near: set[int]) -> list[tuple[int, float]]:
        """(item, best similarity) of a text's shingles s; hits: places of shared ones; near: items that the blocks propose."""
        places: dict[int, list[int]] = {}
        for p, h in zip(hits.tolist(), s[hits].tolist(), strict=True):
            for i in self.of[h]:
                places.setdefault(i, []).append(p)
        out = []
        for i, at in places.items():
            m = min(self.sizes[i], len(s))
            reached = lambda both: sum(THRESHOLD) * both >= THRESHOLD[0] * (self.sizes[i] + m)  # noqa: B023, E731
            if not reached(len(at)):
                continue
            both, start = self.most_shared(i, s, np.array(at), m)
            if reached(both) and (i in near or self.beyond(i, s, start)):
                out.append((self.ids[i], both / (m + self.sizes[i] - both)))
        return out

    def beyond(self, i: int, s: np.ndarray, start: int) -> bool:
        """Whether the window at start isn't one that the blocks stand for."""
        m = self.sizes[i]
        return len(s) < m or (simhash(s[start : start + m]) ^ int(self.prints[i])).bit_count() > RADIUS

    def most_shared(self, i: int, s: np.ndarray, p: np.ndarray, m: int) -> tuple[int, int]:
        """Largest sum of smaller counts that a window of m of the shingles s has with item i, and where the first such begins;
        p: places of the item's shingles.

        Of a shingle that the item has c times, a place counts in the windows that hold it and not the c-th place before it."""
        h = s[p]
        order = np.argsort(h, kind="stable")
        h, p = h[order], p[order]
        values, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        c = np.array([self.counts[i][x] for x in values.tolist()])[inverse]
        rank = np.arange(len(p)) - first[inverse]
        before = np.where(rank >= c, p[np.maximum(np.arange(len(p)) - c, 0)], -1)
        lo, hi = np.maximum(np.maximum(p - m, before) + 1, 0), np.minimum(p, len(s) - m)
        lo, hi = lo[lo <= hi], hi[lo <= hi]
        steps = np.concatenate([2 * (hi + 1), 2 * lo + 1])  # at one start, ends come before beginnings
        steps.sort()
        held = np.cumsum(np.where(steps & 1, 1, -1))
        best = int(np.argmax(held))
        return int(held[best]), int(steps[best] // 2)


_EACH = np.uint32(sum(1 << b << 8 * b for b in range(RADIUS + 1)))


def _block_index(prints: np.ndarray) -> np.ndarray:
    """For each value of 16 bits, in which blocks the fingerprints have it (a bit each)."""
    keys = prints.astype("<u8").view("<u2").reshape(len(prints), -1)
    index = np.zeros(1 << 16, np.uint8)
    for b, own in enumerate(keys.T):
        index[np.unique(own)] |= np.uint8(1 << b)
    return index


def window_prints(s: np.ndarray, sizes: list[int]) -> Iterator[tuple[int, int, np.ndarray]]:
    """(m, first start, fingerprints) of all windows of m shingles, for every m of sizes, WINDOWS or so at a time. Bit counts of
    windows of under 256 are differences of sums modulo 256; longer ones are counted eight bits at a time."""
    short, long = [m for m in sizes if m < 256], [m for m in sizes if m >= 256]
    change, more = np.empty((WINDOWS, 64), np.uint8), np.empty((WINDOWS, 64), bool)
    for i in range(0, len(s), WINDOWS) if short else ():
        own = s[i : i + WINDOWS + max(short) - 1]
        c = np.zeros((len(own) + 1, 64), np.uint8)
        np.cumsum(bit_rows(own), axis=0, dtype=np.uint8, out=c[1:])
        for m in short:
            n = min(WINDOWS, len(own) - m + 1)
            if n > 0:
                np.subtract(c[m : m + n], c[:n], out=change[:n])
                np.greater(change[:n], m // 2, out=more[:n])
                yield m, i, np.packbits(more[:n].ravel(), bitorder="little").view("<u8")
    for m in long:
        for i in range(0, len(s) - m + 1, step := max(WINDOWS, m)):
            own = s[i : i + step + m - 1]
            n = len(own) - m + 1
            out = np.zeros((n, 8), np.uint8)
            for b in range(8):
                c = np.zeros((len(own) + 1, 8), np.int32)
                np.cumsum(bit_rows(own >> np.uint64(8 * b) & np.uint64(255))[:, :8], axis=0, out=c[1:])
                out[:, b] = np.packbits(c[m:] - c[:n] > m // 2, axis=1, bitorder="little").ravel()
            yield m, i, out.view("<u8").ravel()


def index_items(rows: list[tuple[int, str]]) -> list[Items]:
    by_k: dict[int, tuple[list[int], list[np.ndarray]]] = {}
    for item_id, text in rows:
        raw = (text or "").encode()
        words, _ = word_hashes(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        if len(words):
            k = min(SHINGLE, len(words))
            ids, hashes = by_k.setdefault(k, ([], []))
            ids.append(item_id)
            hashes.append(shingle_hashes(words, k))
    return [Items(ids, hashes, k) for k, (ids, hashes) in sorted(by_k.items())]


def matches(items: list[Items], flat: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, float]]:
    """(document's place, item_id, similarity) of a batch of texts."""
    words, first = word_hashes(flat, offsets)
    out = []
    for group in items:
        s = shingle_hashes(words, group.k)
        hit = group.shared(s) if len(s) else s
        if not len(hit):
            continue
        near: dict[int, set[int]] = {}
        for starts, m, i in group.proposed(s):
            doc = np.searchsorted(first, starts, "right") - 1
            for d in np.unique(doc[starts + m + group.k - 1 <= first[doc + 1]]).tolist():
                near.setdefault(d, set()).add(i)
        doc = np.searchsorted(first, hit, "right") - 1
        ok = hit + group.k <= first[doc + 1]
        hit, doc = hit[ok], doc[ok]
        if not len(hit):
            continue
        cut = np.flatnonzero(np.diff(doc)) + 1
        for own, d in zip(np.split(hit, cut), doc[np.concatenate([[0], cut])].tolist(), strict=True):
            a, b = int(first[d]), int(first[d + 1]) - group.k + 1
            out += [(d, i, x) for i, x in group.find(s[a:b], own - a, near.get(d, set()))]
    return out


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, similarity): every benchmark item found in a document."""
    small_batches(docs.sparkSession)
    n, slices = _slices(benchmark)
    if n == 1:
        return _pass(docs, next(slices))[0]
    out = None
    with Scratch(docs.sparkSession) as s:
        for items in slices:
            part, sent = _pass(docs, items)
            part = s.result(part)
            sent.destroy()
            out = part if out is None else out.unionByName(part)
    return out


def _slices(benchmark: DataFrame) -> tuple[int, Iterator[list[Items]]]:
    """How many slices of at most SLICE items and about SLICE_BYTES of text there are, and their indexes, made when their turn comes."""
    rows = benchmark.selectExpr("cast(item_id as bigint) item_id", "cast(text as string) text").where("item_id is not null")
    count, size = rows.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    n = max(1, math.ceil(count / SLICE), math.ceil((size or 0) / SLICE_BYTES))
    take = lambda k: [tuple(r) for r in rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).orderBy("item_id", "text").collect()]
    return n, (index_items(take(k)) for k in range(n))


def _pass(docs: DataFrame, items: list[Items]) -> tuple[DataFrame, Broadcast]:
    sent = docs.sparkSession.sparkContext.broadcast(items)

    def run(batches):
        for b in by_bytes(batches, 1, BYTES):
            ids = b.column(0).to_pylist()
            found = matches(sent.value, *flat_utf8(b.column(1)))
            yield pa.RecordBatch.from_arrays([pa.array([ids[d] for d, _, _ in found], pa.int64()), pa.array([i for _, i, _ in found], pa.int64()), pa.array([x for _, _, x in found], pa.float64())], names=["doc_id", "item_id", "similarity"])

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text").mapInArrow(run, "doc_id bigint, item_id bigint, similarity double"), sent


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Rows and columns of docs in which no item was found. Of several slices, each pass leaves a table of the rows that are left."""
    small_batches(docs.sparkSession)
    n, slices = _slices(benchmark)
    if n == 1:
        return docs.where(~_leaks(docs.sparkSession, next(slices))[0](F.col("text").cast("string")))
    with Scratch(docs.sparkSession) as s:
        for k, items in enumerate(slices):
            leaks, sent = _leaks(docs.sparkSession, items)
            left = docs.where(~leaks(F.col("text").cast("string")))
            before, docs = docs, s.keep(left) if k < n - 1 else s.result(left)
            sent.destroy()
            if k:
                s.drop(before)
    return docs


def _leaks(spark: SparkSession, items: list[Items]):
    from pyspark.sql.functions import arrow_udf

    sent = spark.sparkContext.broadcast(items)

    @arrow_udf("boolean")
    def leaks(column: pa.Array) -> pa.Array:
        out, at = np.zeros(len(column), bool), 0
        for b in by_bytes([pa.RecordBatch.from_arrays([column], names=["text"])], 0, BYTES):
            out[[at + d for d, _, _ in matches(sent.value, *flat_utf8(b.column(0)))]] = True
            at += len(b)
        return pa.array(out)

    return leaks, sent


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
