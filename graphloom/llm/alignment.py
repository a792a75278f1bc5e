"""Operator 13: which tokens of two tokenizers cover the same bytes of a text.

A is a byte-level BPE (tokenizers) of space+text, B a SentencePiece BPE of the text.
Both lists of byte ends are united; each elementary interval lies in one token of A
and one of B (searchsorted of the interval's end in either list), which is one
overlap. Ends that both lists have close a group. All tokens of A in a group are
linked to all of B in it, so a group's links are a product: they are counted without
being formed, and pairs of ids are formed from a group's distinct ids where it is
large.

A worker aligns a quarter of a megabyte of text at a time, all texts in one byte stream (a text's
end is an end in both lists). Each text leaves its distinct id pairs, with how often
it has them, as two binary columns of a table. How many texts hold a pair is counted
from that table: first in each task, then by Spark. The counts go back to the texts in
slices of at most SLICE pairs, each of them broadcast; a text's sums over the slices
are added up. Neither a pair nor an id is a group in one task.

Both tokenizers cut at a space that follows a solid character: the byte-level
pattern never joins a space to a character before it, and no piece of B has U+2581
behind another character (which is asserted). So parts between such spaces are encoded
by themselves, each distinct one once. For the byte-level tokenizer, of which a call costs more than a
word, many parts are one text again, whose ids are dealt back to them by their bytes.

Defined results: null and empty texts, and those whose joined bytes differ from
space+text in either tokenizer (a text with U+2581), have zeros and an empty digest.
Repeated rows are texts of their own, and count as such.
"""

from __future__ import annotations

import hashlib
import math
import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._bpe import byte_chars
from ._spark import Scratch, by_bytes, table
from ._tokens import Parts, ends_solid, flat, runs

#: Bytes of text that are aligned at a time: arrays of links and pairs are some hundred times as large.
BYTES = 1 << 18
#: Parts that a worker remembers, with the ids of both tokenizers.
PARTS = 200_000
#: Parts that are one text for the byte-level tokenizer at most.
JOINED = 256
#: Links of a group beyond which its distinct ids are paired, and pairs formed at a time then.
LARGE, BLOCK = 4096, 1 << 20
#: Pairs whose counts are sent to the workers at a time: 16 bytes each.
SLICE = 2_000_000
#: Pairs that a task gathers before it counts them.
GATHERED = 4_000_000


class Pair:
    """Both tokenizers: parts to ids, and the bytes of their ids."""

    def __init__(self, byte_bpe: str, piece_model: str):
        # a task has one core; the library's threads cost more than they save
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(byte_bpe)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_model)
        vocabulary = self.a.get_vocab(with_added_tokens=True)
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        plain = byte_chars()
        for entry, i in vocabulary.items():
            self.bytes_a[i] = bytes(plain[c] for c in entry) if all(c in plain for c in entry) else entry.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        if any("▁" in p.lstrip("▁") for p in pieces):
            raise ValueError("a piece has U+2581 behind another character")
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.size_a, self.size_b = (np.array([len(x) for x in own], np.int64) for own in (self.bytes_a, self.bytes_b))
        self.parts = Parts(self._encode, 2, PARTS)
        self.n = max(len(self.bytes_a), len(pieces))
        self.written = np.array([f"{i}{end}" for end in (",", "|", ";") for i in range(self.n)], object)

    def _encode(self, parts: list[str]):
        """Both tokenizers' ids of each part behind a space, and whether their bytes are those."""
        oks, found = [], []
        for i in range(0, len(parts), 4096):
            own = parts[i : i + 4096]
            raw = [b" " + p.encode() for p in own]
            # of an empty text the library gives nothing; as a part it is a space
            b = flat([y if p else [self.b.piece_to_id("▁")] for p, y in zip(own, self.b.encode(own, num_threads=1), strict=True)])
            found.append((self._encode_a(own, raw), b))
            oks.append(_same(self.bytes_a, self.size_a, *found[-1][0], raw) & _same(self.bytes_b, self.size_b, *b, raw))
        return np.concatenate(oks), [tuple(np.concatenate([x[side][k] for x in found]) for k in range(2)) for side in range(2)]

    def _encode_a(self, parts: list[str], raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the byte-level tokenizer, and how many of each part. Parts are joined behind those that end in a solid character."""
        texts, n = [], JOINED
        for p in parts:
            if n == JOINED or not ends_solid(texts[-1][-1]):
                texts.append([])
                n = 0
            texts[-1].append(p)
            n += 1
        ids, _ = flat([x.ids for x in self.a.encode_batch_fast(["".join([" " + p for p in own]) for own in texts], add_special_tokens=False)])
        ends, until = np.cumsum(self.size_a[ids]), np.cumsum([len(r) for r in raw])
        last = np.searchsorted(ends, until)
        if len(ends) and ends[-1] == until[-1] and (ends[last] == until).all():
            return ids, np.diff(last + 1, prepend=0)
        return flat([x.ids for x in self.a.encode_batch_fast([" " + p for p in parts], add_special_tokens=False)])

    def ids(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray] | None]:
        ok, (a, b) = self.parts([runs(t) if t else [] for t in texts])
        return [(a[i], b[i]) if t and ok[i] else None for i, t in enumerate(texts)]


def _same(table: list[bytes], size: np.ndarray, ids: np.ndarray, count: np.ndarray, raw: list[bytes]) -> np.ndarray:
    """Whether the bytes of each part's ids are its own: at once if all are, else part by part."""
    last = np.cumsum(count)
    ends = np.concatenate([[0], np.cumsum(size[ids])])[last]
    if (ends == np.cumsum([len(r) for r in raw])).all() and _joined(table, ids.tolist()) == b"".join(raw):
        return np.ones(len(raw), bool)
    return np.array([_joined(table, ids[j - n : j].tolist()) == r for r, j, n in zip(raw, last.tolist(), count.tolist(), strict=True)], bool)


def _joined(table: list[bytes], ids: list[int]) -> bytes:
    return b"".join(map(table.__getitem__, ids))


@lru_cache(maxsize=2)
def load(byte_bpe: str, piece_model: str) -> Pair:
    return Pair(byte_bpe, piece_model)


class Aligned:
    """Groups of the tokens whose byte sizes are a and b: first_a[g]:first_a[g + 1] and first_b[g]:first_b[g + 1]."""

    def __init__(self, a: np.ndarray, b: np.ndarray):
        ends_a, ends_b = np.cumsum(a), np.cumsum(b)
        cuts = union1d(ends_a, ends_b)
        # the owners of each elementary interval
        self.own_a, self.own_b = np.searchsorted(ends_a, cuts), np.searchsorted(ends_b, cuts)
        shared = np.flatnonzero((ends_a[np.minimum(self.own_a, len(a) - 1)] == cuts) & (ends_b[np.minimum(self.own_b, len(b) - 1)] == cuts)) if len(cuts) else np.zeros(0, np.int64)
        self.first_a = np.concatenate([[0], self.own_a[shared] + 1]).astype(np.int64)
        self.first_b = np.concatenate([[0], self.own_b[shared] + 1]).astype(np.int64)
        self.ends = cuts[shared]
        self.n_a, self.n_b = np.diff(self.first_a), np.diff(self.first_b)
        self.links = self.n_a * self.n_b


def union1d(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """numpy's union1d of sorted arrays: two runs are merged, not sorted anew."""
    both = np.concatenate([x, y])
    both.sort(kind="stable")
    return both[np.concatenate([[True], both[1:] != both[:-1]])] if len(both) else both


def _spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For counts (2, 3): (0, 0, 1, 1, 1) and (0, 1, 0, 1, 2)."""
    of = np.repeat(np.arange(len(counts)), counts)
    return of, np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)


def _products(x: Aligned, a: np.ndarray, b: np.ndarray, groups: np.ndarray, wide: int):
    """(pair, times, group) of all links of groups."""
    small = groups[x.links[groups] <= LARGE]
    of, k = _spread(x.links[small])
    g = small[of]
    yield a[x.first_a[g] + k // x.n_b[g]] * wide + b[x.first_b[g] + k % x.n_b[g]], np.ones(len(g), np.int64), g
    for g in groups[x.links[groups] > LARGE].tolist():
        own_a, times_a = np.unique(a[x.first_a[g] : x.first_a[g + 1]], return_counts=True)
        own_b, times_b = np.unique(b[x.first_b[g] : x.first_b[g + 1]], return_counts=True)
        step = max(1, BLOCK // len(own_b))
        for i in range(0, len(own_a), step):
            pair, times = (own_a[i : i + step, None] * wide + own_b).ravel(), (times_a[i : i + step, None] * times_b).ravel()
            yield pair, times, np.full(len(pair), g)


def align(ids: list[tuple[np.ndarray, np.ndarray] | None], tokens: Pair) -> list[tuple]:
    """(n_a, n_b, n_groups, n_links, groups as text, distinct pairs, how often) of each text."""
    full = [i for i, x in enumerate(ids) if x is not None]
    out: list[tuple] = [(0, 0, 0, 0, "", np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(ids)
    if not full:
        return out
    a, b = (np.concatenate([ids[i][side] for i in full]) for side in range(2))
    x = Aligned(tokens.size_a[a], tokens.size_b[b])
    until_a, until_b = (np.cumsum([len(ids[i][side]) for i in full]) for side in range(2))
    # a text's groups: those up to the one that holds its last token
    last = np.searchsorted(x.first_a[1:], until_a)
    wide, doc = len(tokens.bytes_b), np.searchsorted(last, np.arange(len(x.links)))
    # a group's tokens as text: A's, then B's
    group = np.concatenate([np.repeat(np.arange(len(x.n_a)), x.n_a) * 2, np.repeat(np.arange(len(x.n_b)), x.n_b) * 2 + 1])
    ending = np.zeros(len(group), np.int64)
    ending[x.first_a[1:] - 1], ending[len(a) + x.first_b[1:] - 1] = 1, 2
    order = np.argsort(group, kind="stable")
    both, ending, side = np.concatenate([a, b])[order], ending[order], group[order]
    written = tokens.written[ending * tokens.n + both]
    text_ends = np.searchsorted(side, last * 2 + 1, "right")
    formed = [np.concatenate(c) for c in zip(*_products(x, a, b, np.arange(len(x.links)), wide), strict=True)]
    pairs, times, of = formed[0], formed[1], doc[formed[2]]
    order = np.lexsort((pairs, of))
    pairs, times, of = pairs[order], times[order], of[order]
    new = np.flatnonzero(np.concatenate([[True], (pairs[1:] != pairs[:-1]) | (of[1:] != of[:-1])])) if len(pairs) else np.zeros(0, np.int64)
    pairs, of, times = pairs[new], of[new], np.add.reduceat(times, new) if len(new) else times
    cut = np.searchsorted(of, np.arange(len(full) + 1))
    links = np.concatenate([[0], np.cumsum(x.links)])
    for d, i in enumerate(full):
        g0, g1 = (int(last[d - 1]) + 1 if d else 0), int(last[d]) + 1
        said = "".join(written[int(text_ends[d - 1]) if d else 0 : int(text_ends[d])].tolist())[:-1]
        out[i] = len(ids[i][0]), len(ids[i][1]), g1 - g0, int(links[g1] - links[g0]), said, pairs[cut[d] : cut[d + 1]], times[cut[d] : cut[d + 1]]
    return out


ROWS = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups string, pairs binary, times binary"


def alignments(docs: DataFrame, byte_bpe: str, piece_model: str, digest: bool = False) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, groups, pairs, times) of each row: groups as `a1,a2|b1;a3|b2,b3`, or its SHA-256;
    pairs: distinct A id * size of B + B id, as little-endian 64-bit numbers, times: how often each is linked."""

    def run(batches):
        tokens = load(byte_bpe, piece_model)
        for b in by_bytes(batches, 1, BYTES):
            rows = align(tokens.ids(b.column(1).to_pylist()), tokens)
            said = [(hashlib.sha256(r[4].encode()).hexdigest() if r[4] else "") if digest else r[4] for r in rows]
            raw = [pa.array([r[k].astype("<i8").tobytes() for r in rows], pa.binary()) for k in (5, 6)]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[k] for r in rows], pa.int64()) for k in range(4)), pa.array(said, pa.string()), *raw], names=[c.split()[0] for c in ROWS.split(", ")])

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text").mapInArrow(run, ROWS)


def pair_counts(aligned: DataFrame, wide: int) -> DataFrame:
    """(pair, count, best): how many rows hold the pair, and whether no other pair of its A id is held by more."""

    def counted(held):
        pair, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(pair), pa.array(n.astype(np.int64))], names=["pair", "n"])

    def run(batches):
        held, size = [], 0
        for b in batches:
            for raw in b.column(0).to_pylist():
                held.append(np.frombuffer(raw, "<i8"))
                size += len(held[-1])
                if size > GATHERED:
                    yield counted(held)
                    held, size = [], 0
        if size:
            yield counted(held)

    counts = aligned.select("pairs").mapInArrow(run, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("count"))
    counts = counts.withColumn("a", F.expr(f"pair div {wide}"))
    most = counts.groupBy("a").agg(F.max("count").alias("most"))
    return counts.join(most, "a").select("pair", "count", (F.col("count") == F.col("most")).alias("best"))


def link_counts(docs: DataFrame, byte_bpe: str, piece_model: str) -> DataFrame:
    """alignments() with digests, without pairs, and per row n_best (links whose pair's count is its A id's highest) and
    count_sum (sum over links of the pair's count)."""
    spark = docs.sparkSession
    with Scratch(spark) as s:
        rows = s.keep(alignments(docs, byte_bpe, piece_model, True).withColumn("row__", F.monotonically_increasing_id()))
        counts = s.keep(pair_counts(rows, _wide(piece_model)))
        slices = max(1, math.ceil(counts.count() / SLICE))
        sums = []
        for k in range(slices):
            own = counts.where(F.pmod(F.xxhash64("pair"), F.lit(slices)) == k).toArrow()
            sent = spark.sparkContext.broadcast(_lookup(own))
            part = rows.select("row__", "pairs", "times").mapInArrow(_summed(sent), "row__ bigint, n_best bigint, count_sum bigint")
            # a row's own sums where one slice holds all pairs; else they are added up
            sums.append(s.keep(part))
            sent.destroy()
        total = sums[0] if slices == 1 else _union(sums).groupBy("row__").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
        kept = ["doc_id", "n_a", "n_b", "n_groups", "n_links"]
        return s.result(rows.select("row__", *kept, F.col("groups").alias("groups_sha256")).join(total, "row__").select(*kept, "n_best", "count_sum", "groups_sha256"))


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def _lookup(counts: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    pair, count, best = (counts[c].to_numpy() for c in ("pair", "count", "best"))
    order = np.argsort(pair)
    return pair[order], count[order], best[order].astype(bool)


def _summed(sent):
    def run(batches):
        known, count, best = sent.value
        for b in batches:
            n_best, total = [], []
            for raw, often in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                pairs, times = np.frombuffer(raw, "<i8"), np.frombuffer(often, "<i8")
                at = np.searchsorted(known, pairs)
                there = at < len(known)
                there[there] = known[at[there]] == pairs[there]
                at, times = at[there], times[there]
                n_best.append(int(times[best[at]].sum()))
                total.append(int((times * count[at]).sum()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_best, pa.int64()), pa.array(total, pa.int64())], names=["row__", "n_best", "count_sum"])

    return run


@lru_cache(maxsize=2)
def _wide(piece_model: str) -> int:
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=piece_model).get_piece_size()


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    return link_counts(table(spark, sf_dir, "documents"), P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"))
