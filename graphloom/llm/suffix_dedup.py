"""Operator 4: removal of repeated passages by longest-previous-factor arrays.

A byte goes if a string of LENGTH bytes that covers it also starts earlier (in a
document of smaller id, or earlier in the same one): if the longest previous factor
at the string's place reaches LENGTH.

To spread this over a cluster, every string of LENGTH bytes is filed under its
anchor: the GRAM-byte substring of smallest hash in it. Equal strings have equal
anchors at equal offsets. One document's consecutive strings of one anchor are a
row: anchor hash, two hashes of the stretch that they span, place.
 - Rows that agree in the anchor and in both stretch hashes (128 bits of two unlike
   families, so at 1e13 stretches the chance of one false agreement is under 1e-12)
   are equal stretches: all but the first go. Each task does that for its own rows
   before anything is shuffled.
 - Anchors with several different stretches: their stretches (under 2 * LENGTH bytes
   each) are cut from the texts and brought together by anchor. Their suffixes are
   sorted, and one scan in suffix order finds each suffix's previous and next smaller
   position and so the longest previous factor (previous_factors), as far as LENGTH:
   more isn't needed, as the next string tells about the next byte.
An anchor that is in very many different stretches (over CROWD rows) isn't
brought together: its strings are filed one by one under two hashes of their own
(128 bits), each task those that it doesn't know to be repeats, and sorted; all but
the first of a hash go.

Order of documents: doc_id, nulls last; rows that share an id and differ in text
are told apart and ordered by a 64-bit hash of the text; rows that share both
are one document, and each gets its result. Null and empty texts have no bytes.
Texts under LENGTH bytes lose nothing. An empty table gives none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import Scratch, _lengths, by_bytes, flat_binary, flat_utf8, maybe_in, small_batches, table
from ._words import mix

LENGTH = 100
GRAM = 24
#: Strings in a stretch at most: those that can share one anchor.
SPAN = LENGTH - GRAM + 1
CROWD = 20_000
#: Rows that a task combines at a time, bytes of stretches that it sorts at a time, and bytes of text in one piece.
ROWS, BYTES, PIECE = 1 << 18, 1 << 20, 1 << 20
_U = np.uint64
_CODE = mix(np.arange(1, 257, dtype=np.uint64) * _U(0xA24BAED4963EE407))
_B = 0x9FB21C651E98DF25
_INV = pow(_B, -1, 1 << 64)
_pow = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_pow[0]) < n:
        m = 2 * n
        _pow[:] = [np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(m, _U(b)))]) for b in (_B, _INV)]
    return _pow[0], _pow[1]


def prefix_hashes(flat: np.ndarray) -> np.ndarray:
    """h[j] - h[i], times the inverse power of i, is the hash of flat[i:j]."""
    out = np.zeros(len(flat) + 1, np.uint64)
    np.cumsum(_CODE[flat] * _powers(len(flat))[0][: len(flat)], out=out[1:])
    return out


def _hash(prefix: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    return mix((prefix[stop] - prefix[start]) * _powers(len(prefix))[1][start] + (stop - start).astype(np.uint64) * _U(0x9E3779B97F4A7C15))


def window_sums(flat: np.ndarray) -> np.ndarray:
    """h[j - 7] - h[i] is the sum of the mixed 8-byte windows of flat[i:j]: a hash unlike that of prefix_hashes."""
    n = max(0, len(flat) - 7)
    word = np.zeros(n, np.uint64)
    for k in range(8):
        word |= flat[k : k + n].astype(np.uint64) << _U(8 * k)
    out = np.zeros(n + 1, np.uint64)
    np.cumsum(mix(word * _U(0xD6E8FEB86659FD93) + _U(1)), out=out[1:])
    return out


def stretches(flat: np.ndarray, offsets: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """(anchor hash, two stretch hashes, document's place, first string's start, anchor - start, strings - 1) of texts in one buffer."""
    n = len(flat)
    none = tuple(np.zeros(0, t) for t in (np.int64,) * 7)
    if n < length:
        return none
    prefix = prefix_hashes(flat)
    grams = _hash(prefix, np.arange(n - GRAM + 1), np.arange(GRAM, n + 1))
    # the smallest 32 bits of hash, leftmost first: the place is in the low bits
    low = (grams & _U(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    width = 1
    while 2 * width <= SPAN:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    rest = SPAN - width
    low = np.minimum(low[: len(low) - rest], low[rest:]) if rest else low
    anchor = (low & _U(0xFFFFFFFF)).astype(np.int64)  # for the string at each place
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(anchor)]
    places = np.flatnonzero(np.arange(len(anchor)) + length <= offsets[1:][doc])
    if not len(places):
        return none
    new = np.ones(len(places), bool)
    new[1:] = (anchor[places[1:]] != anchor[places[:-1]]) | (doc[places[1:]] != doc[places[:-1]])
    begin = np.flatnonzero(new)
    first, last = places[begin], places[np.append(begin[1:], len(places)) - 1]
    a, d = anchor[first], doc[first]
    whole, other = _two(prefix, window_sums(flat), first, last + length)
    side = mix((a - first).astype(np.uint64))
    return grams[a].view(np.int64), (whole ^ side).view(np.int64), other.view(np.int64), d, first - offsets[d], a - first, last - first


def _two(prefix: np.ndarray, sums: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return _hash(prefix, start, stop), mix(sums[stop - 7] - sums[start])


def suffix_order(flat: np.ndarray, starts: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Order of the suffixes at starts by their first `length` bytes, ties by place; and the bytes that
    each, in that order, has in common with the one before it, `length` at most."""
    rows = np.lib.stride_tricks.sliding_window_view(flat, length)[starts]
    pad = -length % 8
    words = np.ascontiguousarray(np.pad(rows, ((0, 0), (0, pad)))).view(">u8").astype(np.uint64)
    order = np.lexsort(words.T[::-1])
    differs = words[order[1:]] != words[order[:-1]]
    at = np.where(differs.any(axis=1), differs.argmax(axis=1), words.shape[1])
    common = np.zeros(len(starts), np.int64)
    # whole words in common, and of the first that differs the bytes before its highest bit
    k = np.minimum(at, words.shape[1] - 1)
    x = words[order[1:], k] ^ words[order[:-1], k]
    lead = np.zeros(len(x), np.int64)
    for byte in range(1, 8):
        lead += (x >> _U(64 - 8 * byte)) == 0
    common[1:] = np.minimum(length, 8 * at + np.where(at < words.shape[1], lead, 0))
    return order, common


def previous_factors(order: list[int], common: list[int]) -> list[int]:
    """Longest previous factors: suffix order and common prefixes of neighbours -> by rank, the longest prefix that the
    suffix shares with one at a smaller place. That is with the previous or the next smaller place in suffix order; one
    scan with a stack finds both and the shortest common prefix on the way."""
    out = [0] * len(order)
    stack: list[tuple[int, int]] = []  # (rank, common with the rank below in the stack)
    for rank, place in enumerate(order):
        shared = common[rank]
        while stack and order[stack[-1][0]] > place:  # its next smaller place is this one
            r, below = stack.pop()
            if shared > out[r]:
                out[r] = shared
            if below < shared:
                shared = below
        if stack:  # its previous smaller place
            out[rank] = shared
        stack.append((rank, shared))
    return out


def repeats(flat: np.ndarray, starts: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """For starts in rising order of document and place: is the longest previous factor there at least `length`?
    Only ranks that have `length` bytes in common with a neighbour can reach it; the scan goes over those."""
    order, common = suffix_order(flat, starts, length)
    whole = common == length
    some = np.flatnonzero(whole | np.append(whole[1:], False))
    out = np.zeros(len(starts), bool)
    factors = previous_factors(order[some].tolist(), np.where(whole[some], length, 0).tolist())
    out[order[some]] = np.array(factors, np.int64) >= length
    return out


def longest_previous_factor(text: bytes) -> list[int]:
    """LPF array of one text: for each place, the longest string there that also starts earlier."""
    flat = np.frombuffer(text + bytes(len(text)), np.uint8)  # suffixes are cut by their length below
    order, common = suffix_order(flat, np.arange(len(text)), max(1, len(text)))
    places = order.tolist()
    ends = [len(text) - i for i in places]
    common = [min(c, a, b) for c, a, b in zip(common.tolist(), ends, [0, *ends], strict=False)]
    out = [0] * len(text)
    for place, x in zip(places, previous_factors(places, common), strict=True):
        out[place] = x
    return out


# A row's place in one number: start of the first string, anchor - start, strings - 1; DONE: a range of known repeats.
DONE = 1 << 62
_START = (1 << 46) - 1


def _pack(start: np.ndarray, a: np.ndarray, more: np.ndarray) -> np.ndarray:
    return (start << 14) | (a << 7) | more


def _unpack(p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return (p >> 14) & _START, (p >> 7) & 127, p & 127


_ROW = ["h", "w", "x", "doc_id", "th", "p"]
_NULL_LAST = np.iinfo(np.int64).max


def _batch(names: list[str], *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) if not isinstance(c, pa.Array) else c for c in columns], names=names)


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before it in any column."""
    out = np.ones(len(columns[0]), bool)
    out[1:] = False
    for c in columns:
        out[1:] |= c[1:] != c[:-1]
    return out


def _combine(h, w, x, doc, th, p):
    """Rows of a task: the first of each equal stretch stays as it is. The others are repeats already; neighbours
    among them become one range: w is then its end, h only spreads the rows."""
    order = np.lexsort((p, th, doc, x, w, h))
    h, w, x, doc, th, p = (c[order] for c in (h, w, x, doc, th, p))
    again = ~_changes(h, w, x) & _changes(doc, th, p)
    d, t, q = doc[again], th[again], p[again]
    order = np.lexsort((q, t, d))
    d, t, q = d[order], t[order], q[order]
    start, _, more = _unpack(q)
    end = start + more + LENGTH
    new = _changes(d, t)
    new[1:] |= start[1:] > end[:-1]
    begin = np.flatnonzero(new)
    end = end[np.append(begin[1:], len(d)) - 1] if len(d) else end
    d, t, q = d[begin], t[begin], q[begin]
    spread = mix(q.view(np.uint64) ^ mix(d.view(np.uint64) ^ t.view(np.uint64))).view(np.int64)
    first = ~again
    return tuple(np.concatenate(c) for c in ((h[first], spread), (w[first], end), (x[first], np.zeros_like(d)), (doc[first], d), (th[first], t), (p[first], q | DONE)))


def _file_rows(docs: DataFrame) -> DataFrame:
    """(h, w, x, doc_id, th, p) of every stretch, and ranges known to be repeats within their task."""

    def run(batches):
        held: list[tuple[np.ndarray, ...]] = []
        count = 0
        for b in by_bytes(batches, 2, PIECE):
            ids = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            th = b.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            flat, offsets = flat_utf8(b.column(2))
            for piece, at, which, base in _pieces(flat, offsets):
                h, w, x, d, s, a, more = stretches(piece, at)
                if len(h):
                    held.append((h, w, x, ids[which[d]], th[which[d]], _pack(s + base[d], a, more)))
                    count += len(h)
            if count >= ROWS:
                rows = [np.concatenate(c) for c in zip(*held, strict=True)]
                held, count = [], 0
                yield _batch(_ROW, *_combine(*rows))
        if count:
            yield _batch(_ROW, *_combine(*(np.concatenate(c) for c in zip(*held, strict=True))))

    return docs.select("doc_id", "th", "text").mapInArrow(run, ", ".join(f"{c} bigint" for c in _ROW))


def _pieces(flat: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """A batch in pieces of about PIECE bytes: (bytes, offsets, documents' places, where each begins in its document).
    Longer documents are cut with LENGTH - 1 bytes in common, so each string is whole in one piece."""
    i, n = 0, len(offsets) - 1
    while i < n:
        size = int(offsets[i + 1] - offsets[i])
        if size > PIECE:
            for a in range(0, size - LENGTH + 1, PIECE):
                b = min(size, a + PIECE + LENGTH - 1)
                yield flat[offsets[i] + a : offsets[i] + b], np.array([0, b - a]), np.array([i]), np.array([a])
            i += 1
            continue
        j = i + 1
        while j < n and offsets[j + 1] - offsets[i] <= PIECE:
            j += 1
        yield flat[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], np.arange(i, j), np.zeros(j - i, np.int64)
        i = j


def _sift(rows: DataFrame) -> DataFrame:
    """Rows sorted by (h, w, x, doc_id, th, p) -> (state, h, doc_id, th, p): 1 a repeat, 2 to be compared by suffix
    order, 3 a known range that ends at h. Holds what one anchor's rows need: the last row, and the one that waits for a
    second stretch."""
    names = ["state", "h", "doc_id", "th", "p"]

    def run(batches):
        last = None  # the last row
        waiting = None  # h, doc, th, p of the only first so far of the last anchor
        for b in batches:
            all_ = [c.to_numpy() for c in b.columns]
            done = (all_[5] & DONE) != 0
            if done.any():
                yield _batch(names, np.full(int(done.sum()), 3, np.int32), all_[1][done], all_[3][done], all_[4][done], all_[5][done] & ~DONE)
            h, w, x, doc, th, p = (c[~done] for c in all_)
            if not len(h):
                continue
            # differs from the row before: in the anchor, in the stretch, in the place
            one = lambda c, i: np.concatenate([c[:1] if last is None else [last[i]], c])  # noqa: B023, E731
            new_h, new_w, new_p = _changes(one(h, 0))[1:], _changes(one(w, 1), one(x, 2))[1:], _changes(one(doc, 3), one(th, 4), one(p, 5))[1:]
            if last is None:
                new_h[0] = True
            first = new_h | new_w
            repeat = ~first & new_p  # else the same row again: a repeated document
            # a first is compared if its anchor has another: before it, or after it
            group = np.cumsum(new_h)
            firsts = np.bincount(group, first, minlength=int(group[-1]) + 1)
            compare = first & (firsts[group] > 1)
            head = []
            if not new_h[0]:  # the anchor began in an earlier batch
                more = first & (group == group[0])
                compare |= more
                if waiting is not None and more.any():
                    head, waiting = [waiting], None
            if new_h.any():
                f = np.flatnonzero(first & (group == group[-1]))
                waiting = (h[f[0]], doc[f[0]], th[f[0]], p[f[0]]) if len(f) == 1 else None
            last = (h[-1], w[-1], x[-1], doc[-1], th[-1], p[-1])
            state = np.where(repeat, 1, np.where(compare, 2, 0))
            keep = np.flatnonzero(state)
            front = np.array(head, np.int64).reshape(-1, 4)
            yield _batch(names, np.concatenate([np.full(len(head), 2), state[keep]]).astype(np.int32), *(np.concatenate([front[:, i], c[keep]]) for i, c in enumerate((h, doc, th, p))))

    return rows.mapInArrow(run, "state int, h bigint, doc_id bigint, th bigint, p bigint")


def _cut(asked: DataFrame) -> DataFrame:
    """(doc_id, th, text, q array<struct<h, p>>) -> (h, doc_id, th, p, raw): the stretches themselves."""
    names = ["h", "doc_id", "th", "p", "raw"]

    def run(batches):
        for b in by_bytes(batches, 2, PIECE):
            rows: list[tuple] = []
            for doc, th, text, q in zip(*(c.to_pylist() for c in b.columns), strict=True):
                raw = text.encode()
                for x in q:
                    start, more = (x["p"] >> 14) & _START, x["p"] & 127
                    rows.append((x["h"], doc, th, x["p"], raw[start : start + more + LENGTH]))
            for i in range(0, len(rows), 20_000):
                yield _batch(names, *(pa.array(c, pa.int64() if k < 4 else pa.binary()) for k, c in enumerate(zip(*rows[i : i + 20_000], strict=True))))

    return asked.mapInArrow(run, "h bigint, doc_id bigint, th bigint, p bigint, raw binary")


def _compare(cut: DataFrame) -> DataFrame:
    """Stretches sorted by (h, doc_id, th, p) -> (doc_id, th, s, e): bytes to remove. Whole anchors at a time."""

    def run(batches):
        def flush(parts):
            h, doc, th, p = (np.concatenate([b.column(i).to_numpy() for b in parts]) for i in range(4))
            one = _changes(h, doc, th, p)  # a repeated document's stretches stand side by side
            both = [flat_binary(b.column(4)) for b in parts]
            flat = np.concatenate([x for x, _ in both])
            length = np.concatenate([np.diff(x) for _, x in both])
            base = (np.cumsum(length) - length)[one]
            doc, th, p, length = (c[one] for c in (doc, th, p, length))
            count = length - LENGTH + 1  # strings in each
            row = np.repeat(np.arange(len(length)), count)
            k = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            again = repeats(flat, base[row] + k)
            r, a, z = _runs(row[again], k[again])
            s = _unpack(p)[0][r]
            return _batch(["doc_id", "th", "s", "e"], doc[r], th[r], s + a, s + z + LENGTH)

        held: list[pa.RecordBatch] = []
        size = 0
        for b in by_bytes(batches, 4, BYTES):
            h = b.column(0).to_numpy()
            if held and size >= BYTES:  # cut where the last anchor ends
                same = h == held[-1].column(0)[-1].as_py()
                n = int(same.sum())
                if n < len(b):
                    yield flush([*held, b.slice(0, n)] if n else held)
                    held, size, b = [], 0, b.slice(n)
            held.append(b)
            size += int(_lengths(b.column(4)).sum())
        if held:
            yield flush(held)

    return cut.mapInArrow(run, "doc_id bigint, th bigint, s bigint, e bigint")


def _runs(row: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Strings that are repeats -> maximal runs of neighbours in a row: (row, first start, last start)."""
    if not len(row):
        return row, start, start
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (start[1:] != start[:-1] + 1)
    begin = np.flatnonzero(new)
    return row[begin], start[begin], start[np.append(begin[1:], len(row)) - 1]


def _strings(cut: DataFrame) -> DataFrame:
    """Stretches -> (key, other, doc_id, th, s, known): one row per string, under two hashes of its own. For anchors of
    very many stretches. What a task has twice it knows to be a repeat."""
    names = ["key", "other", "doc_id", "th", "s", "known"]

    def run(batches):
        def flush(held):
            key, other, doc, th, s = (np.concatenate(c) for c in zip(*held, strict=True))
            order = np.lexsort((s, th, doc, other, key))
            key, other, doc, th, s = (c[order] for c in (key, other, doc, th, s))
            again = ~_changes(key, other) & _changes(doc, th, s)
            key[again] = mix(s[again].view(np.uint64) ^ mix(doc[again].view(np.uint64) ^ th[again].view(np.uint64))).view(np.int64)  # spread
            # of neighbouring repeats one row in LENGTH covers the same bytes, with the last of a run
            keep = ~again
            at = np.flatnonzero(again)
            at = at[np.lexsort((s[at], th[at], doc[at]))]
            if len(at):
                new = _changes(doc[at], th[at])
                new[1:] |= s[at[1:]] != s[at[:-1]] + 1
                begin = np.flatnonzero(new)
                k = np.arange(len(at)) - begin[np.cumsum(new) - 1]
                keep[at[(k % LENGTH == 0) | np.append(new[1:], True)]] = True
            return _batch(names, *(c[keep] for c in (key, other, doc, th, s)), again[keep])

        held, count = [], 0
        for b in by_bytes(batches, 4, PIECE):
            flat, offsets = flat_binary(b.column(4))
            n = np.diff(offsets) - LENGTH + 1
            row = np.repeat(np.arange(len(b)), n)
            k = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            start = offsets[:-1][row] + k
            key, other = _two(prefix_hashes(flat), window_sums(flat), start, start + LENGTH)
            doc, th, p = (b.column(i).to_numpy()[row] for i in (1, 2, 3))
            held.append((key.view(np.int64), other.view(np.int64), doc, th, _unpack(p)[0] + k))
            count += len(row)
            if count >= ROWS:
                out, held, count = held, [], 0
                yield flush(out)
        if held:
            yield flush(held)

    return cut.mapInArrow(run, "key bigint, other bigint, doc_id bigint, th bigint, s bigint, known boolean")


def _later(strings: DataFrame) -> DataFrame:
    """Strings sorted by (key, other, doc_id, th, s) -> (doc_id, th, s, e) of all but the first of each pair of hashes."""

    def run(batches):
        last = None
        for b in batches:
            key, other, doc, th, s = columns = [b.column(i).to_numpy() for i in range(5)]
            if not len(key):
                continue
            key, other, doc, th, s = (np.concatenate([c[:1] if last is None else [last[i]], c]) for i, c in enumerate(columns))
            again = (~_changes(key, other) & _changes(doc, th, s))[1:]
            last = [c[-1] for c in columns]
            again |= b.column(5).to_numpy(zero_copy_only=False)
            doc, th, s = (c[again] for c in columns[2:])
            yield _batch(["doc_id", "th", "s", "e"], doc, th, s, s + LENGTH)

    return strings.mapInArrow(run, "doc_id bigint, th bigint, s bigint, e bigint")


def _apply(rows: DataFrame) -> DataFrame:
    """(doc_id, text, spans array<struct<s, e>>) -> the result and the text that is left."""
    schema = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"

    def run(batches):
        sha = hashlib.sha256
        for b in by_bytes(batches, 1):
            n, gone, spans, digest = [], [], [], []
            for text, found in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                raw = (text or "").encode()
                left, removed, count = cut_spans(raw, [(x["s"], x["e"]) for x in found or ()])
                n.append(len(raw))
                gone.append(removed)
                spans.append(count)
                digest.append(sha(left).hexdigest())
            yield _batch(["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"], b.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(spans, pa.int64()), pa.array(digest, pa.string()))

    return rows.mapInArrow(run, schema)


def cut_spans(raw: bytes, spans: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """(bytes left, bytes removed, maximal removed runs)."""
    parts, at, count, end = [], 0, 0, -1
    for s, e in sorted(spans):
        if s > end:  # not even touching: a new run
            if count:
                at = end
            parts.append(raw[at:s])
            count, end = count + 1, e
        else:
            end = max(end, e)
    parts.append(raw[end if count else 0 :])
    left = b"".join(parts)
    return left, len(raw) - len(left), count


def removed_spans(docs: DataFrame, s: Scratch) -> DataFrame:
    """docs (doc_id, th, text) -> (doc_id, th, s, e): byte ranges to remove, not merged."""
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # deal the rows by anchor; equal rows of a task are marked before
    sifted = s.keep(_sift(_file_rows(docs).repartition(n, "h").sortWithinPartitions(*_ROW)))
    start = "(p >> 14)"
    known = sifted.where("state = 1").selectExpr("doc_id", "th", f"{start} s", f"{start} + (p & 127) + {LENGTH} e")
    known = known.unionByName(sifted.where("state = 3").selectExpr("doc_id", "th", f"{start} s", "h e"))
    asked = s.keep(sifted.where("state = 2").select("h", "doc_id", "th", "p").distinct())
    crowded = s.keep(asked.groupBy("h").count().where(F.col("count") > CROWD).select("h"))
    if crowded.isEmpty():
        return known.unionByName(s.keep(_compare(_sorted(_ask(docs, asked), n))))
    compared = s.keep(_compare(_sorted(_ask(docs, asked.join(crowded, "h", "left_anti")), n)))
    strings = _strings(_ask(docs, asked.join(crowded, "h", "left_semi")))
    later = s.keep(_later(strings.repartition(n, "key", "other").sortWithinPartitions("key", "other", "doc_id", "th", "s")))
    return known.unionByName(compared).unionByName(later)


def _doc() -> Column:
    return F.xxhash64("doc_id", "th")


def _ask(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """The stretches asked for, cut from the texts: a document's list is bounded by its length. Documents that aren't
    asked aren't shuffled, as far as a Bloom filter can tell them."""
    by_doc = asked.groupBy("doc_id", "th").agg(F.collect_list(F.struct("h", "p")).alias("q"))
    ids = asked.select("doc_id", "th").distinct()
    maybe = maybe_in(ids.select(_doc().alias("h")), ids.count())
    # equal rows are one document: `asked` is distinct, so what they give twice falls together in the sort and changes nothing
    return _cut(docs.where(maybe(_doc())).join(by_doc.hint("shuffle_hash"), ["doc_id", "th"]).select("doc_id", "th", "text", "q"))


def _sorted(cut: DataFrame, n: int) -> DataFrame:
    return cut.repartition(n, "h").sortWithinPartitions("h", "doc_id", "th", "p")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) per row."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    own = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("bigint"), F.lit(_NULL_LAST)).alias("doc_id"), text.alias("text")).withColumn("th", F.xxhash64("text")).select("doc_id", "th", "text")
    with Scratch(docs.sparkSession) as s:
        spans = s.result(removed_spans(own, s).groupBy("doc_id", "th").agg(F.collect_list(F.struct("s", "e")).alias("spans")))
        maybe = maybe_in(spans.select(_doc().alias("h")), spans.count())
    # texts that lose nothing stay where they are
    small_batches(docs.sparkSession)
    own = own.withColumn("maybe", maybe(_doc()))
    some = own.where("maybe").join(spans.hint("shuffle_hash"), ["doc_id", "th"], "left").select("doc_id", "text", "spans")
    none = own.where("not maybe").select("doc_id", "text", F.lit(None).cast("array<struct<s: bigint, e: bigint>>").alias("spans"))
    return _apply(none.unionByName(some)).withColumn("doc_id", F.nullif("doc_id", F.lit(_NULL_LAST)))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents"))
