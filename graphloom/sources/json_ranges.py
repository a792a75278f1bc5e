"""JSON arrays of any size, read by byte ranges.

Spark's text source deals a file in ranges; with a comma as the separator, a range is a
run of pieces between commas. Whether a piece begins inside a string, and how deep, depends
on all ranges before it. So a first pass describes each range: for either state of
quotes at its begin the state at its end, the change of depth, and how many commas lie at which depth.
A fold over a file's ranges in order gives every range its begin (a row a range: of a
hundred terabytes in ranges of 128 MB less than a million, on the driver). A second
pass cuts the pieces at commas of depth one; records that don't lie in one batch of a range are put
together by their number.

Escapes don't cross a range: a backslash before a comma escapes the comma.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OPEN = r"^[\s\uFEFF]*\["
_QUOTE, _BACKSLASH, _COMMA = b'"'[0], b"\\"[0], b","[0]
_STEP = np.zeros(256, np.int64)
_STEP[list(b"[{")], _STEP[list(b"]}")] = 1, -1


def scan(raw: np.ndarray, quoted: bool) -> tuple[np.ndarray, np.ndarray]:
    """(inside a string behind each byte, change of depth from the first to behind each byte)."""
    at = np.arange(len(raw))
    plain = np.maximum.accumulate(np.where(raw != _BACKSLASH, at, -1))
    escaped = (at - 1 - np.concatenate([[-1], plain[:-1]])) % 2 == 1
    inside = (np.cumsum((raw == _QUOTE) & ~escaped) + quoted) % 2 == 1
    return inside, np.cumsum(np.where(inside, 0, _STEP[raw]))


def _runs(batches):
    """(file, start, bytes of the pieces, each with its comma) of a batch's pieces of one range."""
    for b in batches:
        keys, values = list(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)), b.column(2).to_pylist()
        cut = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
        for i, j in zip(cut[:-1], cut[1:], strict=True):
            if i < j:
                yield *keys[i], np.frombuffer((",".join(values[i:j]) + ",").encode(), np.uint8)


_DESCRIBED = "file string, start bigint, first string, quoted boolean, ends boolean, depth bigint, commas map<bigint, bigint>"
_MAP = pa.map_(pa.int64(), pa.int64())


def _describe(batches):
    """Two rows a range: its first character that isn't white space, quotes open at its begin or not, open at its end, the change of
    depth, commas by depth."""
    held = None

    def rows():
        return pa.RecordBatch.from_arrays([pa.array([x] * 2) for x in held[0]] + [pa.array([held[2]] * 2, pa.string()), pa.array([False, True]), pa.array([s[0] for s in held[1]]), pa.array([s[1] for s in held[1]], pa.int64()), pa.array([list(s[2].items()) for s in held[1]], _MAP)], names=[c.split()[0] for c in _DESCRIBED.split(", ", 6)])

    for file, start, raw in _runs(batches):
        if held is None or held[0] != (file, start):
            if held:
                yield rows()
            held = [(file, start), [[q, 0, Counter()] for q in (False, True)], None]
        held[2] = held[2] or (raw[:-1].tobytes().decode().strip().lstrip("\ufeff").lstrip()[:1] or None)
        for s in held[1]:
            inside, change = scan(raw, s[0])
            s[2].update((s[1] + change[(raw == _COMMA) & ~inside]).tolist())
            s[0], s[1] = bool(inside[-1]), s[1] + int(change[-1])
    if held:
        yield rows()


def _begins(described: list) -> tuple[dict, dict]:
    """(file, start) -> (quoted, depth, records that ended before), and of each file how many end by a comma."""
    begins, ended = {}, {}
    by_file: dict[str, dict[int, dict[bool, tuple]]] = {}
    for r in described:
        by_file.setdefault(r.file, {}).setdefault(r.start, {})[r.quoted] = r
    for file, ranges in by_file.items():
        # what is no array is one record: its own commas lie a level deeper
        first = next((r[False].first for _, r in sorted(ranges.items()) if r[False].first), None)
        quoted, depth, n = False, int(first != "["), 0
        for start in sorted(ranges):
            begins[file, start] = quoted, depth, n
            own = ranges[start][quoted]
            quoted, depth, n = own.ends, depth + own.depth, n + own.commas.get(1 - depth, 0)
        ended[file] = n
    return begins, ended


def _cut(begins, ended):
    """Pieces of records: the place of the piece in the file, whether it is all of its record, the last of the file."""

    def run(batches):
        key, part = None, 0
        for file, start, raw in _runs(batches):
            if key != (file, start):
                key, part = (file, start), 0
                quoted, depth, number = begins.value[key]
            inside, change = scan(raw, quoted)
            stops = np.flatnonzero((raw == _COMMA) & ~inside & (depth + change == 1))
            ends = np.append(stops, len(raw))
            begin = np.concatenate([[0], stops + 1])
            texts = [raw[i:j].tobytes().decode() for i, j in zip(begin.tolist(), ends.tolist(), strict=True)]
            n = number + np.arange(len(texts))
            whole = (np.arange(len(texts)) > 0) & (np.arange(len(texts)) < len(texts) - 1)
            same = lambda x, kind, texts=texts: pa.array([x] * len(texts), kind)
            yield pa.RecordBatch.from_arrays([same(file, pa.string()), same(start, pa.int64()), same(part, pa.int64()), pa.array(n, pa.int64()), pa.array(whole), pa.array(n == ended.value[file]), pa.array(texts, pa.string())], names=["file", "start", "part", "number", "whole", "last", "text"])
            quoted, depth, number, part = bool(inside[-1]), depth + int(change[-1]), number + len(stops), part + 1

    return run


def records(spark: SparkSession, path: str) -> DataFrame:
    """(file, number, text): the elements of each file's array, in order; of a file that holds no array its text."""
    pieces = spark.read.option("lineSep", ",").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")
    begins, ended = (spark.sparkContext.broadcast(x) for x in _begins(pieces.mapInArrow(_describe, _DESCRIBED).collect()))
    cut = pieces.mapInArrow(_cut(begins, ended), "file string, start bigint, part bigint, number bigint, whole boolean, last boolean, text string")
    parts = cut.where("not whole").groupBy("file", "number").agg(F.max("last").alias("last"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "part", "text"))), lambda x: x["text"]), "").alias("text"))
    both = cut.where("whole").select("file", "number", "last", "text").unionByName(parts)
    # the array's own brackets, and the comma that stands for the end of the file
    array = (F.col("number") > 0) | F.col("text").rlike(_OPEN)
    opened = F.when(F.col("number") == 0, F.regexp_replace("text", _OPEN, "")).otherwise(F.col("text"))
    ended = F.regexp_replace(opened, ",$", "")
    closed = F.when(F.col("last"), F.when(array, F.regexp_replace(ended, r"\]\s*$", "")).otherwise(ended)).otherwise(opened)
    return both.select("file", "number", closed.alias("text")).where(F.col("text").rlike(r"\S"))
