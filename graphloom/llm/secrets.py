"""Operator 7: secret scan by keyword prefilter, anchored expressions and checksums.

One Aho-Corasick pass over the lower-cased bytes of a text finds every keyword.
An expression is tried only where its keyword stands, anchored there. Tokens of
formats that embed a CRC-32 (base 62, last six characters) count only if the
checksum holds. Hexadecimal runs have no keyword and are searched directly.

Kinds of span: assign, access, hex (the base rules) and checked (tokens with a
valid embedded checksum, in addition). Spans are code-point offsets, end exclusive.

Defined results: null text = empty text = no spans, base_sha256 that of the empty
string. Repeated rows give repeated rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._spark import by_bytes, small_batches, table, texts

KINDS = ("assign", "access", "hex", "checked")
ASSIGN = re.compile(rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]{24,}")
#: prefix, 30 characters, six characters of checksum; not inside a longer word
CHECKED = re.compile(rb"(?:gh[pousr]|npm)_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
#: keyword -> kind (fixed values)
KEYWORDS = {"password": 0, "passwd": 0, "secret": 0, "token": 0, "apikey": 0, "api_key": 0, "akia": 1, "ghp_": 3, "gho_": 3, "ghu_": 3, "ghs_": 3, "ghr_": 3, "npm_": 3}
BASE62 = b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


@lru_cache(maxsize=1)
def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for word, kind in KEYWORDS.items():
        a.add_word(word, (len(word), kind))
    a.make_automaton()
    return a


def checksum(entropy: bytes) -> bytes:
    """CRC-32 of the random part in six base-62 digits."""
    n, out = zlib.crc32(entropy), bytearray()
    for _ in range(6):
        n, r = divmod(n, 62)
        out.append(BASE62[r])
    return bytes(out[::-1])


def find(raw: bytes) -> list[tuple[int, int, int]]:
    """(start, kind, end) by start, then kind; offsets in code points."""
    out: list[tuple[int, int, int]] = []
    done = [0, 0, 0, 0]  # for each kind, the end of the last match
    for last, (length, kind) in _automaton().iter(raw.lower().decode("latin-1")):
        start = last + 1 - length
        if start < done[kind]:
            continue
        m = (ASSIGN, ACCESS, None, CHECKED)[kind].match(raw, start)
        if not m:
            continue
        if kind == 0:
            good = m.end(2) - m.start(2) >= 6
        elif kind == 1:
            good = m.end() - start >= 20
        else:
            good = m[2] == checksum(m[1]) and not raw[start - 1 : start].isalnum()
            if not good:
                continue
        done[kind] = m.end()
        if good:
            out.append((start, kind, m.end()))
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(raw)]
    out.sort()
    if out and not raw.isascii():
        places = sorted({p for s, _, e in out for p in (s, e)})
        at, before, chars = {}, 0, 0
        for p in places:  # a character starts at every byte that isn't a continuation
            chars += len(raw[before:p].decode("utf-8", "replace"))
            at[p], before = chars, p
        out = [(at[s], k, at[e]) for s, k, e in out]
    return out


def digest(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans array<struct<kind, start, end>>) per row."""
    small_batches(docs.sparkSession)
    schema = "doc_id bigint, spans array<struct<kind: string, start: bigint, end: bigint>>"
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for b in by_bytes(batches, 1):
            found = [[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in find(t)] for t in texts(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, kind)], names=["doc_id", "spans"])

    return docs.selectExpr(f"cast(`{id_col}` as bigint) doc_id", f"cast(`{text_col}` as string) text").mapInArrow(run, schema)


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """The same rows and columns, with every span of the text replaced by the mark. Null texts stay null."""
    from pyspark.sql.functions import arrow_udf

    small_batches(docs.sparkSession)

    @arrow_udf("string")
    def clean(column: pa.Array) -> pa.Array:
        out = []
        for text in column.to_pylist():
            parts, at = [], 0
            for s, _, e in find(text.encode()) if text else ():
                if e <= at:
                    continue
                if s >= at:
                    parts += [text[at:s], mark]
                at = e
            out.append("".join(parts) + text[at:] if parts else text)
        return pa.array(out, pa.string())

    return docs.withColumn(text_col, clean(F.col(f"`{text_col}`").cast("string")))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = scan(table(spark, sf_dir, "documents"))
    text = lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])
    n = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    base = F.concat_ws(",", F.transform(F.filter("spans", lambda x: x["kind"] != "checked"), text))
    return spans.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(base, 256).alias("base_sha256"), F.concat_ws(",", F.transform("spans", text)).alias("spans"))
