"""Operator 3: exact BPE encoding and decoding of a SentencePiece model by backtracking.

Instead of replaying merges with a priority queue, the encoder walks left to
right. At each place it takes the longest piece that an Aho-Corasick scan found
there, and accepts it if merging the last accepted piece with it gives back the
same two pieces. If no length fits, the place is marked as failed in a bitfield
and the walk steps back. A sequence of pieces of which every adjacent pair
survives re-merging is the one that the merge rules give, so the ids equal the
library's.

No piece holds a space mark after another character, so a text falls into
chunks (space marks and a word, or a run of punctuation) that are encoded apart and memoised.

Defined results: null text = empty text = no ids, decoded to ''. Repeated rows
give repeated rows; no row depends on another. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ._spark import by_bytes, small_batches, table

MARK = "▁"
#: Chunks in each of a worker's two memo generations; bounds its memory. More where only digests leave the worker: some 250
#: bytes each.
MEMO_CHUNKS, DIGEST_CHUNKS = 80_000, 240_000
#: Bytes of text that are encoded at a time.
BYTES = 1 << 20
#: Longer chunks are encoded without memoising.
MEMO_CHARS = 40
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _varint(b: bytes, i: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        x = b[i]
        i += 1
        value |= (x & 127) << shift
        if x < 128:
            return value, i
        shift += 7


def _fields(b: bytes) -> Iterator[tuple[int, object]]:
    """(field number, value) of a protocol buffer message."""
    i = 0
    while i < len(b):
        key, i = _varint(b, i)
        kind = key & 7
        if kind == 0:
            value, i = _varint(b, i)
        elif kind == 2:
            n, i = _varint(b, i)
            value, i = b[i : i + n], i + n
        else:
            n = 8 if kind == 1 else 4
            value, i = b[i : i + n], i + n
        yield key >> 3, value


class PieceModel:
    """Vocabulary of a SentencePiece BPE model with byte fallback and the identity normaliser."""

    def __init__(self, raw: bytes, chunks: int = MEMO_CHUNKS):
        self.most = chunks
        self.pieces: list[str] = []
        self.kinds: list[int] = []
        scores: list[float] = []
        self.dummy_prefix, trim, charsmap, model_type = True, True, b"", 1
        for field, value in _fields(raw):
            if field == 1:
                x = dict(_fields(value))
                self.pieces.append(x[1].decode())
                scores.append(struct.unpack("<f", x.get(2, b"\0\0\0\0"))[0])
                self.kinds.append(x.get(3, NORMAL))
            elif field == 2:
                model_type = dict(_fields(value)).get(3, 1)
            elif field == 3:
                x = dict(_fields(value))
                charsmap, self.dummy_prefix, trim = x.get(2, b""), bool(x.get(3, 1)), bool(x.get(4, 1))
        if model_type != 2 or charsmap or trim or USER in self.kinds or self.kinds.count(BYTE) != 256:
            raise ValueError("only BPE models with identity normalisation, kept spaces, byte fallback and no user-defined pieces")
        normal = [i for i, k in enumerate(self.kinds) if k == NORMAL]
        self.score = {self.pieces[i]: scores[i] for i in normal}
        self.id = {self.pieces[i]: i for i in normal}
        self.byte_id = [0] * 256
        for i, k in enumerate(self.kinds):
            if k == BYTE:
                self.byte_id[int(self.pieces[i][3:5], 16)] = i
        self.byte_of = {i: v for v, i in enumerate(self.byte_id)}
        if any(MARK in p.lstrip(MARK) for p in self.score):
            raise ValueError("a piece holds a space mark after another character")
        self.chars = {p for p in self.score if len(p) == 1}
        #: pieces that merging their own characters gives; others never come out
        self.reachable = {p for p in self.score if self.merge(p) == [p]}
        self.lengths = ahocorasick.Automaton()
        for p in self.reachable:
            self.lengths.add_word(p[::-1], len(p))
        self.lengths.make_automaton()
        self.pairs: dict[tuple[str, str], bool] = {}
        self.chunks = re.compile(self._chunk_pattern())
        self.known = re.compile("[" + re.escape("".join(sorted(self.chars))) + "]+|(?s:.)")
        self.memo: dict[str, tuple[str, str]] = {}
        self.older: dict[str, tuple[str, str]] = {}

    def _chunk_pattern(self) -> str:
        """Cuts only where no piece can reach across: before space marks, around line ends, and
        after a run of Latin letters if no piece holds one of them before the next character."""
        pairs = {(p[i], p[i + 1]) for p in self.score for i in range(len(p) - 1)}
        latin = [c for c in map(chr, range(0x180)) if c.isalpha()]
        after = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and not any((x, c) in pairs for x in latin))
        line = "".join(c for c in "\n\t\r" if not any(c in p for p in self.score))
        first = f"{MARK}*[{''.join(latin)}]++(?=[{re.escape(after)}])|" if after else ""
        return first + f"{MARK}*[^{MARK}{line}]+|{MARK}+" + (f"|[{line}]+" if line else "")

    def merge(self, text: str) -> list[str]:
        """Merge adjacent symbols by the best score, leftmost first. Quadratic: for short strings."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = score.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _fit(self, a: str, b: str) -> bool:
        if len(self.pairs) > 500_000:
            self.pairs.clear()
        fits = self.pairs[a, b] = self.merge(a + b) == [a, b]
        return fits

    def walk(self, text: str) -> list[str]:
        """Pieces of a text whose characters are all in the vocabulary."""
        n = len(text)
        if n == 1 or text in self.reachable:
            return [text]
        starts: list[list[int]] = [[] for _ in range(n)]  # lengths of the pieces that start here
        for end, length in self.lengths.iter(text[::-1]):  # the longest first at each end
            starts[n - 1 - end].append(length)
        failed = bytearray(n + 1)
        out: list[str] = []
        tried: list[int] = []  # for each accepted piece, its place in starts
        pos, k, last, known = 0, 0, None, self.pairs.get
        while pos < n:
            options = starts[pos]
            while k < len(options):
                end = pos + options[k]
                if not failed[end]:
                    piece = text[pos:end]
                    if last is None:
                        break
                    if (fits := known((last, piece))) is None:
                        fits = self._fit(last, piece)
                    if fits:
                        break
                k += 1
            else:
                failed[pos] = 1
                pos -= len(out.pop())
                k, last = tried.pop() + 1, out[-1] if out else None
                continue
            out.append(last := piece)
            tried.append(k)
            pos, k = end, 0
        return out

    def chunk_ids(self, chunk: str) -> list[int]:
        ids: list[int] = []
        for run in self.known.findall(chunk):
            if run[0] in self.chars:
                ids += [self.id[p] for p in self.walk(run)]
            else:
                ids += [self.byte_id[x] for x in run.encode()]
        return ids

    def _new(self, chunk: str) -> tuple[str, str]:
        if (value := self.older.get(chunk)) is None:
            ids = self.chunk_ids(chunk)
            value = ",".join(map(str, ids)), self._text(ids)
        if len(chunk) <= MEMO_CHARS:
            if len(self.memo) >= self.most:  # what isn't used again goes with the older half
                self.older, self.memo = self.memo, {}
            self.memo[chunk] = value
        return value

    def _normal(self, text: str) -> str:
        return (MARK * self.dummy_prefix + text.replace(" ", MARK)) if text else ""

    def encode(self, text: str) -> list[int]:
        return [i for c in self.chunks.findall(self._normal(text)) for i in self.chunk_ids(c)]

    def _text(self, ids: list[int]) -> str:
        out, raw = [], bytearray()
        for i in ids:
            if (x := self.byte_of.get(i)) is not None:
                raw.append(x)
                continue
            if raw:
                out.append(self._raw(raw))
                raw = bytearray()
            out.append("" if self.kinds[i] == CONTROL else " ⁇ " if self.kinds[i] == UNKNOWN else self.pieces[i].replace(MARK, " "))
        return "".join(out) + (self._raw(raw) if raw else "")

    @staticmethod
    def _raw(raw: bytearray) -> str:
        """Bytes to text; every byte outside a valid sequence becomes one replacement character."""
        out, i, raw = [], 0, bytes(raw)
        while i < len(raw):
            for n in (1, 2, 3, 4):
                try:
                    out.append(raw[i : i + n].decode())
                    i += n
                    break
                except UnicodeDecodeError:
                    continue
            else:
                out.append("�")
                i += 1
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        """Text of any id sequence; the dummy prefix's space goes."""
        ids = list(ids)
        while ids and self.kinds[ids[0]] == CONTROL:
            ids.pop(0)
        text = self._text(ids)
        cut = self.dummy_prefix and ids and self.kinds[ids[0]] == NORMAL and text.startswith(" ")
        return text[1:] if cut else text

    def encode_decode(self, text: str) -> tuple[str, str]:
        """(decimal ids joined by commas, text decoded from them), by memoised chunks."""
        if not text:
            return "", ""
        get, new = self.memo.get, self._new
        both = [get(c) or new(c) for c in self.chunks.findall(self._normal(text))]
        decoded = "".join([x[1] for x in both])
        if self.dummy_prefix:  # the first piece starts with the space mark of the dummy prefix
            decoded = decoded[1:]
        return ",".join([x[0] for x in both]), decoded


@lru_cache(maxsize=2)
def load(path: str, chunks: int = MEMO_CHUNKS) -> PieceModel:
    with open(path, "rb") as f:
        return PieceModel(f.read(), chunks)


def encode_table(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids as decimal string, n_tokens, decoded) per row; the operator's real output."""
    small_batches(docs.sparkSession)

    def run(batches):
        model = load(model_path)
        for b in by_bytes(batches, 1, BYTES):
            both = [model.encode_decode(t or "") for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([x[0] for x in both], pa.string()), pa.array([x[0].count(",") + bool(x[0]) for x in both], pa.int64()), pa.array([x[1] for x in both], pa.string())],
                names=["doc_id", "ids", "n_tokens", "decoded"],
            )

    return docs.selectExpr(f"cast(`{id_col}` as bigint) doc_id", f"cast(`{text_col}` as string) text").mapInArrow(run, "doc_id bigint, ids string, n_tokens bigint, decoded string")


def digest_table(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """encode_table() with SHA-256 digests in place of ids and texts, so that nothing wide leaves the worker."""
    small_batches(docs.sparkSession)

    def run(batches):
        model, sha = load(model_path, DIGEST_CHUNKS), hashlib.sha256
        for b in by_bytes(batches, 1, BYTES):
            n, ids, text = [], [], []
            for t in b.column(1).to_pylist():
                i, d = model.encode_decode(t or "")
                n.append(i.count(",") + bool(i))
                ids.append(sha(i.encode()).hexdigest())
                text.append(sha(d.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(text, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.selectExpr(f"cast(`{id_col}` as bigint) doc_id", f"cast(`{text_col}` as string) text").mapInArrow(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_table(table(spark, sf_dir, "documents"), default_model())
