"""Byte-pair merges of many words at once, for a lower-casing byte-level vocabulary with word ends.

All words of about a length are rows of a matrix. A round merges the pair of lowest rank
of every row (the first of equal ones), as the library does word by word; rows
without a pair that merges are done. What the matrix isn't for goes to the library:
parts with characters outside ASCII and the letters of Latin-1, which need its
normaliser and pattern, parts that may hold a special token, and very long words."""

from __future__ import annotations

import json
import re

import numpy as np

#: Widths of the matrices; longer words are the library's.
WIDTHS = (6, 9, 12, 16, 24, 40)
#: Words of a matrix.
ROWS = 1 << 15
_LETTERS = "a-zß-öø-ÿ"
_PLAIN = f"!-;=-{{}}~\n\t\r A-ZÀ-ÖØ-Þ{_LETTERS}"
#: What isn't plain: other characters, and those that special tokens begin with.
_ODD = re.compile(f"[^{_PLAIN}]")
#: The tokenizer's own pattern for plain lower-case text (fixed value, but for the classes).
_WORDS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^\\s{_LETTERS}0-9]+")
#: Marks a part that the library encodes.
_MARK = "\0"
_NONE = np.int64(1 << 60)


def byte_chars() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary: printable ones for themselves, others from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


def units(text: str) -> list[str]:
    """Words of a text; a part between spaces that isn't plain is one, marked."""
    if not _ODD.search(text):
        return _WORDS.findall(text.lower())
    out = []
    for part in text.split(" "):
        out += [_MARK + part] if _ODD.search(part) else _WORDS.findall(part.lower())
    return out


class WordMerges:
    def __init__(self, tokenizer):
        model = json.loads(tokenizer.to_str())["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"]
        self.tokenizer = tokenizer
        chars = sorted(byte_chars().items(), key=lambda x: x[1])
        self.inner = np.array([vocab[c] for c, _ in chars], np.int64)
        self.last = np.array([vocab[c + end] for c, _ in chars], np.int64)
        pairs = [x.split(" ") if isinstance(x, str) else x for x in model["merges"]]
        key = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(key)
        self.key, self.rank = key[order], order
        self.new = np.array([vocab[a + b] for a, b in pairs], np.int64)

    def __call__(self, words: list[str]) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        """For Parts: ids of words and marked parts."""
        raw = [w.encode() for w in words]
        size = np.array([len(r) for r in raw])
        theirs = [i for i, w in enumerate(words) if w[:1] == _MARK or len(raw[i]) > WIDTHS[-1] or not w]
        found = []  # (words, ids in rows, -1 behind the last)
        for i in range(0, len(theirs), 4096):
            own = theirs[i : i + 4096]
            ids = [e.ids for e in self.tokenizer.encode_batch_fast([words[k].removeprefix(_MARK) for k in own], add_special_tokens=False)]
            found += [(np.array([k]), np.array([x], np.int64)) for k, x in zip(own, ids, strict=True)]
        ours = np.ones(len(words), bool)
        ours[theirs] = False
        low = 0
        for width in WIDTHS:
            at = np.flatnonzero(ours & (size > low) & (size <= width))
            for i in range(0, len(at), ROWS):
                found += self._merged(at[i : i + ROWS], raw, size, width)
            low = width
        count = np.zeros(len(words), np.int64)
        for at, m in found:
            count[at] = (m >= 0).sum(axis=1)
        first, out = np.cumsum(count) - count, np.zeros(int(count.sum()), np.int64)
        for at, m in found:
            row, place = np.nonzero(m >= 0)
            out[first[at][row] + place] = m[row, place]
        return np.ones(len(words), bool), [(out, count)]

    def _merged(self, at: np.ndarray, raw: list[bytes], size: np.ndarray, width: int):
        flat = np.frombuffer(b"".join(raw[k] for k in at.tolist()), np.uint8)
        n = size[at]
        there = np.arange(width) < n[:, None]
        m = np.full((len(at), width), -1, np.int64)
        m[there] = self.inner[flat]
        rows = np.arange(len(at))
        m[rows, n - 1] = self.last[flat[np.cumsum(n) - 1]]
        ranks = self._ranks(m[:, :-1], m[:, 1:])
        while len(m):
            pos = ranks.argmin(axis=1) if ranks.shape[1] else np.zeros(len(m), np.int64)
            best = ranks[np.arange(len(m)), pos] if ranks.shape[1] else np.full(len(m), _NONE)
            done = best == _NONE
            if done.any():
                yield at[done], m[done]
                at, m, ranks, pos, best = (x[~done] for x in (at, m, ranks, pos, best))
                if not len(m):
                    return
            line, w = np.arange(len(m)), m.shape[1]
            m[line, pos] = self.new[best]
            m = m[np.arange(w) != pos[:, None] + 1].reshape(len(m), w - 1)
            ranks = ranks[np.arange(w - 1) != pos[:, None]].reshape(len(m), w - 2)
            left, right = np.flatnonzero(pos > 0), np.flatnonzero(pos < w - 2)
            ranks[left, pos[left] - 1] = self._ranks(m[left, pos[left] - 1], m[left, pos[left]])
            ranks[right, pos[right]] = self._ranks(m[right, pos[right]], m[right, pos[right] + 1])

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where((self.key[at] == key) & (b >= 0), self.rank[at], _NONE)
