"""Token ids of many texts: each distinct part between spaces is encoded once."""

from __future__ import annotations

import re
from collections.abc import Callable
from itertools import chain, islice

import numpy as np

#: Parts that a worker remembers from one batch to the next.
MOST = 400_000
#: Characters of which none is white space by any definition; others may be.
_SOLID = "!-~¡-ʯ"
_OPEN = re.compile(f"(?:[^{_SOLID}]|^) ")
_ENDS = re.compile(f"[{_SOLID}]\\Z")


def runs(text: str) -> list[str]:
    """Parts that together, with a space between them, are the text; a part may begin with more spaces, and a space that
    comes after white space, or what may be such, is inside a part."""
    parts = text.split(" ")
    if not _OPEN.search(text):
        return parts
    out = [parts[0]]
    for p in parts[1:]:
        if _ENDS.search(out[-1]):
            out.append(p)
        else:
            out[-1] += " " + p
    return out


def ends_solid(part: str) -> bool:
    """Whether a part may be cut from what follows a space behind it."""
    return _ENDS.search(part) is not None


class _Numbers(dict):
    """Numbers its keys in the order in which they are first asked for."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


def flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """(numbers of all lists, length of each)."""
    return np.fromiter(chain.from_iterable(lists), np.int64), np.fromiter(map(len, lists), np.int64, len(lists))


class Parts:
    """Token ids of texts from those of their parts. encode(parts) gives whether each part can be encoded (a flag each), and
    by tokenizer (ids, how many of each part). Parts that came before aren't encoded again, as long as there are few."""

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]], tokenizers: int = 1, most: int = MOST):
        self.encode, self.tokenizers, self.most = encode, tokenizers, most
        self._forget()

    def _forget(self) -> None:
        self.known = _Numbers()
        self.ok = np.zeros(0, bool)
        self.ids = [np.zeros(0, np.int64)] * self.tokenizers
        self.first = [np.zeros(1, np.int64)] * self.tokenizers

    def __call__(self, texts: list[list[str]]) -> tuple[np.ndarray, list[list[np.ndarray]]]:
        """(whether all parts of a text could be encoded, by tokenizer the ids of each text); texts are lists of parts."""
        if not texts:
            return np.zeros(0, bool), [[] for _ in range(self.tokenizers)]
        if len(self.known) > self.most:
            self._forget()
        before = len(self.known)
        at = np.fromiter(map(self.known.__getitem__, chain.from_iterable(texts)), np.int64)
        if len(self.known) > before:
            ok, found = self.encode(list(islice(self.known, before, None)))
            self.ok = np.concatenate([self.ok, ok])
            for k, (ids, size) in enumerate(found):
                self.ids[k] = np.concatenate([self.ids[k], ids])
                self.first[k] = np.concatenate([self.first[k], self.first[k][-1] + np.cumsum(size)])
        ends = np.concatenate([[0], np.cumsum([len(parts) for parts in texts], dtype=np.int64)])
        bad = np.concatenate([[0], np.cumsum(~self.ok[at])])
        out = []
        for ids, first in zip(self.ids, self.first, strict=True):
            size = first[at + 1] - first[at]
            until = np.concatenate([[0], np.cumsum(size)])
            own = ids[np.arange(until[-1]) + np.repeat(first[at] - until[:-1], size)]
            out.append(np.split(own, until[ends[1:-1]]))
        return bad[ends[1:]] == bad[ends[:-1]], out
