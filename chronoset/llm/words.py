"""Words of whole texts as numbers: each distinct word of a task is looked at once."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


class _Index(dict):
    """Numbers for words in the order in which they come; ``new`` holds those that were not asked for before."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list = []

    def __missing__(self, word) -> int:
        self[word] = n = len(self)
        self.new.append(word)
        return n


class WordTable:
    """Rows of numbers for words, made by ``make(list of new words)`` and kept up to about ``limit`` words a task."""

    def __init__(self, make: Callable[[list], np.ndarray], limit: int = 100_000):
        self.make, self.limit = make, limit
        self.index = _Index()
        self.rows: np.ndarray | None = None
        self.used = 0

    def ids(self, words: list) -> np.ndarray:
        """The rows of the words; :attr:`rows` holds their numbers until the next call."""
        if len(self.index) > self.limit:
            self.index, self.used = _Index(), 0
        found = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))
        if new := self.index.new:
            made = self.make(new)
            if self.rows is None or self.used + len(new) > len(self.rows):
                grown = np.zeros((max(int(1.5 * (self.used + len(new))), 1024), *made.shape[1:]), made.dtype)
                if self.rows is not None:
                    grown[: self.used] = self.rows[: self.used]
                self.rows = grown
            self.rows[self.used : self.used + len(new)] = made
            self.used += len(new)
            self.index.new = []
        return found


def pieces(counts: np.ndarray) -> np.ndarray:
    """The start of each run, for runs of the given lengths one after the other."""
    return np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int64) if len(counts) else np.zeros(0, np.int64)


def sum_runs(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums over runs of the given lengths; an empty run sums to 0."""
    out = np.zeros((len(counts), *values.shape[1:]), values.dtype)
    full = np.nonzero(counts)[0]
    if len(full):
        out[full] = np.add.reduceat(values, pieces(counts)[full], axis=0)
    return out


def portions(texts: list, most_chars: int = 300_000, sizes: bool = False):
    """(start, end) of consecutive texts with about ``most_chars`` characters, so that memory follows texts, not batches.

    With ``sizes`` the numbers of characters are given in place of texts.
    """
    start = held = 0
    for i, t in enumerate(texts):
        held += (t or 0) if sizes else len(t) if t else 0
        if held >= most_chars:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(texts):
        yield start, len(texts)
