"""Token ids of whole texts through a cache of space-led chunks.

A text is cut before each space that a non-space character follows, never before one
that ends the text.  The splitting pattern of the byte-level vocabularies joins such a
space to what follows it and to nothing before it, so a chunk's ids don't depend on its
neighbours, and the ids of a text are those of its chunks in order.  Natural text repeats its words: each distinct
chunk is encoded once and then looked up.
"""

from __future__ import annotations

import gc
import re
from collections.abc import Callable
from itertools import chain

import numpy as np

_SPACE_THEN_SPACE = re.compile(r" (?:\s|\Z)")
_CUT = re.compile(r" (?=\S)")

#: Characters of distinct chunks that a worker keeps before it starts anew.
CACHE_CHARS = 6_000_000


class _Index(dict):
    """Chunk key to its number; unknown keys are numbered and noted."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        self.new.append(key)
        return n


class ChunkCache:
    """``encode`` turns a list of chunks into a list of id lists, each without regard to the others."""

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], decimals: bool = False) -> None:
        self.encode, self.with_decimals = encode, decimals
        self.reset()

    def reset(self) -> None:
        self.index, self.chars = _Index(), 0
        self.flat = np.empty(0, np.int32)
        self.starts = np.empty(0, np.int64)
        self.lengths = np.empty(0, np.int64)
        self.decimals: list[str] = []

    @staticmethod
    def keys(text: str) -> list[str]:
        """Chunks without their leading space; the first, which has none, is marked by one."""
        words = _CUT.split(text) if _SPACE_THEN_SPACE.search(text) else text.split(" ")
        if words[0]:
            words[0] = " " + words[0]
        else:
            del words[0]
        return words

    def batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[list[int]]]:
        """All ids in one array, where each text's ids begin (one more at the end), and each text's chunk numbers."""
        gc.disable()  # many small lists and no cycles: collections would only walk the cache again and again
        try:
            return self._batch(texts)
        finally:
            gc.enable()

    def _batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[list[int]]]:
        if self.chars > CACHE_CHARS:
            self.reset()
        number = self.index.__getitem__
        numbers = [list(map(number, self.keys(t))) if t else [] for t in texts]
        if new := self.index.new:
            chunks = [k[1:] if k[:1] == " " else " " + k for k in new]
            ids = self.encode(chunks)
            counts = np.fromiter(map(len, ids), np.int64, len(ids))
            added = np.fromiter(chain.from_iterable(ids), np.int32, int(counts.sum()))
            first = len(self.flat)
            self.flat = np.concatenate([self.flat, added])
            self.starts = np.concatenate([self.starts, first + np.cumsum(counts) - counts])
            self.lengths = np.concatenate([self.lengths, counts])
            if self.with_decimals:
                self.decimals += [",".join(map(str, row)) for row in ids]
            self.chars += sum(map(len, new))
            self.index.new = []
        sizes = np.fromiter(map(len, numbers), np.int64, len(numbers))
        which = np.fromiter(chain.from_iterable(numbers), np.int64, int(sizes.sum()))
        lengths = self.lengths[which]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        at = np.arange(total) + np.repeat(self.starts[which] - ends + lengths, lengths)
        offsets = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(sizes)])]
        return self.flat[at], offsets, numbers
