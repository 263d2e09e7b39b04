"""Byte-level BPE encoding and decoding by padded numpy matrices.

Distinct pieces are bucketed by length, each bucket a matrix of token ids padded with
-1.  In a round every row merges its leftmost pair of minimum rank; pair ranks come
from an open-addressing hash table over all splits of every vocabulary entry, and the
row is compacted by one place.  Rows without a mergeable pair leave the matrix.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from functools import lru_cache

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planewise.llm.chunks import ChunkCache
from planewise.llm.common import by_batch, slices, spread

NONE = np.iinfo(np.int32).max
#: Longer pieces take the heap path: a matrix would give them as many rounds as bytes, each over the whole row.
MATRIX_BYTES = 256
#: Cells of one matrix.
MATRIX_CELLS = 4_000_000
#: Distinct pieces that a worker keeps besides the chunks.
PIECES_KEPT = 500_000
_MIX = np.uint64(0x9E3779B97F4A7C15)


class Vocabulary:
    """Ranks of a ``.tiktoken`` file with the pair table and the decoding table."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        size = max(self.ranks.values()) + 1
        entries = [b""] * size
        for token, rank in self.ranks.items():
            entries[rank] = token
        self.entries = entries
        self.lengths = np.array([len(t) for t in entries], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.blob = np.frombuffer(b"".join(entries), np.uint8)
        pairs = [(left << 32 | right, rank) for token, rank in self.ranks.items() for k in range(1, len(token)) if (left := self.ranks.get(token[:k])) is not None and (right := self.ranks.get(token[k:])) is not None]
        self._fill(np.array([p for p, _ in pairs], np.uint64), np.array([r for _, r in pairs], np.int32))

    def _fill(self, keys: np.ndarray, ranks: np.ndarray) -> None:
        bits = max(4, int(len(keys) * 4).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.table_keys = np.full(1 << bits, np.uint64(2**64 - 1), np.uint64)
        self.table_ranks = np.full(1 << bits, NONE, np.int32)
        slot = (keys * _MIX >> self.shift).astype(np.int64)
        left = np.arange(len(keys))
        while len(left):
            free = self.table_keys[slot[left]] == np.uint64(2**64 - 1)
            at, first = np.unique(slot[left[free]], return_index=True)
            placed = left[free][first]
            self.table_keys[at], self.table_ranks[at] = keys[placed], ranks[placed]
            left = np.setdiff1d(left, placed)
            taken = self.table_keys[slot[left]] != keys[left]
            slot[left[taken]] = slot[left[taken]] + 1 & self.mask
            left = left[taken]

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair's joined bytes, ``NONE`` where no entry has them or an id is padding."""
        keys = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)
        slot = (keys * _MIX >> self.shift).astype(np.int64)
        held = self.table_keys[slot]
        out = np.where((held == keys) & (left >= 0) & (right >= 0), self.table_ranks[slot], NONE)
        open_ = np.flatnonzero((held != keys) & (held != np.uint64(2**64 - 1)) & (left >= 0) & (right >= 0))
        while len(open_):
            slot[open_] = slot[open_] + 1 & self.mask
            held = self.table_keys[slot[open_]]
            hit = held == keys[open_]
            out[open_[hit]] = self.table_ranks[slot[open_[hit]]]
            open_ = open_[~hit & (held != np.uint64(2**64 - 1))]
        return out

    def encode_pieces(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of each piece: the whole piece's rank if it has one, else by merges."""
        out: list[list[int]] = [[]] * len(pieces)
        buckets: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            if (rank := self.ranks.get(p)) is not None:
                out[i] = [rank]
            elif len(p) > MATRIX_BYTES:
                out[i] = self._merge_long(p)
            elif p:
                buckets.setdefault((len(p) - 1).bit_length(), []).append(i)
        for power, rows in buckets.items():
            step = max(1, MATRIX_CELLS >> power)
            for k in range(0, len(rows), step):
                self._merge_matrix([pieces[i] for i in rows[k : k + step]], rows[k : k + step], out)
        return out

    def _merge_matrix(self, pieces: list[bytes], where: list[int], out: list[list[int]]) -> None:
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        width = int(lengths.max())
        ids = np.full((len(pieces), width), -1, np.int32)
        ids[np.arange(width) < lengths[:, None]] = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        ranks = np.full(ids.shape, NONE, np.int32)
        if width > 1:
            ranks[:, :-1] = self.pair_ranks(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(pieces), -1)
        rows = np.array(where)
        columns = np.arange(width)
        while len(rows):
            at = ranks.argmin(axis=1)  # the leftmost of the least
            each = np.arange(len(rows))
            done = ranks[each, at] == NONE
            if done.any():
                for i in np.flatnonzero(done):
                    row = ids[i]
                    out[rows[i]] = row[row >= 0].tolist()
                ids, ranks, rows, at = ids[~done], ranks[~done], rows[~done], at[~done]
                each = np.arange(len(rows))
                if not len(rows):
                    break
            ids[each, at] = ranks[each, at]
            source = np.minimum(columns + (columns > at[:, None]), width - 1)
            ids, ranks = np.take_along_axis(ids, source, 1), np.take_along_axis(ranks, source, 1)
            ids[:, -1], ranks[:, -1] = -1, NONE
            right = np.where(at + 1 < width, ids[each, np.minimum(at + 1, width - 1)], -1)
            ranks[each, at] = self.pair_ranks(ids[each, at], right)
            inner = at > 0
            ranks[each[inner], at[inner] - 1] = self.pair_ranks(ids[each[inner], at[inner] - 1], ids[each[inner], at[inner]])

    def _merge_long(self, piece: bytes) -> list[int]:
        """The same merges by a heap of (rank, place) over a linked list."""
        ids = self.byte_ids[np.frombuffer(piece, np.uint8)]
        n = len(ids)
        first = self.pair_ranks(ids[:-1], ids[1:])
        heap = [(int(first[k]), k) for k in np.flatnonzero(first != NONE)]
        heapq.heapify(heap)
        spans: list[int] = list(range(1, n + 1))  # where the token that starts here ends
        before = list(range(-1, n - 1))
        live = [True] * n
        now = [int(r) for r in first] + [NONE]

        def rank(k: int) -> int:
            return self.ranks.get(piece[k : spans[spans[k]]], NONE) if spans[k] < n else NONE

        while heap:
            r, k = heapq.heappop(heap)
            if not live[k] or now[k] != r:
                continue
            gone = spans[k]
            live[gone] = False
            spans[k] = spans[gone]
            if spans[k] < n:
                before[spans[k]] = k
            for place in (k, before[k]):
                if place >= 0:
                    now[place] = rank(place)
                    if now[place] != NONE:
                        heapq.heappush(heap, (now[place], place))
        return [self.ranks[piece[k : spans[k]]] for k in range(n) if live[k]]

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all ids in one array, and where each id's bytes end."""
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        return self.blob[np.arange(total) + np.repeat(self.starts[ids] - ends + lengths, lengths)], ends


@lru_cache(maxsize=2)
def cache_of(path: str, pattern: str) -> tuple[Vocabulary, ChunkCache]:
    """One vocabulary and cache for each Python worker."""
    vocabulary, split = Vocabulary(path), regex.compile(pattern)

    known: dict[str, list[int]] = {}

    def encode(chunks: list[str]) -> list[list[int]]:
        if len(known) > PIECES_KEPT:
            known.clear()
        findall = split.findall
        # Letters alone, with or without the space before them, are one match of the pattern.
        pieces = [(c,) if c.isalpha() or c[:1] == " " and c[1:].isalpha() else findall(c) for c in chunks]
        new = list({p for row in pieces for p in row if p not in known})
        known.update(zip(new, vocabulary.encode_pieces([p.encode() for p in new]), strict=True))
        return [known[row[0]] if len(row) == 1 else [x for p in row for x in known[p]] for row in pieces]

    return vocabulary, ChunkCache(encode, decimals=True)


def encode_column(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids): ids of each whole text; a null text gives no ids."""

    def make(c: dict) -> dict:
        _, cache = cache_of(path, pattern)
        texts, rows = [t or "" for t in c["text"].to_pylist()], []
        for a, b in slices(texts):
            ids, offsets, _ = cache.batch(texts[a:b])
            rows += [ids[offsets[i] : offsets[i + 1]] for i in range(b - a)]
        return {"doc_id": c["doc_id"], "ids": rows}

    return by_batch(spread(_read(docs)), "doc_id long, ids array<int>", make)


def decode_column(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, text_bytes): the bytes of each row's ids; null ids give null."""

    def make(c: dict) -> dict:
        vocabulary, _ = cache_of(path, pattern)
        rows = c["ids"].to_pylist()
        return {"doc_id": c["doc_id"], "text_bytes": [None if r is None else vocabulary.decode(np.array(r, np.int64))[0].tobytes() for r in rows]}

    return by_batch(encoded.select("doc_id", "ids"), "doc_id long, text_bytes binary", make)


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Encode every whole text, decode the ids, and digest both.

    Null and empty texts have no ids and digest the empty string.  Rows are
    independent: repeated rows give equal rows, an empty table gives none, further
    columns aren't read.
    """

    def make(c: dict) -> dict:
        vocabulary, cache = cache_of(path, pattern)
        texts = [t or "" for t in c["text"].to_pylist()]
        counts, id_digests, byte_digests = [], [], []
        for a, b in slices(texts):
            ids, offsets, numbers = cache.batch(texts[a:b])
            data, ends = vocabulary.decode(ids)
            at = np.concatenate([[0], ends])[offsets]
            decimal = cache.decimals.__getitem__
            for i in range(b - a):
                counts.append(int(offsets[i + 1] - offsets[i]))
                id_digests.append(hashlib.sha256(",".join(map(decimal, numbers[i])).encode()).hexdigest())
                byte_digests.append(hashlib.sha256(data[at[i] : at[i + 1]]).hexdigest())
        return {"doc_id": c["doc_id"], "n_tokens": counts, "ids_sha256": id_digests, "decoded_sha256": byte_digests}

    return by_batch(spread(_read(docs)), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", make)


def _read(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
