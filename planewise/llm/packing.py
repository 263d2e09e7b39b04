"""Best-fit packing planned on a histogram of lengths.

Token counts, not documents, are packed: the driver gets one count for each length up
to the capacity and runs best-fit decreasing over whole groups of equal bins.  The plan
says, for each length, which ranks go to which bins at which offset; documents then
take their slots by joining on their rank within their length.
"""

from __future__ import annotations

import os
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planewise.llm.chunks import ChunkCache
from planewise.llm.common import by_batch, cut, gapless_rank, slices, spread

CAPACITY = 2048
END_ID = 0


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts: rows (length, first rank, items, items a bin, first bin, offset).

    The item of rank ``first rank + k`` goes to bin ``first bin + k // items a bin`` at
    ``offset + k % items a bin * length``.  Bins in equal state are one group; a length
    splits two groups at most, so groups and rows are bounded by a small multiple of
    the capacity whatever the counts are.
    """
    groups: dict[int, list[tuple[int, int]]] = {r: [] for r in range(capacity + 1)}  # room left: (first bin, bins)
    rows, bins = [], 0
    for length in sorted((x for x, n in counts.items() if n), reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"length {length} doesn't fit {capacity}")
        left, rank = counts[length], 0
        while left:
            room = next((r for r in range(length, capacity) if groups[r]), capacity)
            each = room // length
            if room == capacity:
                first, n = bins, -(-left // each)
                bins += n
            else:
                first, n = groups[room].pop()
            full = min(n, left // each)
            if full:
                rows.append((length, rank, full * each, each, first, capacity - room))
                groups[room - each * length].append((first, full))
                left, rank = left - full * each, rank + full * each
            if full < n and left:
                rows.append((length, rank, left, left, first + full, capacity - room))
                groups[room - left * length].append((first + full, 1))
                left, rank, full = 0, rank + left, full + 1
            if full < n:
                groups[room].append((first + full, n - full))
    return rows


@lru_cache(maxsize=2)
def _cache(path: str) -> ChunkCache:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    return ChunkCache(lambda chunks: [e.ids for e in tokenizer.encode_batch_fast(chunks, add_special_tokens=False)])


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): ids of each whole text and the end id, cut where longer than the capacity.

    All pieces but the first have the full length.  A null text is empty: its one id is the end id.
    """

    def make(c: dict) -> dict:
        cache, texts = _cache(path), [t or "" for t in c["text"].to_pylist()]
        where, piece, start, length, crc, held = [], [], [], [], [], []
        for a, b in slices(texts):
            flat, offsets, _ = cache.batch(texts[a:b])
            for i in range(b - a):
                ids = np.append(flat[offsets[i] : offsets[i + 1]], np.int32(end_id)).astype("<u4")
                at, k = 0, 0
                while at < len(ids):
                    n = (len(ids) - at) % capacity or capacity
                    where.append(a + i)
                    piece.append(k)
                    start.append(at)
                    length.append(n)
                    crc.append(zlib.crc32(ids[at : at + n].tobytes()))
                    if with_ids:
                        held.append(ids[at : at + n].astype(np.int32))
                    at, k = at + n, k + 1
        out = {"doc_id": c["doc_id"].take(pa.array(where, pa.int64())), "piece": piece, "start": start, "length": length, "ids_crc32": crc}
        return out | ({"ids": held} if with_ids else {})

    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return by_batch(spread(read), "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids, make)


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Sequence and offset of every piece of ``docs`` (doc_id, text).

    Sequences are numbered from 0 and filled without gaps.  Repeated rows are packed
    each on its own; a null doc_id is kept; an empty table packs nothing; further
    columns of ``docs`` aren't read.
    """
    cut_up = cut(pieces(docs, path, capacity, end_id, with_ids))
    counts = {r["length"]: r["n"] for r in cut_up.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a length
    rows = plan(counts, capacity)
    slots = cut_up.sparkSession.createDataFrame(rows, "length long, first_rank long, items long, each long, first_bin long, base long")
    ranked = gapless_rank(cut_up, "length", "doc_id", "rank", ("piece",))
    k = F.col("rank") - F.col("first_rank")
    # The plan has a few rows a length, whatever the number of documents.
    placed = ranked.join(F.broadcast(slots), (ranked["length"] == slots["length"]) & (F.col("rank") >= F.col("first_rank")) & (F.col("rank") < F.col("first_rank") + F.col("items"))).drop(slots["length"])
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("first_bin") + F.floor(k / F.col("each"))).cast("long").alias("sequence_id"),
        (F.col("base") + k % F.col("each") * F.col("length")).cast("long").alias("offset"),
        *(["ids"] if with_ids else []),
    )
