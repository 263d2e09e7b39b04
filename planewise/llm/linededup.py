"""Line dedup by probing a sharded minimal perfect hash.

Long lines that stand in many documents are boilerplate.  Their keys are hashed to 128
bits and aggregated to distinct hashes with the number of documents and the largest
doc_id of each.  Those are stored in shards: each shard is a minimal perfect hash (a
pilot value for each small bucket that sends its keys to free places) over compact
arrays of fingerprints, document counts and largest doc_ids.  Documents probe the arrays
of all shards, and a line's count there decides whether it goes; lines are never joined.
A hash that one document alone holds isn't stored: to be in no array means one document.
Where the arrays are larger than a broadcast may be, hashes (not texts) of lines, written
once, are sent to the shards and only hits come back.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from planewise.llm.common import cut, parts, slices, spread

MIN_CHARS = 40
MIN_DOCS = 5
#: Keys of one shard, on average.
SHARD_KEYS = 50_000
#: Mean keys of a bucket that shares a pilot, and how full a table is (1: minimal).
BUCKET_KEYS = 4
#: Bytes of arrays that are broadcast at most, and of a key in them: fingerprint 8, count 4, doc_id 8, its part of a pilot 1, rounded up.
BROADCAST_BYTES = 64 << 20
KEY_BYTES = 24
#: Hashes that one task of the sharded way probes, about.
PROBE_ROWS = 500_000
STRIP = " \t\n\v\f\r"

_UPPER = {c: c + 32 for c in range(65, 91)}
_HAS_UPPER = re.compile("[A-Z]")


def key_of(line: str) -> str:
    """The line stripped of ASCII white space with A-Z lower-cased."""
    key = line.strip(STRIP)
    return key.translate(_UPPER) if _HAS_UPPER.search(key) else key


def line_hashes(text: str | None, min_chars: int = MIN_CHARS) -> tuple[list[str], list[bytes | None]]:
    """Lines of a text, and for each the 16-byte hash of its key, None if the key is short."""
    lines = (text or "").split("\n")
    return lines, [xxhash.xxh3_128_digest(k.encode()) if len(line) >= min_chars and len(k := key_of(line)) >= min_chars else None for line in lines]


class PerfectHash:
    """Minimal perfect hash of distinct 16-byte hashes with a fingerprint and values for each."""

    def __init__(self, pilots: np.ndarray, marks: np.ndarray, counts: np.ndarray, largest: np.ndarray) -> None:
        self.pilots, self.marks, self.counts, self.largest = pilots, marks, counts, largest

    @staticmethod
    def place(high: np.ndarray, pilot: np.ndarray, size: int) -> np.ndarray:
        x = high ^ pilot * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
        return ((x ^ x >> np.uint64(32)) % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, high: np.ndarray, low: np.ndarray, counts: np.ndarray, largest: np.ndarray) -> PerfectHash:
        """``high`` and ``low``: the halves of the hashes; the high one finds the place, the low one is the fingerprint."""
        n = len(high)
        buckets = max(1, -(-n // BUCKET_KEYS))
        bucket = (low % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        bounds = np.searchsorted(bucket[order], np.arange(buckets + 1))
        taken, pilots = np.zeros(n, bool), np.zeros(buckets, np.uint32)
        where = np.empty(n, np.int64)
        for b in np.argsort(bounds[:-1] - bounds[1:], kind="stable"):  # the fullest first
            keys = order[bounds[b] : bounds[b + 1]]
            if not len(keys):
                break
            first = 0
            while True:
                tries = np.arange(first, first + (16 if first < 64 else 1024), dtype=np.uint64)
                spots = cls.place(high[keys][None, :], tries[:, None], n)
                fits = ~taken[spots].any(axis=1)
                if len(keys) > 1:
                    s = np.sort(spots, axis=1)
                    fits &= (s[:, 1:] != s[:, :-1]).all(axis=1)
                if fits.any():
                    k = int(fits.argmax())
                    break
                first += len(tries)
                if first >= 1 << 32:
                    raise ValueError("two keys share a hash")
            pilots[b] = first + k
            where[keys] = spots[k]
            taken[spots[k]] = True
        out = [np.empty(n, a.dtype) for a in (low, counts, largest)]
        for to, a in zip(out, (low, counts, largest), strict=True):
            to[where] = a
        return cls(pilots, *out)

    def probe(self, high: np.ndarray, low: np.ndarray) -> np.ndarray:
        """The place of each hash, -1 where the fingerprint is another's."""
        if not len(self.marks):
            return np.full(len(high), -1)
        at = self.place(high, self.pilots[(low % np.uint64(len(self.pilots))).astype(np.int64)].astype(np.uint64), len(self.marks))
        return np.where(self.marks[at] == low, at, -1)


def halves(hashes: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    pairs = np.frombuffer(b"".join(hashes), "<u8").reshape(-1, 2)
    return pairs[:, 0], pairs[:, 1]


def shard_of(high: np.ndarray, shards: int) -> np.ndarray:
    return (high >> np.uint64(40)).astype(np.int64) % shards


def hashed_lines(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(high, low, doc_id) of each long key of each row, once a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches):
            ids, texts = b.column("doc_id"), b.column("text").to_pylist()
            for first, last in slices(texts, 8_000_000):
                hashes, rows = [], []
                for i in range(first, last):
                    own = {h for h in line_hashes(texts[i], min_chars)[1] if h}
                    hashes += own
                    rows += [i] * len(own)
                if hashes:
                    high, low = halves(hashes)
                    yield pa.RecordBatch.from_arrays([pa.array(high.view(np.int64)), pa.array(low.view(np.int64)), ids.take(pa.array(rows, pa.int64()))], ["high", "low", "doc_id"])

    return spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).mapInArrow(run, "high long, low long, doc_id long")


def repeated_lines(lines: DataFrame) -> DataFrame:
    """(high, low, n_docs, largest) of each distinct hash of ``hashed_lines`` that more than one document holds.

    Rows of one doc_id are one document; so are those without.  Counts are distinct by
    two aggregations, the first over (hash, doc_id), so that no hot line meets one task.
    """
    ids = F.coalesce("doc_id", F.lit(int(NULL_ID)))
    once = lines.select("high", "low", ids.alias("doc_id")).distinct()
    counted = once.groupBy("high", "low").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("largest"))
    return counted.where("n_docs > 1")


NULL_ID = np.iinfo(np.int64).min


def build_shards(repeated: DataFrame, shards: int) -> DataFrame:
    """(shard, pilots, marks, counts, largest): the arrays of each shard's perfect hash as bytes."""

    def build(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        h = PerfectHash.build(part["high"].to_numpy().view(np.uint64), part["low"].to_numpy().view(np.uint64), np.minimum(part["n_docs"].to_numpy(), np.iinfo(np.uint32).max).astype(np.uint32), part["largest"].to_numpy().astype(np.int64))
        return pd.DataFrame([(key[0], *(a.tobytes() for a in (h.pilots, h.marks, h.counts, h.largest)))], columns=["shard", "pilots", "marks", "counts", "largest"])

    sharded = repeated.select(F.pmod(F.shiftrightunsigned("high", 40), F.lit(shards)).alias("shard"), "high", "low", "n_docs", "largest")
    return sharded.groupBy("shard").applyInPandas(build, "shard long, pilots binary, marks binary, counts binary, largest binary")


def unpack(row: object) -> PerfectHash:
    return PerfectHash(np.frombuffer(row["pilots"], np.uint32), np.frombuffer(row["marks"], np.uint64), np.frombuffer(row["counts"], np.uint32), np.frombuffer(row["largest"], np.int64))


def _losing(tables: dict[int, PerfectHash], shards: int, high: np.ndarray, low: np.ndarray, ids: np.ndarray, min_docs: int) -> np.ndarray:
    """Whether each line (of document ``ids``) has a count of ``min_docs`` at least and another document is the largest that holds it."""
    out, shard = np.zeros(len(high), bool), shard_of(high, shards)
    for s in np.unique(shard):
        if (t := tables.get(int(s))) is not None:
            own = np.flatnonzero(shard == s)
            at = t.probe(high[own], low[own])
            own, at = own[at >= 0], at[at >= 0]
            out[own] = (t.counts[at] >= min_docs) & (t.largest[at] != ids[own])
    return out


def _apply(docs: DataFrame, min_chars: int, decide: Callable, schema: StructType, finish: Callable) -> DataFrame:
    """``docs`` with lines dropped: ``decide(batch, rows, high, low, ids)`` says which lines go, ``finish(batch, lines, drops)`` makes the columns."""
    to = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in parts(batches):
            texts = whole.column("text").to_pylist()
            for first, last in slices(texts, 8_000_000):
                b = whole.slice(first, last - first)
                ids = b.column("doc_id").cast(pa.int64()).fill_null(int(NULL_ID)).to_numpy(zero_copy_only=False)
                split = [line_hashes(t, min_chars) for t in texts[first:last]]
                where = [(i, k) for i, (_, hashes) in enumerate(split) for k, h in enumerate(hashes) if h]
                drops: list[set[int]] = [set() for _ in split]
                if where:
                    rows = np.fromiter((i for i, _ in where), np.int64, len(where))
                    go = decide(b, rows, *halves([split[i][1][k] for i, k in where]), ids[rows])
                    for n in np.flatnonzero(go):
                        drops[where[n][0]].add(where[n][1])
                out = finish(b, [lines for lines, _ in split], drops)
                yield pa.RecordBatch.from_arrays([v.cast(f.type) if isinstance(v := out[f.name], pa.Array) else pa.array(v, f.type) for f in to], schema=to)

    return docs.mapInArrow(run, schema)


def _hits(lines: DataFrame, arrays: DataFrame, shards: int, min_docs: int) -> DataFrame:
    """(id, drop): hashes of the lines that each document loses, by sending hashes to the shards.

    A shard that many lines probe is copied to several tasks; its lines are dealt among them.
    """
    sent = lines.withColumn("shard", F.pmod(F.shiftrightunsigned("high", 40), F.lit(shards)))
    copies = sent.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / F.lit(PROBE_ROWS)).cast("int").alias("copies"))
    dealt = sent.join(copies, "shard").withColumn("copy", F.pmod(F.xxhash64("doc_id", "low"), F.col("copies")).cast("int"))
    again = copies.select(F.col("shard").alias("shard"), F.col("copies").alias("copies"))  # columns of its own: both sides meet again below
    tables = arrays.join(again, "shard").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))

    def probe(key: tuple, part: pd.DataFrame, table: pd.DataFrame) -> pd.DataFrame:
        if not len(part) or not len(table):
            return pd.DataFrame({"doc_id": [], "high": []}).astype("int64")
        high, low = (part[c].to_numpy().view(np.uint64) for c in ("high", "low"))
        go = _losing({int(key[0]): unpack(table.iloc[0])}, shards, high, low, part["doc_id"].to_numpy().astype(np.int64), min_docs)
        return part.loc[go, ["doc_id", "high"]]

    dealt = dealt.withColumn("doc_id", F.coalesce("doc_id", F.lit(int(NULL_ID))))
    hits = dealt.groupBy("shard", "copy").cogroup(tables.groupBy("shard", "copy")).applyInPandas(probe, "doc_id long, high long")
    return hits.groupBy(F.col("doc_id").alias("id")).agg(F.collect_set("high").alias("drop"))


def drop_lines(docs: DataFrame, schema: StructType, finish: Callable, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``docs`` without the lines of ``min_docs`` documents or more, but in the document of the largest doc_id that holds each.

    Rows of an equal doc_id are one document and keep the same lines; so are rows
    without one, whose id is less than any other.  Null and empty texts have one empty
    line; an empty table gives no rows; columns may have any name.
    """
    spark = docs.sparkSession
    lines = hashed_lines(docs, min_chars)
    repeated = cut(repeated_lines(lines))
    n = repeated.count()
    shards = max(1, -(-n // SHARD_KEYS))
    arrays = build_shards(repeated, shards)
    if n * KEY_BYTES <= broadcast_bytes:
        tables = spark.sparkContext.broadcast({r["shard"]: unpack(r) for r in arrays.collect()})
        return _apply(docs, min_chars, lambda b, rows, high, low, ids: _losing(tables.value, shards, high, low, ids, min_docs), schema, finish)
    hits = _hits(cut(lines), cut(arrays), shards, min_docs)
    # Names that no column of the documents has.
    key, drop = (next(x for k in range(len(docs.columns) + 1) if (x := f"{n}_{k}") not in docs.columns) for n in ("id", "drop"))
    joined = docs.withColumn(key, F.coalesce(F.col("doc_id").cast("long"), F.lit(int(NULL_ID)))).join(hits.toDF(key, drop), key, "left").drop(key)

    def decide(b: pa.RecordBatch, rows: np.ndarray, high: np.ndarray, low: np.ndarray, ids: np.ndarray) -> np.ndarray:
        own = [set(x or ()) for x in b.column(drop).to_pylist()]
        return np.fromiter((h in own[i] for i, h in zip(rows, high.view(np.int64).tolist(), strict=True)), bool, len(rows))

    return _apply(joined, min_chars, decide, schema, finish)


def kept_text(lines: list[str], drops: set[int]) -> str:
    return "\n".join(line for k, line in enumerate(lines) if k not in drops) if drops else "\n".join(lines)


def digests(docs: DataFrame, **settings: int) -> DataFrame:
    """doc_id, n_lines, n_dropped and kept_sha256 of every row; further columns aren't read."""

    def finish(b: pa.RecordBatch, lines: list[list[str]], drops: list[set[int]]) -> dict:
        return {
            "doc_id": b.column("doc_id"),
            "n_lines": [len(x) for x in lines],
            "n_dropped": [len(x) for x in drops],
            "kept_sha256": [hashlib.sha256(kept_text(x, d).encode()).hexdigest() for x, d in zip(lines, drops, strict=True)],
        }

    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = StructType.fromDDL("doc_id long, n_lines long, n_dropped long, kept_sha256 string")
    return drop_lines(spread(read), schema, finish, **settings)


def dedup(docs: DataFrame, **settings: int) -> DataFrame:
    """``docs`` with all its columns, the text without its dropped lines, and n_chars, if there and a whole number, counted anew.

    A null text stays null.
    """
    names = docs.columns

    def finish(b: pa.RecordBatch, lines: list[list[str]], drops: list[set[int]]) -> dict:
        out = {n: b.column(n) for n in names}
        if any(drops):
            was = b.column("text").to_pylist()
            texts = [kept_text(x, d) if d else t for t, x, d in zip(was, lines, drops, strict=True)]
            out["text"] = pa.array(texts, pa.string())
            if "n_chars" in out and pa.types.is_integer(out["n_chars"].type):
                kind = out["n_chars"].type
                out["n_chars"] = pa.array([len(t) if d else n for t, n, d in zip(texts, b.column("n_chars").to_pylist(), drops, strict=True)], kind)
        return out

    return drop_lines(docs, docs.schema, finish, **settings)
