"""Near-dedup of documents whose five-word shingles are similar to 0.8 or more, by longer SimHashes.

The similarity is the one that SimHashes estimate, the cosine of the two shingle sets:
the share of bits in which they differ is the angle over pi.  For sets of one size 0.8 is
a Jaccard similarity of two thirds.  Such documents differ in a fifth of their bits,
beyond what eight byte positions can guarantee, so this way takes more of them: ten
fingerprints over word pairs, which few edits touch, feed the byte-position index (eight
triples each), and members of a list are verified on 256 bits over the set of five-word
shingles, with ``VERIFY_BITS`` little more than the share of a similarity of 0.8.
Copies with scattered edits meet in some list with probability 0.88 at a cosine of 0.8,
0.93 at 0.82 and 0.99 at 0.89 (a Jaccard similarity of 0.8).  Copies cut short or
continued keep as few of their word pairs as of their shingles and meet less often: 0.73
at a Jaccard similarity of 0.79, 0.91 at 0.85, 0.98 at 0.88.  Groups link on through
their other members.
Links within three bits of the plain fingerprint are added.

Lists are counted first, by key alone; a key that one document has goes no further, and
only members of longer lists meet their fingerprints again.  A list gives a spanning
forest of all its close pairs, however long it is.  A list of more than ``SALT_ROWS`` is
cut into blocks by a hash of the member; any two blocks, and each block with itself, meet
in a task of their own, so every pair is compared in one task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planewise.llm import simhash
from planewise.llm.common import by_batch, cut, spread

SHINGLE = 5
SIMILARITY = 0.8
STREAMS = 10
CHECKS = 4
#: Members of a list that are compared at once, and members of a list that one task reads.
LIST_ROWS = 4096
SALT_ROWS = 100_000
WHOLE = 1 << 62  # lists aren't read in parts

_SHARE = math.acos(SIMILARITY) / math.pi
#: Bits that pairs of that similarity differ in, and half a standard deviation more, so that most of them pass.
VERIFY_BITS = round(64 * CHECKS * _SHARE + 0.5 * math.sqrt(64 * CHECKS * _SHARE * (1 - _SHARE)))

_INDEX = [f"i{k}" for k in range(STREAMS)]
_CHECK = [f"v{k}" for k in range(CHECKS)]
_ODD = np.array([pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) for k in range(SHINGLE)], np.uint64)
_OFFSETS = np.array([k * 0xD1B54A32D192ED03 % (1 << 64) for k in range(STREAMS)], np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def _shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the set of shingles of ``k`` words, of all words if there are fewer."""
    k = min(k, len(words))
    n = len(words) - k + 1
    out = np.zeros(n, np.uint64)
    for j in range(k):
        out += words[j : j + n] * _ODD[j]
    return np.unique(_mixed(out))


def _majority(features: np.ndarray, streams: int) -> list[int]:
    out = []
    for offset in _OFFSETS[:streams]:
        ones = np.zeros(64, np.int64)
        for i in range(0, len(features), 8192):
            part = _mixed(features[i : i + 8192] + offset)
            ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out.append(int(np.packbits(2 * ones > len(features), bitorder="little").view(np.int64)[0]))
    return out


def sketch(text: str | None) -> list[int]:
    """Fingerprints over word pairs for the index and over five-word shingles for the check, zero without words."""
    words = (text or "").encode().translate(simhash._LOWER).split()
    if not words:
        return [0] * (STREAMS + CHECKS)
    hashes = np.array(list(map(xxhash.xxh64_intdigest, words)), np.uint64)
    return _majority(_shingles(hashes, 2), STREAMS) + _majority(_shingles(hashes, SHINGLE), CHECKS)


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, i0.., v0..) of each whole text."""

    def make(c: dict) -> dict:
        texts = c["text"].to_pylist()
        rows = np.array([sketch(t) for t in texts], np.int64).reshape(-1, STREAMS + CHECKS)
        fps = np.array([simhash.fingerprint(t) for t in texts], np.uint64)
        return {"doc_id": c["doc_id"], "fp": fps.view(np.int64)} | {n: rows[:, k] for k, n in enumerate(_INDEX + _CHECK)}

    schema = "doc_id long, fp long, " + ", ".join(f"{n} long" for n in _INDEX + _CHECK)
    return by_batch(spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")), schema, make)


def _near(words: np.ndarray, one: np.ndarray) -> np.ndarray:
    """Columns of ``words`` (a row a word of the check) within ``VERIFY_BITS`` of ``one``; half of the words rules most out."""
    out = []
    for i in range(0, words.shape[1], LIST_ROWS):
        part = words[:, i : i + LIST_ROWS]
        half = np.bitwise_count(part[: CHECKS // 2] ^ one[: CHECKS // 2, None]).sum(axis=0, dtype=np.int16)
        near = np.flatnonzero(half <= VERIFY_BITS)
        if len(near):
            out.append(i + near[np.bitwise_count(part[:, near] ^ one[:, None]).sum(axis=0, dtype=np.int16) <= VERIFY_BITS])
    return np.concatenate(out) if out else np.empty(0, np.int64)


def forest_of(rows: np.ndarray, side: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that span the groups of ``rows`` (node, checks); every member is compared with all not reached yet.

    With ``side`` (0 or 1 of each row) only members of different sides are compared.
    """
    sides = [rows] if side is None or (side == side[0]).all() else [rows[side == 0], rows[side == 1]]
    nodes, words = [r[:, 0] for r in sides], [np.ascontiguousarray(r[:, 1:].T).view(np.uint64) for r in sides]
    links, todo = [], []
    while todo or len(nodes[0]):
        if not todo:
            todo.append((0, nodes[0][0], words[0][:, 0]))
            nodes[0], words[0] = nodes[0][1:], words[0][:, 1:]
        at, node, one = todo.pop()
        to = len(sides) - 1 - at
        near = _near(words[to], one)
        if len(near):
            links += [(int(node), int(x)) for x in nodes[to][near]]
            todo += [(to, n, w) for n, w in zip(nodes[to][near], words[to][:, near].T, strict=True)]
            nodes[to], words[to] = np.delete(nodes[to], near), np.delete(words[to], near, axis=1)
    return links


def _key(stream: int, number: int, positions: tuple[int, ...]) -> Column:
    key = F.lit(stream * len(simhash.TRIPLES) + number).cast("long")
    for p in positions:
        key = F.shiftleft(key, 8).bitwiseOR(F.shiftrightunsigned(_INDEX[stream], 8 * p).bitwiseAND(F.lit(255)))
    return key


def links(nodes: DataFrame) -> DataFrame:
    """(a, b) links between ``nodes`` (node, i0.., v0..)."""
    keys = F.array(*(_key(s, n, t) for s in range(STREAMS) for n, t in enumerate(simhash.TRIPLES)))
    postings = nodes.select(F.explode(keys).alias("key"), "node")
    counts = cut(postings.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    postings = postings.join(counts, "key").join(nodes.select("node", *_CHECK), "node")
    dealt = not counts.where(F.col("n") > SALT_ROWS).isEmpty()
    if dealt:
        # Blocks of half the rows of a task meet two by two, each pair under a key of its own; a block meets itself too.
        parts = F.when(F.col("n") > SALT_ROWS, F.ceil(F.col("n") * 2 / SALT_ROWS)).otherwise(1).cast("long")
        blocks = postings.withColumn("parts", parts).withColumn("own", F.pmod(F.xxhash64("node"), F.col("parts")))
        met = blocks.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
        pair = F.least("own", "other") * F.col("parts") + F.greatest("own", "other")
        side = (F.col("own") > F.col("other")).cast("long")
        postings = met.select(F.xxhash64(pair, "key").alias("key"), "node", *_CHECK, side.alias("side"))
    else:
        postings = postings.select("key", "node", *_CHECK)

    def load(batch: pa.RecordBatch) -> np.ndarray:
        return np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in range(1, batch.num_columns)], axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, keys, rows in simhash._lists(batches, WHOLE, load):
            starts = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])
            found: list[tuple[int, int]] = []
            for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                if b - a > 1:
                    found += forest_of(rows[a:b, : 1 + CHECKS], rows[a:b, -1] if dealt else None)
            if found:
                pairs = np.array(found, np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    return postings.repartition("key").sortWithinPartitions("key").mapInArrow(run, "a long, b long")


def group(docs: DataFrame) -> DataFrame:
    """(node, root): each class of equal fingerprints, named by its least doc_id, and the least doc_id of its group; null ids stand apart."""
    own = cut(sketches(docs))
    plain = simhash.component_of_fingerprint(own.select("doc_id", "fp"))
    nodes = cut(own.where("doc_id is not null").groupBy("fp", *_INDEX, *_CHECK).agg(F.min("doc_id").alias("node")))
    close = nodes.join(plain, "fp").where("node <> component_id").select(F.col("node").alias("a"), F.col("component_id").alias("b"))
    found = simhash.components(cut(links(nodes)).unionByName(close))
    return nodes.select("node").join(found, "node", "left").select("node", F.coalesce("root", "node").alias("root"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all columns, whose doc_id is the least of its group.

    Equal texts are one group.  Rows with a null doc_id can't be told apart and stay;
    rows that repeat a kept doc_id stay with it; an empty table gives no rows.
    """
    held = next(x for k in range(len(docs.columns) + 1) if (x := f"kept_{k}") not in docs.columns)  # a name that no column has
    kept = group(docs).where("node = root").select(F.col("node").alias(held)).distinct()
    known = docs.where(F.col("doc_id").isNotNull()).join(kept, F.col("doc_id").cast("long") == F.col(held), "left_semi")
    return known.unionByName(docs.where(F.col("doc_id").isNull()))
