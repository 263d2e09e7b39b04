"""SimHash near-dedup by a byte-position inverted index with count filtering.

Equal fingerprints are one class from the start; only distinct fingerprints are
compared.  Two that differ in at most ``bits`` bits share at least ``8 - bits`` of their
eight positional bytes: the guaranteed minimum.  The index lists fingerprints under
triples of positional bytes; its eight triples are all triples within either half, and
any five of eight positions have three in one half, so every pair that reaches the
minimum of five meets in a list.  Within a list shared positional bytes are tallied for
each pair met, pairs below the minimum go, and the rest is verified on all bits.  A list
gives only a spanning forest of its links, fewer links than members.

A list longer than ``LIST_ROWS`` is dealt again under the ten pairs of its other
positions: five shared bytes, so at most 2**24 fingerprints a list; if such a list is
long still, links come from probing the 2,324 neighbours of each member in a bitmap.
Components of the links are found by alternating large and small stars, each round
written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planewise.llm.common import by_batch, cut, spread

SHINGLE = 3
BITS = 3
SEED = 42
POSITIONS = 8
#: Members up to which a list is compared pair by pair in one task.
LIST_ROWS = 4096
TRIPLES = [t for half in (range(4), range(4, 8)) for t in combinations(half, 3)]
FIVES = list(combinations(range(POSITIONS), 5))

_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_LOW_BITS = np.uint64(0x0101010101010101)


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64 majority bits over the XXH64 of all word shingles; zero for a text without words."""
    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return 0
    joined, k = b" ".join(words), min(shingle, len(words))
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip((ends - lengths).tolist(), ends[k - 1 :].tolist(), strict=False)], np.uint64)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 8192):
        part = hashes[i : i + 8192]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) of each whole text; fp holds the 64 bits as a signed number."""

    def make(c: dict) -> dict:
        fps = np.array([fingerprint(t.as_py(), shingle) for t in c["text"]], np.uint64)
        return {"doc_id": c["doc_id"], "fp": pa.array(fps.view(np.int64))}

    return by_batch(spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")), "doc_id long, fp long", make)


def tally(x: np.ndarray) -> np.ndarray:
    """Shared positional bytes of pairs, from the exclusive or of their fingerprints."""
    y = x | x >> np.uint64(4)
    y |= y >> np.uint64(2)
    y |= y >> np.uint64(1)
    return POSITIONS - np.bitwise_count(y & _LOW_BITS).astype(np.int64)


def linked(x: np.ndarray, bits: int) -> np.ndarray:
    """Of pairs given by their exclusive or: those that reach the guaranteed matches and are verified."""
    out = tally(x) >= POSITIONS - bits
    out[out] = np.bitwise_count(x[out]) <= bits
    return out


def forest_of(members: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """Links that span the components of a list; every member is compared with all not reached yet."""
    left, links = members, []
    while len(left) > 1:
        todo, left = [left[0]], left[1:]
        while todo and len(left):
            one = todo.pop()
            near = linked(left ^ one, bits)
            if near.any():
                found = left[near]
                links += [(one, x) for x in found]
                todo += list(found)
                left = left[~near]
    return links


def forest_by_bitmap(members: np.ndarray, free: tuple[int, ...], bits: int) -> list[tuple[int, int]]:
    """The same for members that differ in the bytes ``free`` only: neighbours are looked up, not compared."""
    places = [8 * p + k for p in free for k in range(8)]
    masks = np.array([sum(1 << i for i in c) for n in range(1, bits + 1) for c in combinations(range(len(places)), n)], np.int64)
    small = np.zeros(len(members), np.int64)
    for i, place in enumerate(places):
        small |= ((members >> np.uint64(place)) & np.uint64(1)).astype(np.int64) << i
    waits = np.zeros(1 << len(places), bool)
    waits[small] = True
    order = np.argsort(small)
    full = members[order]
    keys = small[order]
    links = []
    for start in small.tolist():
        if not waits[start]:
            continue
        waits[start] = False
        todo = [start]
        while todo:
            one = todo.pop()
            near = one ^ masks
            near = near[waits[near]]
            if len(near):
                waits[near] = False
                todo += near.tolist()
                a = full[np.searchsorted(keys, one)]
                links += [(a, b) for b in full[np.searchsorted(keys, near)]]
    return links


def _byte(p: int) -> Column:
    return F.shiftrightunsigned("fp", 8 * p).bitwiseAND(F.lit(255))


def _key(number: int, positions: tuple[int, ...]) -> Column:
    key = F.lit(number).cast("long")
    for p in positions:
        key = F.shiftleft(key, 8).bitwiseOR(_byte(p))
    return key


def _lists(batches: Iterator[pa.RecordBatch], limit: int, load: Callable[[pa.RecordBatch], np.ndarray] | None = None) -> Iterator[tuple[bool, np.ndarray, np.ndarray]]:
    """Rows sorted by key as (too long, keys, rest): whole lists, or parts of a list longer than ``limit``.

    The rest are fingerprints or what ``load`` makes of a batch, one row each.

    No more than a batch and a list of ``limit`` rows is held.
    """
    load = load or (lambda batch: batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64))
    keys, fps, long_key = np.empty(0, np.int64), None, None

    def split(keys: np.ndarray, fps: np.ndarray) -> Iterator[tuple[bool, np.ndarray, np.ndarray]]:
        starts = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1])
        sizes = np.diff(np.append(starts, len(keys)))
        over = np.repeat((sizes > limit) | (keys[starts] == long_key if long_key is not None else False), sizes)
        if over.any():
            yield True, keys[over], fps[over]
        if not over.all():
            yield False, keys[~over], fps[~over]

    for batch in batches:
        keys = np.concatenate([keys, batch.column(0).to_numpy(zero_copy_only=False)])
        fps = load(batch) if fps is None else np.concatenate([fps, load(batch)])
        if not len(keys):
            continue
        last = int(np.searchsorted(keys, keys[-1]))
        if last:
            yield from split(keys[:last], fps[:last])
        keys, fps = keys[last:], fps[last:]
        if len(keys) > limit or keys[0] == long_key:
            long_key = keys[0]
            yield True, keys, fps
            keys, fps = keys[:0], fps[:0]
    if len(keys):
        yield from split(keys, fps)


def _links(postings: DataFrame, work: Callable[[int, np.ndarray], list], limit: int, bits: int) -> DataFrame:
    """(kind, key, a, b): kind 0 is a link of a list, kind 1 a member ``a`` of a list longer than ``limit``."""

    def rows(kind: int, keys: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), pa.array(keys), pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["kind", "key", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for too_long, keys, fps in _lists(batches, limit):
            if too_long:
                yield rows(1, keys, fps, fps)
                continue
            starts = np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1])
            sizes = np.diff(np.append(starts, len(keys)))
            two = starts[sizes == 2]
            a, b = fps[two], fps[two + 1]
            near = linked(a ^ b, bits)
            links = [x for i in np.flatnonzero(sizes > 2) for x in work(int(keys[starts[i]]), fps[starts[i] : starts[i] + sizes[i]])]
            if links:
                more = np.array(links, np.uint64)
                a, b = np.concatenate([a[near], more[:, 0]]), np.concatenate([b[near], more[:, 1]])
            else:
                a, b = a[near], b[near]
            if len(a):
                yield rows(0, np.zeros(len(a), np.int64), a, b)

    return postings.repartition("key").sortWithinPartitions("key").mapInArrow(run, "kind int, key long, a long, b long")


def links(distinct: DataFrame, bits: int = BITS, list_rows: int = LIST_ROWS) -> DataFrame:
    """(a, b): links that connect the same fingerprints as all pairs within ``bits`` bits do."""
    if not 0 <= bits <= 3:
        raise ValueError("the triples guarantee a meeting for 3 bits at most")
    fps = distinct.select("fp")
    postings = fps.select(F.explode(F.array(*(_key(i, t) for i, t in enumerate(TRIPLES)))).alias("key"), "fp")
    first = cut(_links(postings, lambda key, members: forest_of(members, bits), list_rows, bits))
    out = first.where("kind = 0").select("a", "b")
    long = first.where("kind = 1")
    if long.isEmpty():
        return out
    triple = F.shiftrightunsigned("key", 24).cast("int")
    number = {f: i for i, f in enumerate(FIVES)}

    def under(t: tuple[int, ...]) -> Column:
        rest = [p for p in range(POSITIONS) if p not in t]
        fives = [tuple(sorted((*t, *two))) for two in combinations(rest, 2)]
        return F.array(*(_key(number[f], f) for f in fives))

    which = F.when(triple == 0, under(TRIPLES[0]))
    for i, t in enumerate(TRIPLES[1:], 1):
        which = which.when(triple == i, under(t))
    again = long.select(F.col("a").alias("fp"), "key").select(F.explode(which).alias("key"), "fp").dropDuplicates(["key", "fp"])

    def work(key: int, members: np.ndarray) -> list:
        if len(members) <= list_rows:
            return forest_of(members, bits)
        return forest_by_bitmap(members, tuple(p for p in range(POSITIONS) if p not in FIVES[key >> 40]), bits)

    second = _links(again, work, 1 << 24, bits)
    return out.unionByName(second.select("a", "b"))


def components(edges: DataFrame, most_rounds: int = 64) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b); the root is the least node of its component."""
    stars = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    mark = lambda df: tuple(df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())
    was = mark(stars)
    for _ in range(most_rounds):
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = cut(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        stars = cut(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        now = mark(stars)
        if now == was:
            break
        was = now
    else:
        raise RuntimeError("components didn't settle")
    roots = stars.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return stars.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def group(docs: DataFrame, shingle: int = SHINGLE, bits: int = BITS, list_rows: int = LIST_ROWS) -> DataFrame:
    """doc_id, fingerprint and component_id of every row of ``docs`` (doc_id, text).

    The component is the least doc_id among all documents that links reach.  Null and
    wordless texts have fingerprint zero and link like any other; rows with a null
    doc_id take part but are no component's least; repeated rows give equal rows; an
    empty table gives none; further columns aren't read.
    """
    own = cut(fingerprints(docs, shingle))
    of = component_of_fingerprint(own, bits, list_rows)
    # A fingerprint that a third of all rows share is one row in ``of``: the join splits its rows among tasks.
    return own.join(of, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def component_of_fingerprint(own: DataFrame, bits: int = BITS, list_rows: int = LIST_ROWS) -> DataFrame:
    """(fp, component_id) of the distinct fingerprints of ``own`` (doc_id, fp)."""
    distinct = cut(own.groupBy("fp").agg(F.min("doc_id").alias("first")))
    nodes = cut(components(links(distinct, bits, list_rows)))
    least = nodes.join(distinct, nodes["node"] == distinct["fp"]).groupBy("root").agg(F.min("first").alias("least"))
    reached = nodes.join(least, "root").select(F.col("node").alias("fp"), "least")
    return cut(distinct.join(reached, "fp", "left").select("fp", F.coalesce("least", "first").alias("component_id")))


def keep_one(docs: DataFrame, **settings: int) -> DataFrame:
    """The rows of ``docs``, with all columns, whose doc_id is the least of its component.

    Where a component has no doc_id but null, its rows stay.
    """
    kept = group(docs, **settings).where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(F.col("doc_id").alias("__kept")).distinct()
    return docs.join(kept, docs["doc_id"].cast("long").eqNullSafe(kept["__kept"]), "left_semi")
