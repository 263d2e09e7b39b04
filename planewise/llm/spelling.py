"""Grouping of spelling variants by full neighbourhood generation.

Every word of the vocabulary emits all words one edit away over the letters the
vocabulary has: each code point deleted, each replaced by every other letter, every
letter inserted at each place.  A hash join of these with the vocabulary leaves the near
words: a match is one edit away by construction, so nothing is measured.  Hundreds of
candidates a word are too many to shuffle for the few that are words, so all are made as
hashes first and looked up in a bitmap of the vocabulary; what passes is written out and joined.

A word of m letters has some 2 m |A| neighbours of m letters each.  Words beyond ``LONG_LETTERS`` (unbroken runs of letters of any
size) emit hashes instead, one for each code point left out and one for each made a
wildcard, in linear time and space; two words meet where the hash of one without a code
point is that of the other, or where wildcards at one place leave equal hashes.  Groups
of the latter hold at most one word for each letter.  A hash isn't the text, so
these matches are compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planewise.llm import duck
from planewise.llm.common import cut, ship

LETTERS = r"A-Za-zÀ-ÿ"
LEAST_LETTERS, LEAST_COUNT, RATIO, EVERY = 6, 5, 5, 199
LONG_LETTERS = 64
#: Words whose candidates are made at once; bits of the bitmap a word, and its cells of 64 at most.
BATCH_WORDS, BITS_A_WORD, MOST_CELLS = 2_000, 16, 1 << 23
#: Words up to which the vocabulary (some 40 bytes a word) is broadcast to the candidates; it is counted.
BROADCAST_WORDS = 100_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def vocabulary(docs: DataFrame) -> DataFrame:
    """(word, n): the runs of letters of all texts, a code point of every so-manieth one left out, by their number."""
    # Only runs that can keep enough letters are cut out; the quantifier takes a run whole or, if it is short, not at all.
    runs = F.regexp_extract_all(F.col("text"), F.lit(f"([{LETTERS}]{{{LEAST_LETTERS},}})"), F.lit(1))
    found = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("doc"), F.explode(runs).alias("run")).select("doc", F.translate("run", _UPPER, _LOWER).alias("run"))
    h = found.withColumn("h", F.crc32(F.concat("doc", F.lit(":"), "run")))
    at = (F.col("h") % F.char_length("run")).cast("int")
    left_out = F.concat(F.col("run").substr(F.lit(1), at), F.col("run").substr(at + 2, F.char_length("run")))
    words = h.select(F.when(F.col("h") % EVERY == 0, left_out).otherwise(F.col("run")).alias("word"))
    return words.where(F.char_length("word") >= LEAST_LETTERS).groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_COUNT)


_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))


def edit_hashes(word: str) -> tuple[int, np.ndarray, np.ndarray]:
    """Polynomial hashes modulo 2^64 of a word, of it without each code point, and with a wildcard for each, as signed numbers."""
    code = np.frombuffer(word.encode("utf-32-le"), np.uint32).astype(np.uint64)
    powers = np.cumprod(np.full(len(code), _BASE, np.uint64))
    terms = code * powers
    upto = np.cumsum(terms)
    without = upto - terms + (upto[-1] - upto) * _INVERSE
    return int(upto[-1:].view(np.int64)[0]), without.view(np.int64), (upto[-1] - terms).view(np.int64)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, kind, at, hash) of long words; a word's rows leave in parts, so the largest word sets what a task holds."""
    for b in batches:
        for id, word in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            whole, without, wild = edit_hashes(word)
            for kind, at, own in ((0, np.array([len(word)]), np.array([whole])), (1, np.arange(len(word)), without), (2, np.arange(len(word)), wild)):
                for i in range(0, len(own), 100_000):
                    part = own[i : i + 100_000]
                    yield pa.RecordBatch.from_pydict({"id": pa.array([id] * len(part)), "size": np.full(len(part), len(word)), "kind": np.full(len(part), kind, np.int32), "at": at[i : i + 100_000].astype(np.int64), "hash": part})


def _long_links(words: DataFrame) -> DataFrame:
    """(word, near) of words too long to write their neighbourhoods out."""
    ship(words.sparkSession)
    named = cut(words.select(F.sha2("word", 256).alias("id"), "word"))
    hashes = cut(named.mapInArrow(_hashed, "id string, size long, kind int, at long, hash long"))
    own, out, wild = (hashes.where(F.col("kind") == k) for k in range(3))
    side = lambda df, p: df.select(*(F.col(c).alias(f"{p}{c}") for c in ("id", "size", "at", "hash")))
    shorter = side(out, "a_").join(side(own, "b_"), (F.col("a_hash") == F.col("b_hash")) & (F.col("a_size") == F.col("b_size") + 1))
    same = side(wild, "a_").join(side(wild, "b_"), (F.col("a_hash") == F.col("b_hash")) & (F.col("a_size") == F.col("b_size")) & (F.col("a_at") == F.col("b_at")) & (F.col("a_id") != F.col("b_id")))
    pairs = shorter.select("a_id", "b_id", "a_at", F.lit(1).alias("gone")).unionByName(same.select("a_id", "b_id", "a_at", F.lit(0).alias("gone"))).dropDuplicates(["a_id", "b_id"])
    a, b = named.select(F.col("id").alias("a_id"), F.col("word").alias("a")), named.select(F.col("id").alias("b_id"), F.col("word").alias("b"))
    at, size = F.col("a_at").cast("int"), F.char_length("a")
    rest = lambda c, i: F.col(c).substr(i + 1, size)
    equal = (F.col("a").substr(F.lit(1), at) == F.col("b").substr(F.lit(1), at)) & (rest("a", at + 1) == F.when(F.col("gone") == 1, rest("b", at)).otherwise(rest("b", at + 1)))
    met = pairs.join(a, "a_id").join(b, "b_id").where(equal)
    one = met.select(F.col("a").alias("word"), F.col("b").alias("near"))
    return one.unionByName(met.where(F.col("gone") == 1).select(F.col("b").alias("word"), F.col("a").alias("near")))


class Neighbourhood:
    """All distinct strings one edit away from words, over the letters of a vocabulary, less those that can't be in it.

    A candidate's hash is that of its word with one term changed, so a batch's candidates
    are made as an array of hashes and looked up in a bitmap of the vocabulary's; the few
    that may be there are written out.  Edits that give the same string are told by their
    place: a letter leaves or enters a run of equal ones at its start only.
    """

    def __init__(self, letters: list[str], bitmap: np.ndarray) -> None:
        self.letters, self.bitmap = letters, bitmap
        self.codes = np.array([ord(c) for c in letters], np.uint64)

    def held(self, hashes: np.ndarray) -> np.ndarray:
        """Places of the hashes whose two bits are set."""
        at = np.flatnonzero(self._set(hashes, 0))
        return at[self._set(hashes[at], 1)]

    def _set(self, hashes: np.ndarray, way: int) -> np.ndarray:
        slots = slots_of(hashes, way, len(self.bitmap))
        return self.bitmap[slots >> np.uint64(6)] >> (slots & np.uint64(63)) & np.uint64(1) != 0

    def near(self, words: list[str]) -> tuple[list[str], list[str]]:
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        code = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.uint64)
        ends = np.cumsum(sizes)
        which = np.repeat(np.arange(len(words)), sizes)
        place = np.arange(len(code)) - (ends - sizes)[which]
        powers = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(int(sizes.max()) + 1, _BASE)]))
        power = powers[place + 1]
        terms = code * power
        upto = np.cumsum(terms)
        upto -= (upto - terms)[ends - sizes][which]  # within each word
        whole = upto[ends - 1]
        last = np.where(place > 0, np.roll(code, 1), np.uint64(0))
        found: tuple[list[str], list[str]] = ([], [])

        def keep(w: np.ndarray, i: np.ndarray, c: list[str], skip: int) -> None:
            for k, at, x in zip(w.tolist(), i.tolist(), c, strict=True):
                word = words[k]
                found[0].append(word)
                found[1].append(word[:at] + x + word[at + skip :])

        gone = np.flatnonzero(code != last)
        at = gone[self.held((upto - terms + (whole[which] - upto) * _INVERSE)[gone])]
        keep(which[at], place[at], [""] * len(at), 1)
        for c, letter in zip(self.codes, self.letters, strict=True):
            some = np.flatnonzero(code != c)
            at = some[self.held((whole[which] + (c - code) * power)[some])]
            keep(which[at], place[at], [letter] * len(at), 1)
            some = np.flatnonzero(last != c)
            before = upto - terms
            at = some[self.held((before + c * power + (whole[which] - before) * _BASE)[some])]
            keep(which[at], place[at], [letter] * len(at), 0)
            some = np.flatnonzero(code[ends - 1] != c)  # behind the last letter
            at = some[self.held((whole + c * powers[sizes + 1])[some])]
            keep(at, sizes[at], [letter] * len(at), 0)
        return found


def slots_of(hashes: np.ndarray, way: int, cells: int) -> np.ndarray:
    """The bit of a hash, one of 64 a cell; the number of cells is a power of two."""
    x = hashes ^ hashes >> np.uint64(29 + 4 * way)
    return x * _BASE * np.uint64(4 * way + 1) >> np.uint64(64 - 6 - (cells.bit_length() - 1))


def bitmap_of(words: DataFrame, n: int) -> np.ndarray:
    """Two bits for each word of a vocabulary of ``n``, at least ``BITS_A_WORD`` a word up to ``MOST_CELLS`` cells (64 MB).

    Beyond that more candidates pass; the join still decides.
    """
    cells = min(MOST_CELLS, 1 << max(4, (n * BITS_A_WORD // 64).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = np.array([edit_hashes(w)[0] for w in b.column(0).to_pylist()], np.int64).view(np.uint64)
            slots = np.concatenate([slots_of(own, way, cells) for way in range(2)])
            yield pa.RecordBatch.from_arrays([pa.array((slots >> np.uint64(6)).astype(np.int64)), pa.array((np.uint64(1) << (slots & np.uint64(63))).view(np.int64))], ["cell", "bits"])

    filled = words.select("word").mapInArrow(run, "cell long, bits long").groupBy("cell").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(cells, np.uint64)
    out[filled.column("cell").to_numpy()] = filled.column("bits").to_numpy().view(np.uint64)
    return out


def links(words: DataFrame) -> DataFrame:
    """(word, near, near_n): all near pairs of a written vocabulary (word, n), in both directions."""
    spark = words.sparkSession
    ship(spark)
    short = words.where(F.char_length("word") <= LONG_LETTERS)
    # At most the 26 and 64 letters that words are made of.
    letters = [r[0] for r in short.select(F.explode(F.split("word", "")).alias("c")).where(F.col("c") != "").distinct().orderBy("c").collect()]
    near = words.select(F.col("word").alias("near"), F.col("n").alias("near_n"))
    if not letters:
        out = None
    else:
        n = words.count()
        held = spark.sparkContext.broadcast(bitmap_of(short, n))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            made = Neighbourhood(letters, held.value)
            for b in batches:
                for i in range(0, b.num_rows, BATCH_WORDS):
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in made.near(b.column(0).slice(i, BATCH_WORDS).to_pylist())], ["word", "near"])

        # Work for a core is a word's hundreds of neighbours, not its bytes.
        dealt = short.select("word").repartition(max(4 * spark.sparkContext.defaultParallelism, -(-n // 20_000)), "word")
        made = dealt.mapInArrow(run, "word string, near string")
        out = made.join(F.broadcast(near) if n <= BROADCAST_WORDS else near, "near").select("word", "near", "near_n")
    # Words at the border of the two ways: a long one meets the shorter of one letter less.
    long = words.where(F.char_length("word") > LONG_LETTERS)
    if long.isEmpty():
        return out
    beside = _long_links(words.where(F.char_length("word") >= LONG_LETTERS)).where(F.greatest(F.char_length("word"), F.char_length("near")) > LONG_LETTERS)
    whole = beside.join(near, "near").select("word", "near", "near_n")
    if out is None:
        return whole
    return out.where((F.char_length("near") <= LONG_LETTERS)).unionByName(whole)


def _chains(n: int) -> int:
    """Doublings after which every chain of forms has ended: each form is ``RATIO`` times as frequent as its word."""
    steps = 1
    while RATIO**steps <= n:
        steps += 1
    return steps.bit_length()


def group(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word of ``docs`` (doc_id, text).

    A word's form is its most frequent near word (ties: the least in code-point order) if
    that is five times as frequent as the word or more; its root is where the chain of forms ends.  Null and empty texts have
    no words; a null doc_id counts as an empty one in the hash; repeated rows count each
    time; texts and words may be of any length; an empty table gives no rows; further
    columns aren't read.
    """
    words = cut(vocabulary(docs))
    if words.isEmpty():
        return words.select("word", F.lit(None).cast("string").alias("form"), F.lit(None).cast("string").alias("root"), "n", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("long").alias("form_n"))
    best = F.min(F.struct((-F.col("near_n")).alias("rank"), F.col("near")))
    counted = links(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    with_best = words.join(counted, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.col("best.near").alias("near"), (-F.col("best.rank")).alias("near_n"))
    held = F.col("near_n") >= RATIO * F.col("n")
    formed = cut(with_best.select("word", "n", "n_near", F.when(held, F.col("near")).alias("form"), F.when(held, F.col("near_n")).alias("form_n")))
    roots = formed.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root"))
    for _ in range(_chains(formed.agg(F.max("n")).first()[0])):
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        roots = cut(roots.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root")))
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def oracle() -> str:
    """The same as DuckDB SQL; near words are found by leaving out each code point or making it a wildcard."""
    crc = duck.crc32("coalesce(doc_id::VARCHAR, '') || ':' || run")
    return f"""WITH RECURSIVE r AS (SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')), '{_UPPER}', '{_LOWER}') AS run FROM documents),
o AS (SELECT doc_id, run, count(*) AS k FROM r WHERE length(run) >= {LEAST_LETTERS} GROUP BY ALL), h AS (SELECT run, k, {crc} AS h FROM o),
w AS (SELECT CASE WHEN h % {EVERY} = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, k FROM h),
v AS (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM w WHERE length(word) >= {LEAST_LETTERS} GROUP BY word HAVING sum(k) >= {LEAST_COUNT}),
p AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS gone, substr(word, 1, i) || chr(0) || substr(word, i + 2) AS wild FROM v, unnest(range(0, length(word))) AS u(i)),
e AS (SELECT p.word, v.word AS near FROM p JOIN v ON p.gone = v.word UNION SELECT v.word, p.word FROM p JOIN v ON p.gone = v.word UNION SELECT a.word, b.word FROM p a JOIN p b ON a.wild = b.wild AND a.word <> b.word),
b AS (SELECT e.word, v.word AS near, v.n AS near_n, count(*) OVER (PARTITION BY e.word) AS n_near, row_number() OVER (PARTITION BY e.word ORDER BY v.n DESC, v.word) AS k FROM e JOIN v ON e.near = v.word),
f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= {RATIO} * n THEN near END AS form, CASE WHEN near_n >= {RATIO} * n THEN near_n END AS form_n FROM v LEFT JOIN b ON v.word = b.word AND k = 1),
c(word, cur) AS (SELECT word, word FROM f UNION ALL SELECT c.word, f.form FROM c JOIN f ON f.word = c.cur WHERE f.form IS NOT NULL),
z AS (SELECT c.word, c.cur AS root FROM c JOIN f ON f.word = c.cur WHERE f.form IS NULL)
SELECT f.word, form, root, n, n_near, form_n FROM f JOIN z ON f.word = z.word"""
