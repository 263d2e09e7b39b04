"""Quality rules: an isolation forest on rule statistics.

Each document gives counts (words, symbols, repeated lines, words in repeated windows)
and ratios of them.  For each group of ratios a forest of random splits is grown on a
bounded sample of labelled rows; documents that few splits isolate are anomalous.  The
score from which a document goes is calibrated for each forest on labelled rows that it
wasn't grown on, every second one: the lowest that keeps nearly all good ones, and none
where that would hardly catch bad ones.
Groups are kept apart because in one forest over all ratios a split seldom falls on the
few that tell, and the others drown them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from planewise.llm.common import by_batch, parts, spread

#: Labelled rows that the forest and its threshold are fitted on, at most, of each quality.
SAMPLE_ROWS = 4096
TREES = 128
TREE_ROWS = 256
SEED = 20240901
#: Share of the good sample that a forest's threshold may lose, and of the bad that it must catch to count.
GOOD_LOSS = 0.001
BAD_CAUGHT = 0.1

MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8

WHITE = " \t\n\v\f\r"
SYMBOLS = "#*$%&|<>"
RATIOS = ("symbols", "dup_lines", "repeats", "exclaims", "upper", "word_length", "distinct")
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
GROUPS = (("symbols", "exclaims"), ("dup_lines", "repeats", "distinct"), ("upper", "word_length"))
_MULTIPLIERS = np.array([pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) for k in range(WINDOW)], np.uint64)
_UPPER = bytes(range(65, 91))


def repeat_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words in windows of ``window`` words that the text has twice or more, the first one included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    ids = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    mixed = np.zeros(n, np.uint64)
    for k in range(window):
        mixed += (ids[k : k + n] ^ ids[k : k + n] >> np.uint64(29)) * _MULTIPLIERS[k]
    order = np.argsort(mixed)
    held = mixed[order]
    same = held[1:] == held[:-1]
    if not same.any():
        return 0
    again = np.zeros(n, bool)
    again[order[1:][same]] = again[order[:-1][same]] = True
    covered = np.zeros(len(words) + 1, np.int64)
    starts = np.flatnonzero(again)
    np.add.at(covered, starts, 1)
    np.add.at(covered, starts + window, -1)
    return int((np.cumsum(covered) > 0).sum())


def statistics(text: str | None) -> tuple[int, int, int, int, int, float, float, float]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, then exclamation marks, capitals and distinct words."""
    text = text or ""
    raw = text.encode()
    words = raw.split()
    seen, dup = set(), 0
    for line in text.split("\n"):
        if line.strip(WHITE):
            dup += line in seen
            seen.add(line)
    upper = len(raw) - len(raw.translate(None, _UPPER))
    return (
        len(words), len(text) - sum(map(text.count, WHITE)), sum(map(text.count, SYMBOLS)), dup, repeat_words(words),
        text.count("!"), upper, len(set(words)),
    )


def ratios(s: np.ndarray, n_lines: np.ndarray) -> np.ndarray:
    """Features of rows of ``statistics``; lengths are left out, so that long documents aren't odd for being long."""
    words = np.maximum(s[:, 0], 1)
    chars = np.maximum(s[:, 1], 1)
    return np.stack(
        [
            s[:, 2] / words,
            s[:, 3] / np.maximum(n_lines, 1),
            s[:, 4] / words,
            s[:, 5] / words,
            s[:, 6] / chars,
            np.log(chars / words),
            s[:, 7] / np.minimum(words, np.sqrt(words) * 20),
        ],
        axis=1,
    )


def count_rules(docs: DataFrame) -> DataFrame:
    """doc_id with the counts and the features of each whole text."""
    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, " + ", ".join(f"f_{r} double" for r in RATIOS)

    def make(c: dict) -> dict:
        counts, f = measured(c["text"].to_pylist())
        return {"doc_id": c["doc_id"], **dict(zip(COUNTS, counts.T, strict=True)), **{f"f_{r}": f[:, i] for i, r in enumerate(RATIOS)}}

    return by_batch(spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")), schema, make)


def measured(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Counts and features of texts, a row each."""
    s = np.array([statistics(t) for t in texts], np.float64).reshape(-1, 8)
    return s[:, :5].astype(np.int64), ratios(s, np.array([(t or "").count("\n") + 1 for t in texts], np.float64))


def _expected(n: np.ndarray | float) -> np.ndarray:
    """Mean path length of an unsuccessful search among ``n`` rows."""
    n = np.asarray(n, float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + np.euler_gamma) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


@dataclass
class Forest:
    """Trees as arrays over nodes: split feature (-1 at a leaf), split value, left child (right is the next), path length at a leaf."""

    feature: np.ndarray
    value: np.ndarray
    left: np.ndarray
    path: np.ndarray
    rows: int
    columns: tuple[int, ...] = ()
    threshold: float = math.inf

    @classmethod
    def grow(cls, data: np.ndarray, trees: int = TREES, rows: int = TREE_ROWS, seed: int = SEED) -> Forest:
        rng = np.random.default_rng(seed)
        rows = min(rows, len(data))
        deepest = max(1, math.ceil(math.log2(max(rows, 2))))
        size = 1 << deepest + 1
        feature, value = np.full((trees, size), -1), np.zeros((trees, size))
        left, path = np.zeros((trees, size), np.int64), np.zeros((trees, size))
        for t in range(trees):
            todo, used = [(0, data[rng.choice(len(data), rows, replace=False)], 0)], 1
            while todo:
                node, part, depth = todo.pop()
                low, high = part.min(axis=0), part.max(axis=0)
                can = np.flatnonzero(high > low)
                if depth == deepest or len(part) < 2 or not len(can):
                    path[t, node] = depth + _expected(len(part))
                    continue
                f = int(rng.choice(can))
                v = rng.uniform(low[f], high[f])
                feature[t, node], value[t, node], left[t, node] = f, v, used
                below = part[:, f] <= v
                todo += [(used, part[below], depth + 1), (used + 1, part[~below], depth + 1)]
                used += 2
        return cls(feature, value, left, path, rows)

    def scores(self, data: np.ndarray) -> np.ndarray:
        """2 ** -(mean path / expected path): near 1 for what few splits isolate."""
        total = np.zeros(len(data))
        each = np.arange(len(data))
        data = data[:, list(self.columns)] if self.columns else data
        for feature, value, left, path in zip(self.feature, self.value, self.left, self.path, strict=True):
            node = np.zeros(len(data), np.int64)
            while True:
                f = feature[node]
                inner = f >= 0
                if not inner.any():
                    break
                step = left[node] + (data[each, np.maximum(f, 0)] > value[node])
                node = np.where(inner, step, node)
            total += path[node]
        return 2.0 ** (-total / len(self.feature) / max(float(_expected(self.rows)), 1e-9))


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, loss: float = GOOD_LOSS) -> list[Forest]:
    """A forest for each group on at most ``rows`` labelled rows of each quality, those of the least hash of doc_id; none without labels.

    Rows that fail the base rules are judged already and left out.
    """
    known = labels.where("quality in (0, 1)").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    sampled = [known.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows) for q in (0, 1)]
    quality = {r["doc_id"]: r["quality"] for part in sampled for r in part.collect()}
    # At most 2 x rows ids: a bound that doesn't grow with the table.
    ids = docs.sparkSession.createDataFrame([(i,) for i in quality], "doc_id long")
    names = [f"f_{r}" for r in RATIOS]
    got = count_rules(docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id", "left_semi")).dropDuplicates(["doc_id"]).select("doc_id", "n_words", "n_repeat_words", *names).collect()
    got.sort(key=lambda r: r["doc_id"])
    rows_of = {q: [r for r in got if quality[r["doc_id"]] == q and not _fails(r["n_words"], r["n_repeat_words"])] for q in (0, 1)}
    good, bad = (np.array([[r[n] for n in names] for r in rows_of[q]], float).reshape(-1, len(names)) for q in (1, 0))
    return [] if len(good) < 2 else [_calibrated(good, bad, tuple(map(RATIOS.index, group)), loss) for group in GROUPS]


def _fails(words: int, repeats: int) -> bool:
    return words < MIN_WORDS or 100 * repeats > MAX_REPEAT_PERCENT * words


def _calibrated(good: np.ndarray, bad: np.ndarray, columns: tuple[int, ...], loss: float) -> Forest:
    """A forest grown on one half of the rows, its threshold set on the other; on the same few where there are no others."""
    grown, held = ((good[::2], bad[::2]), (good[1::2], bad[1::2])) if len(good) >= 4 else ((good, bad), (good, bad))
    forest = Forest.grow(np.concatenate(grown)[:, list(columns)])
    forest.columns = columns
    least, scores = float(np.quantile(forest.scores(held[0]), 1 - loss, method="higher")), forest.scores(held[1])
    caught = scores[scores > least + 1e-9]
    if len(caught) and len(caught) >= BAD_CAUGHT * len(held[1]):
        forest.threshold = (least + float(caught.min())) / 2
    return forest


def verdicts(counts: np.ndarray, features: np.ndarray, forests: list[Forest]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """base_failed, kept and the greatest excess of a score over its threshold; without forests only the base rules speak."""
    over = np.max([np.full(len(features), -1.0), *(f.scores(features) - f.threshold for f in forests)], axis=0)
    failed = (counts[:, 0] < MIN_WORDS) | (100 * counts[:, 4] > MAX_REPEAT_PERCENT * counts[:, 0])
    return failed, ~failed & (over <= 0), over


def assess(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Counts and verdict for every row of ``docs`` (doc_id, text).

    A null text has no words and fails the base rules; a text may be as long as a value
    can be.  Repeated rows get equal rows,
    also where a doc_id is null (it can't be labelled); an empty table gives none;
    labels other than 0 and 1 are left out, and of several the best counts.
    """
    forests = fit(docs, labels)

    def make(c: dict) -> dict:
        counts, features = measured(c["text"].to_pylist())
        failed, kept, over = verdicts(counts, features, forests)
        return {"doc_id": c["doc_id"], **dict(zip(COUNTS, counts.T, strict=True)), "base_failed": failed, "kept": kept, "excess": over}

    schema = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, excess double"
    return by_batch(spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")), schema, make)


def keep(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all columns, that ``assess`` keeps; judged where they are read, without a shuffle.

    Null, empty and short texts go; repeated rows stay or go together; an empty table
    gives no rows; columns may have any name.
    """
    forests = fit(docs, labels)
    to, names = to_arrow_schema(docs.schema), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts(batches):
            counts, features = measured(b.column("text").to_pylist())
            _, kept, _ = verdicts(counts, features, forests)
            yield pa.RecordBatch.from_arrays([b.column(n).cast(to.field(n).type) for n in names], schema=to).filter(pa.array(kept))

    return spread(docs).mapInArrow(run, docs.schema)
