"""Verdicts of the forests against a plain walk down their trees, and texts of ten million characters."""

import re

import numpy as np
import pytest

from planewise.llm import isolation, queries, simhash, similar
from planewise.llm.common import table


def _plain_ratios(text):
    words, lines = re.findall(r"[^\x20\x09-\x0D]+", text), text.split("\n")
    full = [x for x in lines if re.search(r"[^\x20\x09-\x0D]", x)]
    seen = {}
    for i in range(len(words) - 7):
        seen.setdefault(tuple(words[i : i + 8]), []).append(i)
    again = len({j for own in seen.values() if len(own) > 1 for i in own for j in range(i, i + 8)})
    n, chars = max(len(words), 1), max(sum(map(len, words)), 1)
    f = [len(re.findall(r"[#*$%&|<>]", text)) / n, (len(full) - len(set(full))) / len(lines), again / n, text.count("!") / n, sum("A" <= c <= "Z" for c in text) / chars, np.log(chars / n), len(set(words)) / min(n, np.sqrt(n) * 20)]
    return len(words), again, f


def _plain_score(forest, f):
    total, f = 0.0, [f[c] for c in forest.columns]
    for t in range(len(forest.feature)):
        node = 0
        while forest.feature[t][node] >= 0:
            node = forest.left[t][node] + (f[forest.feature[t][node]] > forest.value[t][node])
        total += forest.path[t][node]
    m = forest.rows
    return 2 ** (-total / len(forest.feature) / (2 * (np.log(m - 1) + np.euler_gamma) - 2 * (m - 1) / m))


def test_kept_equals_a_plain_walk(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    forests = isolation.fit(docs, labels)
    kept = {r["doc_id"]: r["kept"] for r in queries.op10_quality_rules(spark, sf_dir).collect()}
    assert forests and any(np.isfinite(f.threshold) for f in forests)
    for r in docs.collect():
        n, again, f = _plain_ratios(r["text"] or "")
        plain = n >= 20 and 100 * again <= 30 * n and all(_plain_score(x, f) <= x.threshold for x in forests)
        assert plain == kept[r["doc_id"]], r["doc_id"]


def test_thresholds_are_set_on_rows_not_grown_on(monkeypatch):
    seen, true = [], isolation.Forest.grow
    monkeypatch.setattr(isolation.Forest, "grow", classmethod(lambda cls, data, **k: seen.append(data) or true(data, **k)))
    r = np.random.default_rng(1)
    good, bad = r.normal(0, 1, (400, 7)), r.normal(0, 1, (80, 7)) + 8 * (np.arange(80) % 4 == 1)[:, None]
    isolation._calibrated(good, bad, (0, 1), 0.01)
    assert len(seen[0]) == 240 and not {tuple(x) for x in seen[0]} & {tuple(x) for x in good[1::2][:, :2]}


@pytest.mark.parametrize("text", ["word " * 2_000_000, "x" * 10_000_000, "a b c d e f g h\n" * 600_000])
def test_ten_million_characters(text):
    counts = isolation.statistics(text)
    assert counts[0] == len(text.split()) and counts[1] == len("".join(text.split()))
    assert 0 <= simhash.fingerprint(text) < 1 << 64 and len(similar.sketch(text)) == similar.STREAMS + similar.CHECKS
