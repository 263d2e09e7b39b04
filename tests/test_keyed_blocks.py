"""Blocks by keys against the plain meeting: neighbours, ranks, sums; most pairs are never measured."""

from dataclasses import replace

import numpy as np
import pandas as pd
import pytest

from planewise.functions.metrics import REGISTRY
from planewise.operators import blocks

KEYED = [m for m in REGISTRY.ids() if REGISTRY.get(m).key]


def _plain(metric, **more):
    m = REGISTRY.get(metric)
    return replace(m, combine=None, prepare=None, **more)


def _frame(n, dimension, views, copies, scale=1.0):
    p = np.random.default_rng(5).dirichlet(np.ones(dimension), n)
    if copies:
        p = np.round(p * 4) / 4
        p[:, -1] = 0
    s = np.sqrt(p) * scale
    columns = {f"s{k}": s[:, k] for k in range(dimension)} | {f"{c}{v}": p[:, 2 * v + i] for v in range(views) for i, c in enumerate("xy")}
    return pd.DataFrame(columns | {"object_id": [f"o{i:05d}" for i in range(n)]})


@pytest.mark.parametrize("metric", KEYED)
@pytest.mark.parametrize(("copies", "scale"), [(False, 1.0), (True, 1.0), (False, 30.0)])
def test_keys_change_nothing(monkeypatch, metric, copies, scale):
    for name, value in (("KEYED_COLUMNS", 97), ("SUMMED_COLUMNS", 41), ("BESIDE", 20), ("SORTED_FROM", 3 if copies else 50)):
        monkeypatch.setattr(blocks, name, value)
    points = _frame(500, 7, 3, copies, scale if metric == "euclidean" else 1.0)
    left, right = points.sample(120, random_state=1), points.sample(450, random_state=2)
    right = pd.concat([right, right.iloc[:3]])  # ids that stand twice
    out = []
    for m in (_plain(metric), _plain(metric, key=None)):
        meeting = blocks._Meeting(m, 7, 3, 5)
        near = meeting.nearest(left, right, (0, 1, 2, 3), True)
        found = near[near["i"].notna()].sort_values(["i", "j", "r0", "r1"]).reset_index(drop=True)
        held = found.drop(columns=["hh", "ll", "hl"]).rename(columns={"i": "object_id"}).merge(points, on="object_id").assign(r0=6, r2=6)
        counted = meeting.nearer(held, right, (0, 2)).sort_values(["i", "j", "c0", "c2"]).reset_index(drop=True)
        sums = blocks._Sums(m, 7)
        out.append((found, counted, near[near["i"].isna()][["hh", "ll", "hl"]].to_numpy(), sums.means(left, right).to_numpy(), sums.ratios(left, right, 1e-6)))
    (found, counted, totals, means, ratios), plain = out[0], out[1]
    pd.testing.assert_frame_equal(found, plain[0], check_exact=True, check_dtype=False)
    pd.testing.assert_frame_equal(counted, plain[1], check_exact=True, check_dtype=False)
    assert totals == pytest.approx(plain[2], rel=1e-10) and means == pytest.approx(plain[3], rel=1e-10)
    assert ratios["ratio"].to_numpy() == pytest.approx(plain[4]["ratio"].to_numpy(), rel=1e-8) and (ratios["n"] == plain[4]["n"]).all()


def test_few_pairs_are_measured():
    """Entry by entry only what keys leave open; all 4 million pairs before."""
    measured, m = [], _plain("fisher_rao")
    counting = replace(m, block=lambda a, b: measured.append(np.broadcast(a[0], b[0]).size) or m.block(a, b))
    points = _frame(4000, 7, 1, False)
    near = blocks._Meeting(counting, 7, 1, 5).nearest(points[:1000], points, (0,), False)
    assert near["i"].nunique() == 1000 and sum(measured) < 400_000


@pytest.mark.parametrize("bad", [np.nan, np.inf])
def test_numbers_that_are_not_finite(bad):
    points = _frame(40, 4, 1, False)
    points.loc[3, "s1"] = bad
    found = [blocks._Meeting(m, 4, 1, 3).nearest(points, points, (0, 1), False) for m in (_plain("euclidean"), _plain("euclidean", key=None))]
    pd.testing.assert_frame_equal(*found)


def test_counts_in_a_plane_are_of_a_window(monkeypatch):
    """Ranks in a plane are counted within reach along its first axis: keys of all pairs were compared before."""
    points, seen = _frame(6000, 7, 1, False), []
    monkeypatch.setattr(blocks._Keyed, "keys", lambda self, measure, rows, c, e, f=blocks._Keyed.keys: seen.append(measure * len(rows) * (e - c)) or f(self, measure, rows, c, e))
    meeting = blocks._Meeting(_plain("fisher_rao"), 7, 1, 5)
    near = meeting.nearest(points[:1000], points, (1,), False)
    exact = blocks._Meeting(_plain("fisher_rao", key=None), 7, 1, 5).nearest(points[:1000], points, (1,), False)
    order = lambda x: x[["i", "j", "r1"]].sort_values(["i", "j"]).reset_index(drop=True)
    pd.testing.assert_frame_equal(order(near), order(exact), check_dtype=False)
    assert 0 < sum(seen) < 0.9 * 1000 * 6000
    assert blocks._counted(np.ones((3, 2 * blocks.LANES), bool)).tolist() == [2 * blocks.LANES] * 3


def test_blocks_of_sums_meet_once(spark, monkeypatch):
    """Distances are the same both ways, so sums need half of the pairs; all blocks met all before."""
    monkeypatch.setattr(blocks, "RIGHT_ROWS", 40)
    points, m = _frame(300, 4, 1, True), _plain("hellinger")
    met = spark.sparkContext.accumulator(0)
    whole, sums = blocks._Sums(m, 4), blocks._Sums.squares
    monkeypatch.setattr(blocks._Sums, "squares", lambda self, a, b, twice=False: met.add(len(a) * len(b)) or sums(self, a, b, twice))
    placed = spark.createDataFrame(points)
    found = blocks.square_sums(placed, 4, m, 300).toPandas().sum()
    assert met.value < 0.65 * 300 * 300
    assert found.to_numpy() == pytest.approx(sums(whole, points, points).to_numpy()[0], rel=1e-10)
    ratios = blocks.ratio_sums(placed, 4, m, 300, 1e-6).toPandas().sort_values("i")
    plain = whole.ratios(points, points, 1e-6)
    assert ratios["ratio"].to_numpy() == pytest.approx(plain.groupby("i")["ratio"].sum().to_numpy(), rel=1e-10)
    assert ratios["n"].to_numpy().tolist() == plain.groupby("i")["n"].sum().tolist()
