"""Neighbours from leaves of a tree: copies, and how large blocks are."""

from dataclasses import replace

import numpy as np
import pandas as pd
import pytest

from planewise.functions.metrics import REGISTRY
from planewise.operators import blocks


@pytest.mark.parametrize("metric", ["fisher_rao", "euclidean"])
def test_copies_are_nobodys_neighbours_but_the_first(monkeypatch, metric):
    """Of equal points only the first k + 1 ids are looked at; in a plane all copies were candidates of all before."""
    p = np.random.default_rng(7).dirichlet(np.ones(4), 1200)
    p[300:1100] = p[300]
    p[20:40, :2] = p[20, :2]
    points = pd.DataFrame({f"s{k}": np.sqrt(p[:, k]) for k in range(4)} | {"x0": p[:, 0], "y0": p[:, 1], "object_id": [f"o{i:04d}" for i in range(1200)]})
    left, right = points.sample(200, random_state=3), pd.concat([points.sample(frac=1, random_state=4), points.iloc[300:320], points.iloc[310:312]])
    m, seen = replace(REGISTRY.get(metric), combine=None, prepare=None), []
    plain = blocks._Meeting(replace(m, key=None), 4, 1, 5).nearest(left, right, (), False)
    monkeypatch.setattr(blocks._Keyed, "best", lambda self, rows, *more, f=blocks._Keyed.best: seen.append(len(rows)) or f(self, rows, *more))
    near = blocks._Meeting(m, 4, 1, 5).nearest(left, right, (), False)
    order = lambda x: x.sort_values(["i", "j", "r0", "r1"]).reset_index(drop=True)
    pd.testing.assert_frame_equal(order(near), order(plain), check_dtype=False)
    assert sum(seen) < 200 * 2 * 40


def test_right_blocks_go_by_their_numbers():
    """150,000 points of 16 numbers are one right block, so that no neighbours are merged; three before."""
    assert blocks.shape(150_000, 12, 16) == (24, 1) and blocks.shape(150_000, 12, 64) == (24, 3)
