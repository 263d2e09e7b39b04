"""Measured recall of the index and the check for pairs of given shingle similarity."""

import random

import numpy as np
import pytest

from planewise.llm import similar


def _words(r, n):
    return [f"w{r.randrange(10**6)}" for _ in range(n)]


def _shingles(words):
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)}


def _found(a, b):
    """Whether two texts meet in a list, and pass the check."""
    x, y = (np.array(similar.sketch(" ".join(w)), np.int64).view(np.uint64) for w in (a, b))
    same = np.ascontiguousarray(x[: similar.STREAMS] ^ y[: similar.STREAMS]).view(np.uint8).reshape(-1, 8) == 0
    meet = (same[:, :4].sum(axis=1) >= 3).any() or (same[:, 4:].sum(axis=1) >= 3).any()
    return meet, int(np.bitwise_count(x[similar.STREAMS :] ^ y[similar.STREAMS :]).sum()) <= similar.VERIFY_BITS


@pytest.mark.parametrize(("way", "jaccard", "least"), [("edited", 0.70, 0.75), ("edited", 0.80, 0.95), ("cut", 0.80, 0.65), ("cut", 0.85, 0.85), ("continued", 0.85, 0.85), ("edited", 0.45, None)])
def test_recall(way, jaccard, least):
    r, hits = random.Random(11), []
    for _ in range(150):
        a = _words(r, r.randint(120, 600))
        b = a[:]
        if way == "edited":
            places = list(range(len(a)))
            r.shuffle(places)
            while len(_shingles(a) & _shingles(b)) > jaccard * len(_shingles(a) | _shingles(b)):
                b[places.pop()] = f"x{r.randrange(10**6)}"
        elif way == "cut":
            b = a[: int(len(a) * jaccard)]
        else:
            b = a + _words(r, int(len(a) * (1 / jaccard - 1)))
        hits.append(all(_found(a, b)))
    assert np.mean(hits) >= least if least else np.mean(hits) <= 0.02
