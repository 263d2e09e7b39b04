"""Queries over all customers against brute force."""

import numpy as np
import pytest

from planewise import catalogue

PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
KINDS = ("click", "error", "purchase", "signup", "view")


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    """Shares of 12 customers, half beyond 400, and of 3 users, as tables and as arrays."""
    d, r = str(tmp_path_factory.mktemp("whole")), np.random.default_rng(5)
    out = {}
    for name, key, kind, kinds, prefix, ids in (("orders", "o_custkey", "o_orderpriority", PRIORITIES, "cust_", [*range(1, 7), *range(395, 407, 2)]), ("events", "user_id", "event_type", KINDS, "user_", [1, 2, 3])):
        counts = {i: r.integers(0, 9, 5) + np.eye(5, dtype=int)[i % 5] for i in ids}
        spark.createDataFrame([(i, k) for i, c in counts.items() for k, n in zip(kinds, c, strict=True) for _ in range(n)], f"{key} long, {kind} string").write.parquet(f"{d}/{name}.parquet")
        out[name] = {f"{prefix}{i:08d}": c / c.sum() for i, c in counts.items()}
    return d, out


def _js(a, b):
    m = (a + b) / 2
    kl = lambda p: sum(x * np.log2(x / y) for x, y in zip(p, m, strict=True) if x > 0)
    return np.sqrt(max(0.0, (kl(a) + kl(b)) / 2))


def _aitchison(a, b):
    def clr(p):
        zero = p == 0
        x = np.log(np.where(zero, 1e-6, p * (1 - 1e-6 * zero.sum())))
        return x - x.mean()

    return np.linalg.norm(clr(a) - clr(b))


@pytest.mark.parametrize(("metric", "plain"), [("aitchison", _aitchison), ("jensen_shannon", _js)])
def test_all_customers(spark, made, metric, plain):
    d, tables = made
    mixes, queries = tables["orders"], catalogue.queries()
    want = {(i, j): plain(mixes[i], mixes[j]) for i in mixes for j in mixes if i != j}
    got = {(r["i"], r["j"]): r["distance"] for r in queries[f"dist_{metric}_whole"](spark, d).collect()}
    assert got == pytest.approx({k: v for k, v in want.items() if k[0] < k[1]}, abs=2e-6)
    near = sorted((r["src_id"], r["rank"], r["neighbor_id"]) for r in queries[f"knn_{metric}_whole"](spark, d).collect())
    assert near == [(i, n + 1, j) for i in sorted(mixes) for n, (_, j) in enumerate(sorted((round(want[i, j], 9), j) for j in mixes if j != i)[: catalogue.K])]


def test_all_of_both_sets(spark, made):
    d, tables = made
    got = {(r["i"], r["j"]): r["distance"] for r in catalogue.queries()["dist_cross_sets_whole"](spark, d).collect()}
    want = {(i, j): np.linalg.norm(np.sqrt(a) - np.sqrt(b)) / np.sqrt(2) for i, a in tables["events"].items() for j, b in tables["orders"].items()}
    assert got == pytest.approx(want, abs=2e-6)
