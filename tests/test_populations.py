"""Worlds drawn in tasks: the same rows whatever the partitions and the size, with the shares and moments they should have."""

import collections

import numpy as np
from pyspark.sql import functions as F

from planewise.sources import generators, populations


def rows(df):
    return {r.object_id: (r.pos, r.label, r.generator_component, tuple(r.vec)) for r in df.collect()}


def test_populations_are_those_of_the_small_world(spark):
    """Counts, order and labels of fixed populations agree; curves agree to the last digit but one."""
    vectors, labels, names = generators.belief_world(1000)
    found = sorted(rows(populations.belief_world(spark, 1000)).values())
    assert [r[0] for r in found] == list(range(len(names)))
    assert [r[2] for r in found] == names
    same = [(r, v, x) for r, v, x in zip(found, vectors, labels, strict=True) if r[2] != "isolated_outlier"]
    assert all(r[1] == x for r, _, x in same)
    assert all(np.allclose(r[3], v, atol=1e-12) for r, v, _ in same if r[2] in ("narrow_bridge_02", "evidence_trajectory"))
    assert all(r[1] == f"class_{int(np.argmax(r[3]))}" for r in found if r[2] == "isolated_outlier")
    assert all(abs(sum(r[3]) - 1) < 1e-9 and min(r[3]) >= 0 for r in found)


def test_rows_depend_on_seed_population_and_number_alone(spark):
    """More rows, other partitions: the same first rows; another seed or name: others."""
    few = {r.i: tuple(r.vec) for r in populations.dirichlet(spark, "x", 5000, 7, [2.0, 3.0]).collect()}
    more = {r.i: tuple(r.vec) for r in populations.dirichlet(spark, "x", 9000, 7, [2.0, 3.0]).repartition(3).collect()}
    assert len(more) == 9000 and len(set(more.values())) == 9000
    assert few == {i: v for i, v in more.items() if i < 5000}
    first = lambda name, seed: tuple(populations.dirichlet(spark, name, 1, seed, [2.0, 3.0]).first().vec)
    assert len({first("x", 7), first("y", 7), first("x", 8)}) == 3


def test_moments_of_a_large_population(spark):
    """Means and variances of 200,000 Dirichlet points, computed where they are drawn."""
    a = np.array([50.0, 2.0, 2.0, 2.0])
    got = populations.dirichlet(spark, "corner", 200_000, 1, list(a)).agg(F.count("*"), *(f(F.col("vec")[k]) for k in range(4) for f in (F.avg, F.var_pop))).first()
    mean = a / a.sum()
    assert got[0] == 200_000
    assert np.allclose(got[1::2], mean, atol=5e-4) and np.allclose(got[2::2], mean * (1 - mean) / (a.sum() + 1), rtol=0.03)


def test_apparel_and_empty_worlds(spark):
    found = rows(populations.apparel_world(spark, 3000))
    assert collections.Counter(r[1] for r in found.values()) == {f"class_{c}": 300 for c in range(10)}
    beliefs, labels = generators.apparel_beliefs(3000)
    mean = lambda vs: np.mean(list(vs), axis=0)
    for c in range(10):
        assert np.allclose(mean(r[3] for r in found.values() if r[1] == f"class_{c}"), mean(v for v, x in zip(beliefs, labels, strict=True) if x == f"class_{c}"), atol=0.03)
    assert populations.apparel_world(spark, 0).collect() == []
    assert [r[2] for r in rows(populations.belief_world(spark, 0)).values()] == ["isolated_outlier"]
