"""Lists of the near-dedup index: every pair that meets is compared, whatever the list's size and order."""

import numpy as np
import pytest

from planewise.llm import similar, simhash

NAMES = [*similar._INDEX, *similar._CHECK]


def _nodes(spark, checks, seed=1):
    """Nodes that meet in one list only: three low bytes of the first stream are equal."""
    r = np.random.default_rng(seed)
    index = r.integers(-(2**63), 2**63, (len(checks), similar.STREAMS), np.int64)
    index[:, 0] = index[:, 0] & ~np.int64(0xFFFFFF) | np.int64(0x123456)
    rows = [(n, *map(int, index[n]), *map(int, checks[n])) for n in range(len(checks))]
    return spark.createDataFrame(rows, "node long, " + ", ".join(f"{n} long" for n in NAMES)).coalesce(1)


def _groups(links):
    return {frozenset(r["nodes"]) for r in simhash.components(links).groupBy("root").agg({"node": "collect_list"}).toDF("root", "nodes").collect()}


def _chain(length, step, seed=2):
    """Checks of a chain of edits: neighbours differ in ``step`` bits, the next but one in twice as many."""
    r = np.random.default_rng(seed)
    bits = r.integers(0, 2, 256).astype(np.uint8)
    order, out = r.permutation(256), []
    for k in range(length):
        out.append(np.packbits(bits).view(np.int64))
        bits = bits.copy()
        bits[order[k * step : (k + 1) * step]] ^= 1
    return np.array(out)


@pytest.mark.parametrize("seed", [3, 4, 5])
def test_chain_across_parts_is_one_group(spark, monkeypatch, seed):
    monkeypatch.setattr(similar, "LIST_ROWS", 3)
    checks = _chain(8, 30)[np.random.default_rng(seed).permutation(8)]
    assert _groups(similar.links(_nodes(spark, checks))) == {frozenset(range(8))}


def test_member_near_two_earlier_groups_joins_them(spark, monkeypatch):
    monkeypatch.setattr(similar, "LIST_ROWS", 2)
    a, between, b = _chain(3, 40)
    assert _groups(similar.links(_nodes(spark, np.array([a, b, between])))) == {frozenset(range(3))}


@pytest.mark.parametrize("members", [11, 60])
def test_pairs_of_a_list_of_many_tasks_are_all_found(spark, monkeypatch, members):
    """Small groups in one hot list: pairs, and a chain of three."""
    monkeypatch.setattr(similar, "SALT_ROWS", 5)
    r = np.random.default_rng(7)
    checks = r.integers(-(2**63), 2**63, (members, similar.CHECKS), np.int64)
    twin = np.arange(members // 3)
    checks[members - 1 - twin] = checks[twin] ^ r.integers(0, 1 << 30, (len(twin), similar.CHECKS)) % 1024
    checks[-4:-1] = _chain(3, 30)
    want = {frozenset((int(k), members - 1 - int(k))) for k in twin if k not in (1, 2, 3)} | {frozenset(range(members - 4, members - 1))}
    assert _groups(similar.links(_nodes(spark, checks))) == want


def test_any_two_members_of_a_hot_list_meet_once(spark, monkeypatch):
    monkeypatch.setattr(similar, "SALT_ROWS", 5)
    checks = np.zeros((30, similar.CHECKS), np.int64)
    assert _groups(similar.links(_nodes(spark, checks))) == {frozenset(range(30))}
