"""The dataset manifest, spelling variants and source mixing against plain versions and their SQL."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import duckdb
import pytest

from planewise.llm import merkle, mixing, queries, spelling
from planewise.llm.common import table

DOCS = "doc_id long, source string, lang string, n_chars int, text string"


def _made(spark, rows):
    """Rows with further columns whose names the operators use themselves."""
    names = "grp string, pos int, part string, digest string, path string, size string, word string, near string, n int, run string, time string"
    return spark.createDataFrame([(*r, "x", 1, "p", "d", "q", "s", "w", "v", 2, "r", "t") for r in rows], f"{DOCS}, {names}")


@pytest.mark.parametrize("name", ["op11_merkle", "op12_spelling", "op13_mixing"])
def test_queries_give_the_rows_of_their_sql(spark, sf_dir, name):
    df = queries.queries()[name](spark, sf_dir)
    with duckdb.connect() as db:
        db.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
        wanted = db.sql(f"SELECT {', '.join(df.columns)} FROM ({queries.oracle_sql()[name]})").fetchall()
    assert collections.Counter(map(tuple, df.collect())) == collections.Counter(wanted)


# -- 11: manifest ------------------------------------------------------------------------------------


def _h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _leaf(doc_id, source, lang, n_chars, text):
    return _h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def _climb(nodes):
    """What remains, and for each lowest node its siblings left and right at each level."""
    paths, level, at = [[] for _ in nodes], list(nodes), list(range(len(nodes)))
    while len(level) > 1:
        for k, p in enumerate(paths):
            first = at[k] // 16 * 16
            p.append(("".join(level[first : at[k]]), "".join(level[at[k] + 1 : first + 16])))
            at[k] //= 16
        level = [_h(*level[i : i + 16]) for i in range(0, len(level), 16)]
    return level[0], paths


def _plain_manifest(rows):
    groups = collections.defaultdict(list)
    for r in rows:
        groups[r[1]].append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    subs = {}
    for s in order:
        own = sorted(groups[s], key=lambda r: (r[0] is not None, r[0] or 0, _leaf(*r)))
        subs[s] = (own, *_climb([_leaf(*r) for r in own]))
    root, above = _climb([subs[s][1] for s in order])
    out = []
    for s, up in zip(order, above, strict=True):
        own, subroot, paths = subs[s]
        for r, path in zip(own, paths, strict=True):
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None
            text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r[4]) if tampered else r[4]
            x = _leaf(*r[:4], text)
            for left, right in path + up:
                x = _h(left, x, right)
            out.append((r[0], _leaf(*r), subroot, root, _h(*(a + b for a, b in path + up)), x, x == root))
    return collections.Counter(out)


ODD = [(1, "a", "en", 3, "Abc"), (1, "a", "en", 3, "Abc"), (1, "a", "en", 3, "Abd"), (None, "a", None, None, None), (2, None, "de", 0, ""), (None, None, None, None, None), (-7, "", "x", -1, "É LONG " * 30_000), (3, "-", "en", 1, "Z"), (4, "=", "en", 1, "Z"), (5, "ä", "en", 1, "日本 A"), (6, "\U0001f600", "en", 1, "Q"), (7, "￿", "en", 1, "Q")]


def test_manifest_of_odd_rows(spark):
    got = collections.Counter(map(tuple, merkle.manifest(_made(spark, ODD)).collect()))
    assert got == _plain_manifest(ODD)


def test_manifest_of_trees_of_several_levels(spark):
    """Run borders, a hot source of four levels and more sources than a run holds."""
    rows = [(i, "hot", "en", i, f"Text {i}") for i in range(4_100)]
    rows += [(10_000 + 100 * k + i, f"s{k}", "en", i, "T") for k, n in enumerate([1, 2, 15, 16, 17, *[1] * 30]) for i in range(n)]
    random.Random(5).shuffle(rows)
    got = collections.Counter(map(tuple, merkle.manifest(_made(spark, rows).repartition(7)).collect()))
    assert got == _plain_manifest(rows)
    assert {r[6] for r in got} == {True, False}


def test_manifest_of_one_row_and_none(spark):
    one = [(1, "a", "en", 3, "abc")]
    assert collections.Counter(map(tuple, merkle.manifest(_made(spark, one)).collect())) == _plain_manifest(one)
    assert merkle.manifest(_made(spark, [])).collect() == []


# -- 12: spelling ------------------------------------------------------------------------------------


def _plain_groups(rows):
    n = collections.Counter()
    for doc_id, *_, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            k = h % len(run)
            n[run if h % 199 else run[:k] + run[k + 1 :]] += 1
    n = {w: c for w, c in n.items() if len(w) >= 6 and c >= 5}
    near = collections.defaultdict(set)
    meet = collections.defaultdict(set)
    for w in n:
        for i in range(len(w)):
            if (v := w[:i] + w[i + 1 :]) in n:
                near[w].add(v)
                near[v].add(w)
            meet[w[:i] + "\0" + w[i + 1 :]].add(w)
    for own in meet.values():
        for a, b in itertools.permutations(own, 2):
            near[a].add(b)
    form = {w: f for w in n if near[w] and n[f := min(near[w], key=lambda v: (-n[v], v))] >= 5 * n[w]}
    out = set()
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n[w], len(near[w]), n.get(form.get(w))))
    return out


def _words(rng):
    """A chain of forms, equal letters, accents, capitals, ties, short words and words beyond the border of both ways."""
    base = ["letter", "lettter", "letteer", "ledter", "letttter", "aaaaaa", "aaaaaaa", "aaaaab", "zurück", "zuruck", "Zurück", "straße", "strasse", "÷×÷×÷×", "÷×÷×÷", "short", "abcdef", "abcdeg", "abcdeh"]
    long = ["".join(rng.choice("abcdexyz") for _ in range(m)) for m in (62, 63, 64, 65, 66, 200)]
    edits = [w[:30] + w[31:] for w in long] + [w[:7] + "é" + w[8:] for w in long] + [w[:3] + w[3] + w[3:] for w in long] + ["b" * m for m in (63, 64, 65, 66, 67)]
    counts = {"letter": 700, "lettter": 120, "letteer": 120, "ledter": 20, "letttter": 20, "zurück": 60}
    return [(w, counts.get(w, rng.choice([3, 5, 6, 30]))) for w in dict.fromkeys(base + long + edits)]


def test_groups_match_brute_force(spark):
    rng = random.Random(3)
    bag = [w for w, k in _words(rng) for _ in range(k)]
    rng.shuffle(bag)
    rows = [(i, "s", "en", 0, " 1".join(bag[i::40])) for i in range(40)] + [(None, "s", "en", 0, "abcdef abcdef"), (3, "s", "en", 0, None), (3, "s", "en", 0, ""), (3, "s", "en", 0, "zuruck " * 40_000)]
    found = set(map(tuple, spelling.group(_made(spark, rows)).collect()))
    wanted = _plain_groups(rows)
    assert found == wanted
    assert sum(w[4] > 0 and len(w[0]) > 64 for w in wanted) > 5 and sum(w[1] is not None for w in wanted) > 5 and any(w[2] not in (w[0], w[1]) for w in wanted)


def test_shuffled_candidates_give_the_same(spark, sf_dir, monkeypatch):
    docs = table(spark, sf_dir, "documents")
    wanted = set(map(tuple, spelling.group(docs).collect()))
    monkeypatch.setattr(spelling, "BROADCAST_WORDS", 10)
    assert set(map(tuple, spelling.group(docs).collect())) == wanted


def test_long_words_alone_and_very_long_ones(spark):
    rng = random.Random(4)
    for size in (800, 200_000):
        w = "".join(rng.choice("acgt") for _ in range(size))
        rows = [(i, "s", "en", 0, f"{w} {w[:-1]} {w[:9]}x{w[10:]}") for i in range(6)]
        found = set(map(tuple, spelling.group(_made(spark, rows)).collect()))
        one, gone, other = w, w[:-1], w[:9] + "x" + w[10:]
        assert found == {(one, None, one, 6, 2, None), (gone, None, gone, 6, 1, None), (other, None, other, 6, 1, None)}
        if size < 1000:
            assert found == _plain_groups(rows)


def test_no_words(spark):
    for rows in ([], [(1, "s", "en", 0, None), (2, "s", "en", 0, "12 ab")]):
        out = spelling.group(_made(spark, rows))
        assert out.columns == ["word", "form", "root", "n", "n_near", "form_n"] and out.collect() == []


# -- 13: mixing --------------------------------------------------------------------------------------


def _filled(sizes):
    """Targets by resharing what is above twice a size, again and again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    budget, full = 1.5 * sum(sizes.values()), set()
    while True:
        rest = budget - sum(2 * sizes[s] for s in full)
        open_ = [s for s in order if s not in full]
        target = {s: 2.0 * sizes[s] if s in full else rest * weight[s] / sum(weight[t] for t in open_) for s in order}
        above = {s for s in open_ if target[s] > 2 * sizes[s]}
        if not above:
            return target
        full |= above


MIXED = [(i, f"s{i % 7}" if i % 5 else None, "en", 0, "w " * (i * 37 % 90)) for i in range(400)] + [(1, "s1", "en", 0, None), (None, "s2", "en", 0, "a\x1cb c"), (None, "s2", "en", 0, "a\x1cb c"), (7, "S", "en", 0, "x " * 30_000), (8, "empty", "en", 0, " \n")]


def test_mix_reaches_its_targets(spark):
    df = mixing.mix(_made(spark, MIXED))
    rows = df.collect()
    assert collections.Counter((r["doc_id"], r["size"]) for r in rows) == collections.Counter((r[0], len(re.findall(r"[^\x20\x09-\x0D]+", r[4] or ""))) for r in MIXED)
    size, source = collections.Counter(), {}
    for r in MIXED:
        size[r[1]] += len(re.findall(r"[^\x20\x09-\x0D]+", r[4] or ""))
        source[r[0]] = r[1]
    target = _filled(size)
    taken, largest = collections.Counter(), collections.Counter()
    by_size = {size[s]: s for s in size}
    for r in rows:
        s = by_size[r["source_size"]]
        assert r["target"] == pytest.approx(target[s]) and r["taken"] in (0, r["size"], 2 * r["size"])
        taken[s] += r["taken"]
        largest[s] = max(largest[s], r["size"])
    slack = sum(largest.values()) / 1.5 / sum(size.values())  # the end of the budget, as a share of it
    assert all(abs(taken[s] - target[s]) <= largest[s] / 2 + slack * target[s] + 1 for s in size)
    assert abs(sum(taken.values()) - 1.5 * sum(size.values())) <= max(largest.values())


def test_mix_depends_on_no_partitions(spark):
    one = collections.Counter(map(tuple, mixing.mix(_made(spark, MIXED)).collect()))
    many = collections.Counter(map(tuple, mixing.mix(_made(spark, MIXED[::-1]).repartition(9)).collect()))
    assert one == many
    assert collections.Counter(map(tuple, mixing.mix(_made(spark, MIXED), "other").collect())) != one


def test_mix_of_nothing(spark):
    assert mixing.mix(_made(spark, [])).collect() == []
    assert [r["taken"] for r in mixing.mix(_made(spark, [(1, None, None, None, None), (2, "a", "", 0, " ")])).collect()] == [0, 0]


def test_mix_stays_in_the_jvm(spark, sf_dir):
    plan = mixing.mix(table(spark, sf_dir, "documents"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
