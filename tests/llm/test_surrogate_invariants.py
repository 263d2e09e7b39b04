"""What surrogates must be, told by a plain walk over all texts of a table."""

import collections
import re

import pytest
import regex
from pyspark.sql import functions as F

from planewise.llm import surrogates
from planewise.llm.common import table

KEY = surrogates.Key("k")


def _assigned(spark, kind, canons):
    df = spark.createDataFrame([(kind, c, 0, False) for c in canons], "kind string, canon string, gender int, mixed boolean")
    return {r["canon"]: (r["surrogate"], r["attempt"]) for r in surrogates.assign(df, KEY).collect()}


def _full(a):
    left, _, right = a.partition("::")
    left, right = [x for x in left.split(":") if x], [x for x in right.split(":") if x]
    return ":".join(x.zfill(4) for x in left + ["0"] * (8 - len(left) - len(right)) + right)


def _texts(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r["doc_id"]: (r["text"], r["kinds"]) for r in surrogates.surrogates(df, "k").collect()}


def test_short_addresses_do_not_run_out(spark):
    """All 189 addresses of one digit on each side that the pattern finds, in a form that has 225: later attempts reach longer ones."""
    short = [f"{x}::{y}" for x in "0123456789abcdef" for y in "0123456789abcdef" if re.search("[0-9]", x + y)]
    short = [a for a in short if a[0] != "0" and a[-1] != "0"]
    got = _texts(spark, [f"at {a} now" for a in short])
    made = [got[i][0].split()[1] for i in range(len(short))]
    forms = [_full(m) for m in made]
    assert len(set(forms)) == len(short) and not set(forms) & {_full(a) for a in short}
    assert all(got[i][1] == ["IPV6"] for i in got) and any(len(m) > 4 for m in made)


def test_every_form_of_a_group_taken(spark):
    canons = [_full(f"2001:db8::{x:x}") for x in range(1, 3000)]
    made = _assigned(spark, "IPV6", canons)
    assert len({s for s, _ in made.values()}) == len(canons) and not {s for s, _ in made.values()} & set(canons)


@pytest.mark.parametrize(("address", "kept"), [("fe80::1", "fe80:"), ("FE80::1234:5", "FE80:"), ("fd12:3456::9", "fd"), ("fc00:1::2", "fc")])
def test_local_addresses_stay_local(spark, address, kept):
    (text, kinds), = _texts(spark, [f"to {address} it"]).values()
    assert kinds == ["IPV6"] and text.split()[1].startswith(kept) and text.split()[1] != address


def test_public_addresses_do_not_become_local(spark):
    made = _assigned(spark, "IPV6", [_full(f"{x:x}:1:2:3:4:5:6:7") for x in range(0x1000, 0x1800)])
    assert not any(s.startswith("f") for s, _ in made.values())


def test_numbers_that_are_no_cards_stay(spark):
    stay = ["took 1712345678901 ms", "at 20240101123456 then", "id 411111111111112 x"]
    go = ["card 4111111111111111 x", "card 4111 1111 1111 1112 x", "card 4111-1111-1111-1111 x"]
    got = _texts(spark, stay + go)
    assert [got[i] for i in range(3)] == [(t, []) for t in stay]
    assert all(got[i][0] != t and got[i][1] == ["CARD"] for i, t in enumerate(go, 3))
    both = _texts(spark, ["1712345678901 and Mr Weber and 4111111111111111 and weber@x.org"])[0]
    assert both[0].startswith("1712345678901 and Mr ") and both[1] == ["PERSON", "CARD", "EMAIL"] and "Weber" not in both[0]


def test_whole_table_against_a_plain_walk(spark, sf_dir):
    """Around the mentions nothing changes but names that stand again; a mention keeps its type and length class, equal ones become equal, different ones stay different, none becomes a real one."""
    pattern = regex.compile(surrogates.PATTERN.replace("]++@", "]+@"))
    docs = table(spark, sf_dir, "documents").where(F.col("text").isNotNull())
    old = {r["doc_id"]: r["text"] for r in docs.collect()}
    new = {r["doc_id"]: r for r in surrogates.surrogates(docs, "k").collect()}
    luhn = lambda d: sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
    to, n = collections.defaultdict(set), 0
    for i, text in old.items():
        found = [m[0] for m in pattern.finditer(text)]
        if not found:
            assert new[i]["text"] == text
            continue
        rest = pattern.split(new[i]["text"])
        number = [re.fullmatch("[0-9]{13,19}", m) is not None and len(m) != 16 and not luhn(m) for m in found]
        assert [m in new[i]["text"] for m in found] == number and len(new[i]["kinds"]) == number.count(False)
        assert len(rest) == len(found) + 1
        for old_piece, new_piece in zip(pattern.split(text), rest, strict=True):
            same = [a == b for a, b in zip(old_piece.split(), new_piece.split(), strict=True)]
            assert all(x or a[:1].isupper() for x, a in zip(same, old_piece.split(), strict=True))
        pairs = [p for p, x in zip(zip(found, pattern.findall(new[i]["text"]), strict=True), number, strict=True) if not x]
        for (was, now), kind in zip(pairs, new[i]["kinds"], strict=True):
            n += 1
            if kind != "PERSON":
                to[(kind, was.lower())].add(now.lower())
            if kind in ("SSN", "CARD", "PHONE", "IBAN"):
                assert re.sub("[0-9]", "0", was)[:2] == re.sub("[0-9]", "0", now)[:2] and len(was) == len(now)
    assert n > 15 and all(len(v) == 1 for v in to.values())
    made = collections.Counter((k, next(iter(v))) for (k, _), v in to.items() if k in ("EMAIL", "SSN", "IBAN", "SECRET", "IPV4"))
    assert max(made.values()) == 1
    assert not {x for k, x in made if k != "IPV4"} & {x for k, x in to if k != "IPV4"}
