"""Surrogates keep forms and stand for one entity, whatever its title; odd and long texts come through."""

import re

import pytest

from planewise.llm import surrogates


def _texts(spark, texts, **settings):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r["text"] for r in surrogates.surrogates(df, "k", **settings).orderBy("doc_id").collect()]


def _mod97(iban):
    x = iban.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97


@pytest.mark.parametrize("most_inline", [1000, 0])
def test_one_person_under_several_titles(spark, most_inline):
    """Also where another text tells the gender; later mentions without a title follow, common words don't."""
    one, two, three = _texts(spark, ["Dr Anna Schmidt met Frau Anna Schmidt. Anna Schmidt left, Anna's hat too.", "Prof. Anna Berg", "Mr. Brown had brown bread. Brown sugar. Herr Kim, Frau Kim Lee and Kim."], most_inline=most_inline)
    found = re.fullmatch(r"Dr (\w+) (\w+) met Frau (\w+) (\w+)\. (\w+) (\w+) left, (\w+)'s hat too\.", one)
    assert found and len({found[k] for k in (1, 3, 5, 7)}) == 1 and len({found[k] for k in (2, 4, 6)}) == 1
    assert found[1].endswith("na") and "Anna" not in one and "Schmidt" not in one
    assert re.fullmatch(rf"Prof\. {found[1]} \w+", two)
    assert three.startswith("Mr. ") and "brown bread. Brown sugar" in three and "Mr. Brown" not in three and "Kim" not in three


def test_names_keep_marks_and_script(spark):
    one, two = _texts(spark, ["Mr O'Neil, Mrs. J. R. Smith-Jones, Dr. Νίκος", "κωστας@mail.gr иван.п@mail.ru שלום@mail.il"])
    assert re.fullmatch(r"Mr [A-Z]'[A-Z][a-z]+, Mrs\. J\. R\. [A-Z][a-z]+-[A-Z][a-z]+, Dr\. [\u0370-\u03ff]+", one) and "Neil" not in one
    assert re.fullmatch(r"[\u0370-\u03ff]{6}@example\.gr [\u0400-\u04ff]{4}\.[\u0400-\u04ff]@example\.ru [\u0590-\u05ff]{4}@example\.il", two)


def test_accounts_addresses_and_hosts(spark):
    (out,) = _texts(spark, ["GB82 WEST 1234 5698 7654 32 then DE89370400440532013000 at 2001:db8::1, 2001:0DB8:0:0:0:0:0:1 std::find ::1 by bob@mail.acme.com"])
    a, b, c, d = re.fullmatch(r"(GB\d\d [A-Z]{4}(?: \d{4}){3} \d\d) then (DE\d{20}) at ([0-9a-f]{4}:[0-9a-f]{3}::[0-9a-f]), ([0-9A-F]{4}:0[0-9A-F]{3}:0:0:0:0:0:[0-9A-F]) std::find ::1 by \w{3}@\w{4}\.example\.com", out).groups()
    assert _mod97(a) == _mod97(b) == 1 and "acme" not in out and "mail" not in out
    assert [x.lower().lstrip("0") for x in d.replace(":0:0:0:0:0:", "::").split(":")] == [x for x in c.split(":")]


def test_long_and_hostile_texts(spark):
    """Ten million characters, a host of two thousand labels, a local part of 100,000 letters."""
    big = ("Mr. John Smith wrote of 555-123-4567 to John, again. " + "and so on with words of no note " * 160) * 2_000
    labels, local, long_, dots = _texts(spark, ["a@b" + ".c1" * 2000 + ".com x", "a" * 100_000 + "@b.com y", big, "x@" + "." * 50_000 + "é" * 50_000])
    assert re.fullmatch(r"\w@[\w.]+\.example\.com x", labels) and re.fullmatch(r"[a-z]{64}@example\.com y", local)
    assert "John" not in long_ and "555-123-4567" not in long_ and len(long_.split()) == len(big.split()) and len(dots) == 100_002


def test_own_columns_of_any_name(spark):
    """A column that is called like one of the operator's own keeps its values, and none gets raw mentions."""
    names = ["text", "found", "row", "changed", "hash", "known", "__mentions"]
    df = spark.createDataFrame([("call 317-555-7713", *"abcdef"), (None, *"abcdef")], ", ".join(f"{n} string" for n in names))
    for most in (1000, 0):
        rows = surrogates.replaced(df, "k", most_inline=most).collect()
        assert all(tuple(r)[1:] == tuple("abcdef") for r in rows) and {r["text"] is None for r in rows} == {True, False}
        assert not any("317-555-7713" in str(r) for r in rows)


def test_a_key_is_needed_and_decides(spark):
    df = spark.createDataFrame([(1, "call 317-555-7713")], "doc_id long, text string")
    with pytest.raises(ValueError, match="secret key"):
        surrogates.replaced(df)
    one, other = (surrogates.replaced(df, k).first()["text"] for k in ("a", "b"))
    assert one != other and re.fullmatch(r"call \d{3}-\d{3}-\d{4}", one)
    spark.conf.set(surrogates.KEY_SETTING, "a")
    try:
        assert surrogates.replaced(df).first()["text"] == one
    finally:
        spark.conf.unset(surrogates.KEY_SETTING)
