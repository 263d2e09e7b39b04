"""Surrogates where a type's first space is smaller than the entities, and spaces that are permuted."""

import re

import pytest
from pyspark.sql import functions as F

from planewise.llm import surrogates

KEY = surrogates.Key("k")


def _entities(df):
    return df.select("kind", "canon", F.lit(0).alias("gender"), F.lit(False).alias("mixed"))


def _settled(df, others=True):
    found = surrogates.assign(_entities(df), KEY).collect()
    made = {r["surrogate"] for r in found}
    assert len(made) == len(found) and not any(r["surrogate"] == r["canon"] for r in found)
    assert not others or not made & {r["canon"] for r in found}
    return found


def test_thousand_one_letter_mails(spark):
    mails = [f"{chr(97 + i % 26)}@host{i}.com" for i in range(1000)]
    df = spark.createDataFrame([(i, f"write {m} now") for i, m in enumerate(mails)], "doc_id long, text string")
    texts = [r["text"] for r in surrogates.surrogates(df, "k").collect()]
    assert len(set(texts)) == 1000 and all(re.fullmatch(r"write [a-z]+@example\.com now", t) for t in texts)
    assert not {t.split()[1] for t in texts} & set(mails)


@pytest.mark.parametrize("block", ["192.168", "172.31", "169.254"])
def test_all_addresses_of_a_private_block(spark, block):
    every = spark.range(65536).select(F.lit("IPV4").alias("kind"), F.concat(F.lit(f"{block}."), F.floor(F.col("id") / 256).cast("string"), F.lit("."), (F.col("id") % 256).cast("string")).alias("canon"))
    found = _settled(every, others=False)
    assert len(found) == 65536 and all(r["attempt"] == 0 and re.match(surrogates.PRIVATE, r["surrogate"]) for r in found)
    assert {r["surrogate"].split(".")[0] for r in found} == {block.split(".")[0]}


def test_short_phone_numbers_get_longer(spark):
    df = spark.range(60_000).select(F.lit("PHONE").alias("kind"), F.lpad((F.col("id") + 10_000).cast("string"), 5, "0").alias("canon"))
    found = _settled(df)
    assert len(found) == 60_000 and {len(r["surrogate"]) for r in found} >= {5, 6}
    text = spark.range(1).selectExpr(f"{surrogates.replacement("'+1 23 45'", f"map('PHONE|12345', {5 * 4})", KEY)}.new AS t").first()["t"]
    assert re.fullmatch(r"\+\d \d\d \d{4}", text)


def test_later_names_have_more_syllables(spark):
    made = spark.range(8).selectExpr(f"{surrogates.surrogate_of("'SURNAME'", "'weber'", "0", "CAST(id AS INT)", KEY)} AS s", "id").orderBy("id").collect()
    assert [len(r["s"]) for r in made] == [7, 7, 7, 7, 9, 11, 13, 15]
