"""The filter before the pattern passes every text that has an entity."""

import pytest

from planewise.llm import surrogates

ALONE = {
    "SECRET": ["AKIA" + "QWERTYUIOPASDFGH", "ghp_" + "qwertyuiopasdfghjklz" + "QWERTYUIOPASDFGH", "gho_" + "abcdefghijklmnopqrst" + "abcdefghijklmnop", "abcdef" * 6, "FEDCBA" * 7],
    "IPV6": ["fe:ab:cd:ef:a:b:c:d", "ABCD:EF:FE:DC:BA:AB:CD:EFEF"],
    "EMAIL": ["a@b.com"],
    "PERSON": ["Dr. Weber", "Frau Weber", "Mr Anna Weber"],
}


@pytest.mark.parametrize("kind", ALONE)
def test_entities_alone_in_a_text_are_replaced(spark, kind):
    df = spark.createDataFrame([(i, f"see {m} here") for i, m in enumerate(ALONE[kind])], "doc_id long, text string")
    got = surrogates.surrogates(df, "k").collect()
    assert [(r["n_mentions"], r["kinds"]) for r in got] == [(1, [kind])] * len(got)
    assert not {r["text"] for r in got} & {f"see {m} here" for m in ALONE[kind]}
