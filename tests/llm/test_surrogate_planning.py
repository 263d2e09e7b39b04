"""What planning the surrogates costs the driver."""

from __future__ import annotations

from planewise.llm import surrogates


def test_planning_again_learns_nothing_anew(spark):
    """The parser keeps what it learnt: forgotten, each of the long texts cost some hundred MB again."""
    jvm = spark.sparkContext._jvm
    threads, own = jvm.java.lang.management.ManagementFactory.getThreadMXBean(), jvm.java.lang.Thread.currentThread().getId()
    df = spark.createDataFrame([(1, "call 317-555-7713 or Mr. John Smith at 10.0.0.1"), (2, None)], "doc_id long, text string")
    first = surrogates.replaced(df, "a key for this test").collect()
    before = threads.getThreadAllocatedBytes(own)
    again = surrogates.replaced(df, "a key for this test")
    assert threads.getThreadAllocatedBytes(own) - before < 1_000_000_000
    assert sorted(map(str, again.collect())) == sorted(map(str, first))
