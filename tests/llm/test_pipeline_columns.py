"""The pipeline over nulls, repeats, odd columns and an empty table, stage by stage and as a whole."""

import collections

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from planewise.llm import linededup, similar, surrogates

CLASHING = ["__kept", "__at", "__part", "__start", "__n", "fp", "node", "root", "key", "n", "h", "row", "found", "changed", "known", "hash", "high", "low", "drop", "id_0", "drop_0", "kept_0", "pos", "length", "piece", "shard", "i0", "v0", "a", "b", "component_id", "tokens", "words"]


def _odd(docs):
    """Documents with clashing columns, a text column n_chars, nulls, repeated rows and equal texts under other ids."""
    out = docs.withColumn("n_chars", F.concat(F.lit("about "), F.col("n_chars")))
    some = out.orderBy("doc_id").limit(20)
    null_text = some.limit(2).withColumn("text", F.lit(None).cast("string")).withColumn("doc_id", F.col("doc_id") + 1_000_000)
    no_id = some.limit(3).withColumn("doc_id", F.lit(None).cast("long"))
    again = some.withColumn("doc_id", F.col("doc_id") + 2_000_000)
    out = out.unionByName(null_text).unionByName(no_id).unionByName(again).unionByName(some)
    for c in CLASHING:
        out = out.withColumn(c, F.lit("x"))
    return out


@pytest.fixture(scope="module")
def odd_dir(spark, sf_dir, tmp_path_factory):
    made = tmp_path_factory.mktemp("odd")
    _odd(spark.read.parquet(f"{sf_dir}/documents.parquet")).coalesce(2).write.parquet(f"{made}/documents.parquet")
    spark.read.parquet(f"{sf_dir}/labels.parquet").write.parquet(f"{made}/labels.parquet")
    return str(made)


def test_stages_keep_odd_columns(spark, odd_dir):
    docs = spark.read.parquet(f"{odd_dir}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, odd_dir)
        assert out.schema.names == docs.schema.names and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema], name
        assert out.where("__kept = 'x' and n_chars like 'about%'").count() == out.count(), name
        docs = out


def test_whole_run(spark, odd_dir, sf_dir):
    """Equal texts under other ids and null texts add nothing; rows that repeat a kept id are packed again."""
    packed = corpus_pipeline.run(spark, odd_dir)
    plain = corpus_pipeline.run(spark, sf_dir)
    ids = lambda df: {r["doc_id"] for r in df.select("doc_id").distinct().collect()}
    assert not {i for i in ids(packed) if i is not None and i >= 1_000_000}
    assert ids(packed) - {None} <= ids(plain) | {None}
    pieces = collections.defaultdict(list)
    for r in packed.collect():
        pieces[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in pieces.values():
        own.sort()
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:], strict=False)) and sum(n for _, n in own) <= 2048


def test_empty_run(spark, sf_dir, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_counts_of_other_types(spark):
    line = "this line stands in many of the documents here, word for word"
    rows = [(i, f"{line}\nand {i} of mail{i}@host.com is its own", "many", 1.5) for i in range(8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars string, weight double")
    for kind in ("string", "double", "int", "short"):
        own = docs.withColumn("n_chars", F.lit("3").cast(kind))
        for out in (linededup.dedup(own), surrogates.replaced(own, "k"), similar.keep_one(own)):
            assert out.schema["n_chars"].dataType == own.schema["n_chars"].dataType and out.count() <= 8 and out.collect()
