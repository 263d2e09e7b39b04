"""Ranks over any ids, chunks cut where the pattern cuts, and packet tables of other writers' files."""

import hashlib

import public_tokenizers as P
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from planewise.llm import hashtree, matroska, packing
from planewise.llm.chunks import ChunkCache
from planewise.llm.common import gapless_rank

JSON = P.path("byte_bpe_50k.json")
WIDE = [-6 * 10**18, 5, 6 * 10**18, -(2**63), 2**63 - 1, None, None, 5, 5, 0]


def test_wide_ids_are_ranked_packed_and_placed(spark):
    df = spark.createDataFrame([(i, "some words") for i in WIDE], "doc_id long, text string")
    got = gapless_rank(df.withColumn("g", F.lit(0)), "g", "doc_id", "n").collect()
    assert [r["doc_id"] for r in sorted(got, key=lambda r: r["n"])] == [None, None, *sorted(i for i in WIDE if i is not None)]
    assert sorted(r["n"] for r in got) == list(range(len(WIDE)))
    assert packing.pack(df, JSON).count() == len(WIDE)
    rows = hashtree.place(df, hashtree.regular_tree(24)).collect()
    for shard in {r["shard"] for r in rows}:
        assert sorted(r["slot"] for r in rows if r["shard"] == shard) == list(range(sum(r["shard"] == shard for r in rows)))


@pytest.mark.parametrize("ids", ["one far away", "one id without end"])
def test_no_partition_holds_a_hot_group(spark, ids, monkeypatch):
    """200,000 rows whose ids are dense but for one far away, or all the same: partitions stay even."""
    every = spark.range(200_000).select(F.lit(1).alias("g"), (F.when(F.col("id") == 0, F.lit(2**61)).otherwise(F.col("id")) if ids == "one far away" else F.lit(7)).cast("long").alias("v"))
    seen = []
    from planewise.llm import common

    true = common.cut
    monkeypatch.setattr(common, "cut", lambda df: seen.append(true(df)) or seen[-1])
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        ranked = gapless_rank(every, "g", "v", "n")
        sizes = [r["count"] for r in seen[0].groupBy("__part").count().collect()]
        assert len(sizes) == 4 and max(sizes) < 100_000
        assert ranked.agg(F.count_distinct("n"), F.min("n"), F.max("n")).first() == (200_000, 0, 199_999)
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab \t\n\xa0 \u3000.1'é"), max_size=30))
def test_chunks_are_cut_where_the_pattern_cuts(text):
    """Not only ids: the pieces themselves are those of the whole text."""
    if not text:
        return
    split = regex.compile(P.PATTERN)
    chunks = [k[1:] if k[:1] == " " else " " + k for k in ChunkCache.keys(text)]
    assert "".join(chunks) == text and [p for c in chunks for p in split.findall(c)] == split.findall(text)


def _file(*clusters, tracks=b"", info=b""):
    e = matroska.element
    return e(matroska.EBML, b"") + e(matroska.SEGMENT, e(matroska.INFO, info) + e(matroska.TRACKS, tracks) + b"".join(clusters))


def test_timestamps_follow_the_files_scale_and_durations():
    e, vint = matroska.element, matroska.vint
    track = lambda n, *more: e(matroska.TRACK_ENTRY, matroska._uint(matroska.TRACK_NUMBER, n) + b"".join(more))
    block = lambda n, flags, body: vint(n) + (2).to_bytes(2, "big") + bytes([flags]) + body
    fixed = bytes([1]) + b"aabb"
    refers = e(matroska.REFERENCE_BLOCK, b"\xff")
    cluster = e(
        matroska.CLUSTER,
        e(matroska.TIMESTAMP, b"\x0a") + e(matroska.SIMPLE_BLOCK, block(1, 0x84, fixed)) + e(matroska.SIMPLE_BLOCK, block(2, 0x04, fixed))
        + e(matroska.BLOCK_GROUP, e(matroska.BLOCK, block(1, 0, b"k"))) + e(matroska.BLOCK_GROUP, e(matroska.BLOCK, block(1, 0, b"p")) + refers) + e(matroska.BLOCK_GROUP, refers + e(matroska.BLOCK, block(1, 0, b"b"))),
    )
    got = matroska.packets(_file(cluster, tracks=track(1, matroska._uint(matroska.DEFAULT_DURATION, 7_000)) + track(2), info=matroska._uint(matroska.TIMESTAMP_SCALE, 500)))
    assert [(t, w, k) for t, w, _, _, k in got.packets] == [(6000, 1, True), (13000, 1, True), (6000, 2, False), (6000, 2, False), (6000, 1, True), (6000, 1, False), (6000, 1, False)]


@pytest.mark.parametrize("times", [1, 63, 64, 200])
def test_every_cue_counts(times):
    parsed = matroska.packets(matroska.write(matroska.padded(b"x")))
    parsed.cues *= times
    assert f":cues={times}:" in matroska.feature(parsed)


def test_ten_million_bytes_and_packet_rows(spark):
    raw = bytes(range(256)) * 40_000
    media = matroska.write(matroska.padded(raw))
    parsed = matroska.packets(media)
    assert hashlib.sha256(matroska.payload_of(media, parsed)[: len(raw)]).digest() == hashlib.sha256(raw).digest()
    df = spark.createDataFrame([(1, "abc"), (None, None)], "doc_id long, text string")
    rows = matroska.packet_column(matroska.encode_column(df).union(spark.createDataFrame([(2, 0, None)], "doc_id long, n_bytes long, media binary"))).collect()
    assert {(r["doc_id"], r["packets"] is None or len(r["packets"])) for r in rows} == {(1, 1), (None, 1), (2, True)}
    assert {r["packets"][0]["ts"] for r in rows if r["packets"]} == {0}


@pytest.mark.parametrize("most", [64 << 20, 0])
def test_lines_of_repeated_ids_and_own_columns(spark, most):
    """Five rows of one doc_id are one document; columns called like the operator's own keep their values."""
    from planewise.llm import linededup

    line = "a line that is long enough to be judged at all"
    df = spark.createDataFrame([(1, line, 7, "x", "y")] * 5 + [(2, line, 7, "x", "y")], "doc_id long, text string, id_0 int, drop_0 string, __drop string")
    out = linededup.dedup(df, broadcast_bytes=most)
    assert out.columns == df.columns and {tuple(r)[1:] for r in out.collect()} == {(line, 7, "x", "y")}
    more = df.union(spark.createDataFrame([(i, line, 7, "x", "y") for i in (3, 4, 5)], df.schema))
    assert sorted((r["doc_id"], r["text"]) for r in linededup.dedup(more, broadcast_bytes=most).collect()) == [(1, "")] * 5 + [(2, ""), (3, ""), (4, ""), (5, line)]
