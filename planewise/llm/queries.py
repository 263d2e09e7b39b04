"""The driver's queries for these operators and, where SQL can say the same, their oracles."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from planewise.llm import bpe, hashtree, htmltext, isolation, linededup, matroska, merkle, mixing, packing, simhash, spelling, surrogates, urlfilter
from planewise.llm.common import table

SHARDS = 24
#: The driver's tables are synthetic: their surrogates may be reproduced.  Real texts need a secret in the session's setting.
SAMPLE_KEY = "made-up tables only"


def op1_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates.surrogates(table(spark, sf_dir, "documents"), spark.conf.get(surrogates.KEY_SETTING, SAMPLE_KEY))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op4_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matroska.digests(table(spark, sf_dir, "documents"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.digests(table(spark, sf_dir, "documents"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages"), urlfilter.train(spark))


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.main_text(table(spark, sf_dir, "pages"))


def op8_hash_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = hashtree.regular_tree(SHARDS)
    return hashtree.place(table(spark, sf_dir, "documents"), tree, hashtree.grown(tree))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.group(table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return isolation.assess(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group(table(spark, sf_dir, "documents"))


def op13_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_surrogates": op1_surrogates,
        "op2_bpe": op2_bpe,
        "op3_packing": op3_packing,
        "op4_matroska": op4_matroska,
        "op5_line_dedup": op5_line_dedup,
        "op6_url_filter": op6_url_filter,
        "op7_html_text": op7_html_text,
        "op8_hash_tree": op8_hash_tree,
        "op9_simhash": op9_simhash,
        "op10_quality_rules": op10_quality_rules,
        "op11_merkle": op11_merkle,
        "op12_spelling": op12_spelling,
        "op13_mixing": op13_mixing,
    }


_LINES = r"""WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS k FROM documents),
k AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key, max(doc_id) AS largest FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5)
SELECT k.doc_id, count(*) AS n_lines, count(f.key) FILTER (WHERE k.doc_id <> f.largest) AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY k.k) FILTER (WHERE f.key IS NULL OR k.doc_id = f.largest), '')) AS kept_sha256
FROM k LEFT JOIN f ON k.key = f.key GROUP BY k.doc_id"""

#: The pages' main text is their one article; its blocks are h1 and p, its references named ones.
_ARTICLES = r"""WITH a AS (SELECT page_id, url, regexp_extract(html, '<article>((?s:.*?))</article>', 1) AS t FROM pages),
b AS (SELECT page_id, url, regexp_replace(regexp_replace(t, '</?(h1|p)>|<br>', ' ', 'g'), '<[^>]*>', '', 'g') AS t FROM a),
c AS (SELECT page_id, url, replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', ''''), '&amp;', '&') AS t FROM b),
d AS (SELECT page_id, url, trim(regexp_replace(t, '\s+', ' ', 'g')) AS text FROM c)
SELECT page_id, url, text, length(text) AS n_chars FROM d"""


def oracle_sql() -> dict[str, str]:
    return {
        "op5_line_dedup": _LINES,
        "op6_url_filter": urlfilter.oracle(urlfilter.train_plainly()),
        "op7_html_text": _ARTICLES,
        "op8_hash_tree": hashtree.oracle(hashtree.regular_tree(SHARDS), hashtree.grown(hashtree.regular_tree(SHARDS))),
        "op11_merkle": merkle.oracle(),
        "op12_spelling": spelling.oracle(),
        "op13_mixing": mixing.oracle(),
    }
