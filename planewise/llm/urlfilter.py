"""URL filter: host and path rules, else logistic regression on hashed character n-grams.

All of it is SQL functions.  The n-grams of host and path are hashed to buckets by a
polynomial of their code points.  Training folds gradient steps over the labelled
table's bucket counts inside one expression; the table is small by
contract (``MAX_LABELLED`` rows), and the weights, rounded to integers, are a literal of
fixed size in the scoring plan.  So scores are sums of integers and the same anywhere.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 1024
GRAMS = (3, 4)
MULTIPLIER = 257
EPOCHS = 40
RATE = 0.01
#: Weights are rounded to this fraction.
UNIT = 10_000
#: Labelled rows of a training table at most.
MAX_LABELLED = 2_000

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: (verdict, host, path): a rule fits its host and all subdomains where the path starts with its own.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))

# Stems of the small labelled table, common words of sites of either kind; none of their words stands in the hosts that tests judge.
BAD_STEMS = "buy-viagra poker-bonus xxx-cams payday-loans lottery-prize replica-watches hot-singles slots-online betting-odds fat-burner coin-doubler escort-girls miracle-cure crack-download penny-stocks online-meds pharmacy-discount sexy-dating porn-videos jackpot-prizes blackjack-live mass-mailer link-exchange bonus-spins gamble-now keygen-serial nude-pics roulette-club diet-miracle forex-signals".split()
GOOD_STEMS = "library weather museum school garden recipes travel history science theatre council university music cycling health books archive nature stories painting kitchen hospital railway village market festival orchestra football chess gallery physics biology newspaper institute heritage mountain harbour bakery workshop translation".split()
SECTIONS = "en/12 fr/305.html de/7/ es/4410?page=2&ref=x".split()


def labelled_table() -> list[tuple[str, int]]:
    """(url, label) of the small training table: each stem with a prefix, a domain and a section by rule; 1 is to be blocked."""
    prefixes, domains = ("", "www.", "m.", "blog."), ("example.com", "example.org", "example.net")
    rows = []
    for label, stems in ((1, BAD_STEMS), (0, GOOD_STEMS)):
        for i, stem in enumerate(stems):
            for k in range(4):
                rows.append((f"https://{prefixes[(i + k) % 4]}{stem}.{domains[(i + k) % 3]}/{SECTIONS[k]}", label))
    return rows


def host_path(url: Column) -> tuple[Column, Column]:
    """Host and path; both empty for null or a url without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substr(__u, instr(__u, '://') + 3)"))
    host = F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def with_host_path(df: DataFrame, url: str = "url") -> DataFrame:
    host, path = host_path(F.col("__u"))
    return df.withColumn("__u", F.col(url)).withColumn("host", host).withColumn("path", path).drop("__u")


def buckets_sql(dialect: str = "spark") -> str:
    """SQL of the buckets of all n-grams of ``host || path`` with its ends marked; code points are in ``codes``."""
    if dialect == "spark":
        parts = [f"transform(sequence(0, size(codes) - {n}), i -> CAST(pmod({_poly(n, 'codes[i + {k}]')}, {BUCKETS}) AS INT))" for n in GRAMS]
        return "concat(" + ", ".join(parts) + ")"
    parts = [f"list_transform(range(1, len(codes) - {n} + 2), lambda i: ({_poly(n, 'codes[i + {k}]')}) % {BUCKETS})" for n in GRAMS]
    return " || ".join(parts)


def _poly(n: int, item: str) -> str:
    return " + ".join(f"{item.format(k=k)} * {MULTIPLIER ** (n - 1 - k)}" for k in range(n))


def codes_sql(dialect: str = "spark") -> str:
    """SQL of the code points of ``^host path$``; the shortest text, ``^$$$``, still has one n-gram of each length."""
    if dialect == "spark":
        return "transform(split(concat('^', host, path, '$$$'), ''), c -> CAST(ascii(c) AS BIGINT))"
    return "list_transform(string_split(concat('^', host, path, '$$$'), ''), lambda c: unicode(c)::BIGINT)"


def train(spark: SparkSession, labelled: list[tuple[str, int]] | DataFrame | None = None) -> list[int]:
    """Integer weights of the buckets and, last, the bias, from (url, label) rows in order.

    A null label or url counts as label 0 or the empty url; an empty table gives zero weights.
    """
    if not isinstance(labelled, DataFrame):
        rows = labelled_table() if labelled is None else labelled
        kind = "array<struct<k: bigint, url: string, label: int>>"
        literal = F.array(*(F.struct(F.lit(i), F.lit(u), F.lit(y)) for i, (u, y) in enumerate(rows))) if rows else F.array()
        labelled = spark.range(1).select(F.inline(literal.cast(kind)))
    few = with_host_path(labelled.orderBy("k").limit(MAX_LABELLED)).withColumn("codes", F.expr(codes_sql())).withColumn("b", F.expr(buckets_sql()))
    entries = few.select("k", F.coalesce("label", F.lit(0)).alias("y"), F.explode(F.expr(f"concat(b, array({BUCKETS}))")).alias("b")).groupBy("k", "y", "b").agg(F.count(F.lit(1)).cast("double").alias("n"))
    rows = entries.groupBy("k", "y").agg(F.array_sort(F.collect_list(F.struct("b", "n"))).alias("x")).agg(F.array_sort(F.collect_list(F.struct("k", "y", "x"))).alias("rows"))
    columns = entries.groupBy("b").agg(F.array_sort(F.collect_list(F.struct("k", "n"))).alias("l")).agg(F.map_from_entries(F.collect_list(F.struct("b", "l"))).alias("m"))
    # Two tables of one row each.  ``place`` is where a row of id k stands.
    one = rows.join(columns).withColumn("place", F.expr("map_from_entries(transform(rows, (r, i) -> named_struct('k', r.k, 'i', i)))"))
    one = one.withColumn("l", F.expr(f"transform(sequence(0, {BUCKETS}), j -> coalesce(transform(try_element_at(m, j), e -> named_struct('i', try_element_at(place, e.k), 'n', e.n)), array()))"))
    one = one.agg(F.first("rows").alias("rows"), F.first("l").alias("l"))  # else the optimizer puts ``l`` inside the fold
    step = f"""aggregate(sequence(1, {EPOCHS}), array_repeat(0D, {BUCKETS + 1}),
        (w, t) -> aggregate(array(transform(rows, r -> r.y - 1D / (1D + exp(-aggregate(r.x, 0D, (s, e) -> s + w[e.b] * e.n))))),
            w, (v, g) -> zip_with(v, l, (a, c) -> a + {RATE}D * aggregate(c, 0D, (s, e) -> s + g[e.i] * e.n))))"""
    weights = one.select(F.expr(f"CASE WHEN size(rows) = 0 THEN array_repeat(0D, {BUCKETS + 1}) ELSE {step} END").alias("w"))
    return list(weights.select(F.expr(f"transform(w, v -> CAST(floor(v * {UNIT}D + 0.5D) AS INT))")).first()[0])


def train_plainly(labelled: list[tuple[str, int]] | None = None) -> list[int]:
    """The same weights step by step in plain Python, for the oracle's text and for tests."""
    rows = []
    for url, label in labelled_table() if labelled is None else labelled:
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        cut = min([i for i in map(rest.find, "/?#") if i >= 0], default=len(rest))
        end = min([i for i in map(rest.find, "?#") if i >= 0], default=len(rest))
        host = rest[:cut].translate(str.maketrans(UPPER, LOWER))
        codes = [ord(c) for c in f"^{host}{rest[cut:end]}$$$"]
        counts: dict[int, int] = {}
        for n in GRAMS:
            for i in range(len(codes) - n + 1):
                b = sum(codes[i + k] * MULTIPLIER ** (n - 1 - k) for k in range(n)) % BUCKETS
                counts[b] = counts.get(b, 0) + 1
        rows.append((label or 0, sorted(counts.items())))
    w = [0.0] * (BUCKETS + 1)
    for _ in range(EPOCHS):
        step = [0.0] * (BUCKETS + 1)
        for y, x in rows:
            x = [*x, (BUCKETS, 1)]
            g = y - 1.0 / (1.0 + math.exp(-sum(w[b] * n for b, n in x)))
            for b, n in x:
                step[b] += g * n
        w = [a + RATE * s for a, s in zip(w, step, strict=True)]
    return [math.floor(v * UNIT + 0.5) for v in w]


def rule_sql(rules: tuple = RULES) -> tuple[str, str]:
    """SQL of the fitting rule's text and verdict: the longest that fits; null if none does."""
    ordered = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1], r[2]))
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    fits = lambda r: f"(host = {quote(r[1])} OR right(host, {len(r[1]) + 1}) = {quote('.' + r[1])}) AND left(path, {len(r[2])}) = {quote(r[2])}"
    case = lambda of: "CASE " + " ".join(f"WHEN {fits(r)} THEN {quote(of(r))}" for r in ordered) + " END" if ordered else "CAST(NULL AS STRING)"
    return case(lambda r: r[1] + r[2]), case(lambda r: r[0])


def judge(pages: DataFrame, weights: list[int], rules: tuple = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict and score of every row of ``pages`` (page_id, url).

    A null url has an empty host and path, fits no rule and is judged by the model like
    any other.  Repeated rows get equal rows, an empty table gives none, further columns
    aren't read.
    """
    rule, verdict = rule_sql(rules)
    read = with_host_path(pages.select(F.col("page_id").cast("long").alias("page_id"), "url"))
    hashed = read.withColumn("codes", F.expr(codes_sql())).withColumn("b", F.expr(buckets_sql()))
    model = "array(" + ", ".join(map(str, weights[:BUCKETS])) + ")"
    scored = hashed.withColumn("score", F.expr(f"aggregate(b, CAST({weights[BUCKETS]} AS BIGINT), (s, x) -> s + {model}[x])"))
    return scored.select("page_id", "host", "path", F.expr(rule).alias("rule"), F.expr(f"coalesce({verdict}, CASE WHEN score > 0 THEN 'block' ELSE 'allow' END)").alias("verdict"), "score")


def oracle(weights: list[int], rules: tuple = RULES) -> str:
    """The same verdicts as DuckDB SQL."""
    rule, verdict = (x.replace("STRING", "VARCHAR") for x in rule_sql(rules))
    lower = f"translate(regexp_extract(rest, '^([^/?#]*)', 1), '{UPPER}', '{LOWER}')"
    return f"""WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, {lower} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
c AS (SELECT *, {codes_sql('duckdb')} AS codes FROM h),
b AS (SELECT *, {buckets_sql('duckdb')} AS b FROM c),
s AS (SELECT *, CAST({weights[BUCKETS]} + list_sum(list_transform(b, lambda x: ([{', '.join(map(str, weights[:BUCKETS]))}])[x + 1])) AS BIGINT) AS score FROM b)
SELECT page_id, host, path, {rule} AS rule, coalesce({verdict}, CASE WHEN score > 0 THEN 'block' ELSE 'allow' END) AS verdict, score FROM s"""
