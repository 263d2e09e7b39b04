"""A Merkle manifest of a dataset: a digest of every row, a tree over each source, a tree over the sources.

Rows are numbered within their source (range partitions and a prefix sum over them, see
``gapless_rank``: a hot source spreads over many tasks).  Each level divides the numbers
by the fanout; rows with one quotient form a run, whose digests, sorted by number, are
hashed to the parent.  A source is done at the level where one node is left; the nodes of
all sources form the tree above in the same way.

Proofs go down again: a level's nodes join the runs they stand in and put their siblings
before those of the run above, so the long lists of siblings are held once a run (a
sixteenth of the rows) and no join carries the rows themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planewise.llm import duck
from planewise.llm.common import cut, gapless_rank

FANOUT = 16
TAMPERED_EVERY = 5
#: Groups up to which the table of groups (some tens of bytes a row) is broadcast; it is counted.
BROADCAST_GROUPS = 50_000
_PATH = "array<struct<left:string,right:string>>"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def leaf(text: Column) -> Column:
    """The digest of a row: each column as byte count, colon and value, or a dash for null."""
    fields = [F.col("doc_id").cast("string"), F.col("source"), F.col("lang"), F.col("n_chars").cast("string"), text]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-")) for c in fields)), 256)


def _height(n: Column) -> Column:
    """Levels until one node is left of ``n``."""
    out = F.lit(15)
    for h in reversed(range(15)):
        out = F.when(n <= FANOUT**h, h).otherwise(out)
    return out


def _small(df: DataFrame) -> DataFrame:
    """A table of groups, marked for broadcast if it is small; it has been written before."""
    return F.broadcast(df) if df.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS else df


def _digest() -> Column:
    """Of a run; the only row of a group stands for itself."""
    digests = F.col("kids.digest")
    return F.when(F.col("height") == 0, digests[0]).otherwise(F.sha2(F.array_join(digests, ""), 256))


def _done(level: int) -> Column:
    return F.greatest(F.col("height"), F.lit(1)) == level


def climb(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """The runs of every level, lowest first, and (grp, height, digest) of what remains of each group.

    ``nodes`` has grp, height, pos (gapless from 0 within the group), digest and what the
    lowest runs shall keep besides.
    """
    levels: list[DataFrame] = []
    while nodes is not None:
        level = len(levels) + 1
        kept = [c for c in nodes.columns if c not in ("grp", "height", "pos")]
        run = F.floor(F.col("pos") / F.lit(FANOUT)).cast("long").alias("run")
        levels.append(cut(nodes.groupBy("grp", "height", run).agg(F.array_sort(F.collect_list(F.struct("pos", *kept))).alias("kids"))))
        above = levels[-1].where(~_done(level)).select("grp", "height", F.col("run").alias("pos"), _digest().alias("digest"))
        nodes = None if above.isEmpty() else above
    tops = [runs.where(_done(k)).select("grp", "height", _digest().alias("digest")) for k, runs in enumerate(levels, 1)]
    whole = tops[0]
    for t in tops[1:]:
        whole = whole.unionByName(t)
    return levels, whole


def _below(runs: DataFrame, kept: list[str]) -> DataFrame:
    """The nodes of runs that have a path: each puts its own siblings before it."""
    at = F.col("i")
    digests = F.col("kids.digest")
    own = F.struct(F.array_join(F.slice(digests, 1, at), "").alias("left"), F.array_join(F.slice(digests, at + 2, FANOUT), "").alias("right"))
    path = F.when(F.col("height") == 0, F.col("path")).otherwise(F.concat(F.array(own), F.col("path")))
    opened = runs.select("*", F.posexplode("kids").alias("i", "kid"))
    return opened.select("grp", F.col("kid.pos").alias("pos"), path.alias("path"), *(F.col(f"kid.{c}").alias(c) for c in kept), *[c for c in runs.columns if c not in ("grp", "height", "run", "kids", "path")])


def descend(levels: list[DataFrame], tops: DataFrame, kept: list[str]) -> DataFrame:
    """(grp, pos, path, ``kept`` of the lowest nodes, further columns of ``tops``) of every lowest node.

    ``path`` is a list of the siblings left and right of the node and of those above it.
    ``tops`` has grp, height and the path from what remains of a group upwards.
    """
    carried = [c for c in tops.columns if c not in ("grp", "height")]
    above = None
    for level in range(len(levels), 0, -1):
        own = tops.where(_done(level)).select("grp", F.lit(0).cast("long").alias("run"), *carried)
        runs = levels[level - 1]
        placed = runs.where(_done(level)).join(_small(own), ["grp", "run"])
        if above is not None:
            placed = placed.unionByName(runs.where(~_done(level)).join(above, ["grp", "run"]))
        nodes = _below(placed, kept if level == 1 else [])
        if level > 1:
            above = nodes.withColumnRenamed("pos", "run")
    return nodes


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every row of ``docs`` (doc_id, source, lang, n_chars, text).

    Rows with one doc_id are ordered by their digest, so equal rows are interchangeable
    and the result depends on no order of the input; a null doc_id comes first and is
    never tampered with.  Null columns, the source too, have digests of their own.  Texts
    of any length are hashed whole and in place: none is shuffled.  An empty table gives
    no rows.  Further columns aren't read.
    """
    lowered = F.translate("text", _UPPER, _LOWER)
    changed = (F.crc32(F.col("doc_id").cast("string")) % TAMPERED_EVERY == 0) & (lowered != F.col("text"))
    group = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("-"))  # a null source comes first
    rows = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), group.alias("grp"), leaf(F.col("text")).alias("digest"), F.when(changed, leaf(lowered)).alias("altered")))
    sizes = cut(rows.groupBy("grp").agg(F.count(F.lit(1)).alias("n")))
    ranked = gapless_rank(rows, "grp", "doc_id", "pos", ("digest",))
    levels, subroots = climb(ranked.join(_small(sizes.select("grp", _height(F.col("n")).alias("height"))), "grp"))
    subroots = cut(subroots)
    sources = subroots.count()
    ordered = gapless_rank(subroots.withColumn("all", F.lit("")), "all", "grp", "pos")
    upper, remaining = climb(ordered.select(F.col("all").alias("grp"), _height(F.lit(sources)).alias("height"), "pos", "digest", F.col("grp").alias("source")))
    root = (remaining.first() or {"digest": None})["digest"]
    crown = descend(upper, remaining.select("grp", "height", F.array().cast(_PATH).alias("path")), ["source", "digest"])
    tops = cut(crown.select(F.col("source").alias("grp"), "path", F.col("digest").alias("subroot")).join(subroots.select("grp", "height"), "grp"))
    proofs = descend(levels, tops, ["doc_id", "digest", "altered"])
    siblings = F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), "")
    folded = F.aggregate("path", F.coalesce("altered", "digest"), lambda x, s: F.sha2(F.concat(s["left"], x, s["right"]), 256))
    out = proofs.select("doc_id", F.col("digest").alias("leaf"), "subroot", F.lit(root).cast("string").alias("root"), F.sha2(siblings, 256).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def oracle(levels: int = 5, source_levels: int = 3) -> str:
    """The same as DuckDB SQL with its levels written out: up to 16^``levels`` rows a source."""
    field = lambda c: f"coalesce(octet_length(encode({c}))::VARCHAR || ':' || {c}, '-')"
    hashed = lambda text: "sha256(" + " || ".join(field(c) for c in ("doc_id::VARCHAR", "source", "lang", "n_chars::VARCHAR", text)) + ")"
    lowered = f"translate(text, '{_UPPER}', '{_LOWER}')"
    out = [
        f"d AS (SELECT doc_id, coalesce('=' || source, '-') AS grp, {hashed('text')} AS leaf, CASE WHEN {duck.crc32('doc_id::VARCHAR')} % {TAMPERED_EVERY} = 0 THEN {hashed(lowered)} END AS altered FROM documents)",
        "t0 AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM d)",
        "a0 AS (SELECT grp, pos, leaf AS digest FROM t0)",
    ]

    def tree(prefix: str, many: int) -> None:
        for k in range(1, many + 1):
            below = f"{prefix}{k - 1}"
            out.append(f"{prefix}{k} AS (SELECT grp, p AS pos, CASE WHEN max(n) = 1 THEN min(digest) ELSE sha256(string_agg(digest, '' ORDER BY pos)) END AS digest FROM (SELECT *, pos // {FANOUT} AS p, count(*) OVER (PARTITION BY grp) AS n FROM {below}) GROUP BY grp, p)")

    def walk(prefix: str, many: int, node: str) -> str:
        """Siblings of a node and of those above it, as lists of left and right parts."""
        part = lambda k, op: f"coalesce((SELECT string_agg(s.digest, '' ORDER BY s.pos) FROM {prefix}{k} s WHERE s.grp = {node}.grp AND s.pos // {FANOUT} = {node}.pos // {FANOUT**(k + 1)} AND s.pos {op} {node}.pos // {FANOUT**k}), '')"
        alone = lambda k: f"(SELECT count(*) FROM {prefix}{k} s WHERE s.grp = {node}.grp) = 1"
        return "[" + ", ".join(f"CASE WHEN {alone(k)} THEN NULL ELSE {{'l': {part(k, '<')}, 'r': {part(k, '>')}}} END" for k in range(many)) + "]"

    tree("a", levels)
    out.append("b0 AS (SELECT '' AS grp, row_number() OVER (ORDER BY grp) - 1 AS pos, digest, grp AS src FROM a%d)" % levels)
    out.append("c0 AS (SELECT grp, pos, digest FROM b0)")
    tree("c", source_levels)
    out += [
        f"up AS (SELECT src, digest AS subroot, {walk('c', source_levels, 'b0')} AS path FROM b0)",
        f"lo AS (SELECT doc_id, grp, leaf, coalesce(altered, leaf) AS given, {walk('a', levels, 't0')} AS path FROM t0)",
        "w AS (SELECT doc_id, leaf, given, subroot, list_filter(list_concat(lo.path, up.path), lambda s: s IS NOT NULL) AS path FROM lo JOIN up ON up.src = lo.grp)",
        f"f AS (SELECT doc_id, leaf, subroot, (SELECT digest FROM c{source_levels}) AS root, sha256(coalesce(list_reduce(list_transform(path, lambda s: s.l || s.r), lambda x, y: x || y, ''), '')) AS proof_sha256, list_reduce(list_transform(path, lambda s: {{'l': s.l, 'r': s.r, 'x': ''}}), lambda a, s: {{'l': '', 'r': '', 'x': sha256(s.l || a.x || s.r)}}, {{'l': '', 'r': '', 'x': given}}).x AS folded_root FROM w)",
    ]
    return "WITH " + ",\n".join(out) + "\nSELECT *, folded_root = root AS verified FROM f"
