"""All queries of the engine's own operators, with the same results as DuckDB SQL where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from planewise.functions import tables as table_functions
from planewise.functions import vectors
from planewise.functions.metrics import REGISTRY
from planewise.operators import blocks, cells, diagnostics, moments, neighbors, ordered, pairs, profiles, projection, selection, times
from planewise.operators.neighbors import result, result_of_pair
from planewise import plane_sql
from planewise.plans import bases, catalog, rashomon, tours, transitions
from planewise.sources import datasets, tables
from planewise.sources.tables import ACTIVITIES, BELIEFS, EMBEDDINGS, EVENT_TYPES, MIXES
from planewise.streaming import composition

Query = Callable[[SparkSession, str], DataFrame]
K = 5
PLANE = (0, 1)
PLANES = ((0, 1), (2, 3), (4, 5))
ENTRIES = 64
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def _register(name: str, query: Query, oracle: str | None = None) -> None:
    _QUERIES[name] = query
    if oracle:
        _ORACLES[name] = oracle


def _r(sql: str, places: int = 6) -> str:
    return f"(round({sql}, {places}) + 0.0)"


def _long(df: DataFrame, vec: Column, name: str = "value") -> DataFrame:
    """(object_id, k, value) of a vector column, so that results are plain rows."""
    return df.select("object_id", F.posexplode(vec).alias("k", name)).withColumn(name, result(F.col(name)))


def _long_sql(view: tables.View, expression: str) -> str:
    return f"WITH {view.sql}, t AS (SELECT object_id, {expression} AS t FROM v) SELECT object_id, CAST(k - 1 AS INTEGER) AS k, {_r('t[k]')} AS value FROM t, unnest(range(1, {view.dimension + 1})) AS u(k)"


_CLR = """list_transform([list_transform(vec, lambda x: ln(CASE WHEN x = 0 THEN 1e-6 ELSE x * (1.0 - 1e-6 * len(list_filter(vec, lambda y: y = 0))) END))], lambda l: list_transform(l, lambda x: x - list_sum(l) / len(l)))[1]"""
_ROOT = "list_transform(vec, lambda x: sqrt(greatest(x, 0)))"


# -- representations ---------------------------------------------------------------------------

_register("rep_softmax", lambda s, d: _long(tables.beliefs(s, d), F.col("vec")), _long_sql(BELIEFS, "vec"))
_register("rep_sqrt", lambda s, d: _long(tables.mixes(s, d), vectors.sqrt_probability(F.col("vec"))), _long_sql(MIXES, _ROOT))
_register("rep_logit", lambda s, d: _long(tables.mixes(s, d), vectors.logit(F.col("vec"))), _long_sql(MIXES, "list_transform(vec, lambda x: ln(least(greatest(x, 1e-6), 1 - 1e-6) / (1.0 - least(greatest(x, 1e-6), 1 - 1e-6))))"))
_register("rep_clr_zero_replaced", lambda s, d: _long(tables.mixes(s, d), vectors.clr(F.col("vec"))), _long_sql(MIXES, _CLR))
_register("rep_renormalize", lambda s, d: _long(tables.activities(s, d), vectors.renormalize(F.transform("vec", lambda x: x * 3.0))), _long_sql(ACTIVITIES, "list_transform(vec, lambda x: 3.0 * x / list_sum(list_transform(vec, lambda y: 3.0 * y)))"))

_BITS = "-list_sum(list_transform(vec, lambda x: CASE WHEN x > 0 THEN x * log2(x) ELSE 0 END))"
_register("entropy_bits", lambda s, d: tables.mixes(s, d).select("object_id", result(vectors.entropy(F.col("vec"))).alias("entropy")), f"WITH {MIXES.sql} SELECT object_id, {_r(_BITS)} AS entropy FROM v")
_NATS = "-list_sum(list_transform(vec, lambda x: x * ln(greatest(x, 1e-12))))"
_register("entropy_nats", lambda s, d: tables.beliefs(s, d).select("object_id", result(vectors.entropy(F.col("vec"), "nats")).alias("entropy")), f"WITH {BELIEFS.sql} SELECT object_id, {_r(_NATS)} AS entropy FROM v")

CLASS_NAMES = [f"class_{k}" for k in range(10)]


def _predicted(s: SparkSession, d: str) -> DataFrame:
    v = tables.beliefs(s, d)
    return v.select("object_id", "vec", "label", vectors.argmax_label(F.col("vec"), CLASS_NAMES).alias("predicted_label"), vectors.confidence(F.col("vec")).alias("confidence"))


_PREDICTED = f"{BELIEFS.sql}, p AS (SELECT *, 'class_' || (list_position(vec, list_max(vec)) - 1) AS predicted_label, list_max(vec) AS confidence FROM v)"
_register("argmax_confidence", lambda s, d: _predicted(s, d).select("object_id", "predicted_label", result(F.col("confidence")).alias("confidence")), f"WITH {_PREDICTED} SELECT object_id, predicted_label, {_r('confidence')} AS confidence FROM p")
_register("correct_flag", lambda s, d: _predicted(s, d).select("object_id", vectors.correct(F.col("label"), F.col("predicted_label")).alias("correct")), f"WITH {_PREDICTED} SELECT object_id, coalesce(label = predicted_label AND label <> 'ambiguous', false) AS correct FROM p")
_register(
    "label_coalesce",
    lambda s, d: _predicted(s, d).select("object_id", vectors.label(F.lit(""), F.lit(None).cast("string"), F.when(F.col("confidence") > 0.5, F.col("label")), F.col("predicted_label"), vectors.argmax(F.col("vec"))).alias("label")),
    f"WITH {_PREDICTED} SELECT object_id, coalesce(nullif('', ''), CASE WHEN confidence > 0.5 THEN label END, predicted_label) AS label FROM p",
)
_register("label_encoding", lambda s, d: selection.label_codes(tables.embeddings(s, d)), f"WITH {EMBEDDINGS.sql} SELECT label, row_number() OVER (ORDER BY label) - 1 AS code FROM (SELECT DISTINCT label FROM v)")
_register("class_hues", lambda s, d: tables.embeddings(s, d).select("label").distinct().select("label", vectors.colour_hue(F.col("label")).alias("hue")), f"WITH {EMBEDDINGS.sql} SELECT label, CAST(list_reduce(list_prepend(0::BIGINT, list_transform(range(0, 4), lambda k: ('0x' || substr(md5(label), 8 * k + 1, 8))::BIGINT)), lambda a, b: (a * 256 + b) % 360) AS INTEGER) AS hue FROM (SELECT DISTINCT label FROM v)")

# -- distances ---------------------------------------------------------------------------------

#: (view, reader, DuckDB form over prepared vectors a and b, DuckDB preparation) of each metric.
_DISTANCES = {
    "euclidean": ("list_distance(a.w, b.w)", "vec"),
    "hellinger": ("least(list_distance(a.w, b.w) / sqrt(2.0), 1.0)", _ROOT),
    "fisher_rao": ("2.0 * acos(least(1.0, greatest(-1.0, list_dot_product(a.w, b.w))))", _ROOT),
    "aitchison": ("list_distance(a.w, b.w)", _CLR),
    "jensen_shannon": ("least(1.0, sqrt(greatest(0.0, list_sum(list_transform(range(1, len(a.w) + 1), lambda k: CASE WHEN a.w[k] > 0 THEN 0.5 * a.w[k] * log2(2 * a.w[k] / (a.w[k] + b.w[k])) ELSE 0 END + CASE WHEN b.w[k] > 0 THEN 0.5 * b.w[k] * log2(2 * b.w[k] / (a.w[k] + b.w[k])) ELSE 0 END)))))", "vec"),
    "bhattacharyya": ("acos(least(1.0, greatest(-1.0, list_dot_product(a.w, b.w))))", _ROOT),
}
_VIEW_OF = {"euclidean": (ACTIVITIES, tables.activities), "hellinger": (ACTIVITIES, tables.activities), "fisher_rao": (BELIEFS, tables.beliefs), "aitchison": (MIXES, tables.mixes), "jensen_shannon": (MIXES, tables.mixes), "bhattacharyya": (BELIEFS, tables.beliefs)}


def _space(reader: Query, dimension: int, metric: str, plane: tuple[int, int] | None = None) -> Callable[[SparkSession, str], pairs.Space]:
    def run(s: SparkSession, d: str) -> pairs.Space:
        xy = (F.col("vec")[plane[0]], F.col("vec")[plane[1]]) if plane else None
        return pairs.space(reader(s, d), "vec", dimension, REGISTRY.compatible(metric, "probability"), xy)

    return run


def _near(reader: Query, dimension: int, metric: str, k: int = K, planes: tuple[tuple[int, int], ...] = (), target: str | None = None, **settings: object) -> Query:
    """Neighbours and ranks by blocks of points."""

    def run(s: SparkSession, d: str) -> DataFrame:
        m = REGISTRY.compatible(metric, "probability")
        placed = blocks.placed(reader(s, d), "vec", dimension, m, [(F.col("vec")[a], F.col("vec")[b]) for a, b in planes])
        return blocks.neighbours(placed, dimension, m, len(planes), k, target, **settings)

    return run


def _cells(reader: Query, dimension: int, metric: str, **settings: object) -> Query:
    """Neighbours by pivots and cells."""

    def run(s: SparkSession, d: str) -> DataFrame:
        m = REGISTRY.compatible(metric, "probability")
        return cells.neighbours(blocks.placed(reader(s, d), "vec", dimension, m, []), dimension, m, K, **settings)

    return run


def _pairs_sql(view: tables.View, metric: str, condition: str = "a.object_id <> b.object_id", plane: tuple[int, int] | None = None) -> str:
    form, prepared = _DISTANCES[metric]
    flat = f", sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) AS l" if plane else ""
    xy = f", vec[{plane[0] + 1}] AS x, vec[{plane[1] + 1}] AS y" if plane else ""
    return f"WITH {view.sql}, w AS (SELECT object_id, {prepared} AS w{xy} FROM v), pr AS (SELECT a.object_id AS i, b.object_id AS j, {form} AS h{flat} FROM w a, w b WHERE {condition})"


def _register_metric(metric: str, suffix: str = "") -> None:
    view, reader = _VIEW_OF[metric]
    of = _space(reader, view.dimension, metric)
    _register(f"dist_{metric}{suffix}", lambda s, d: pairs.pairs(of(s, d), unordered=True).select("i", "j", result_of_pair(F.col("h")).alias("distance")), f"{_pairs_sql(view, metric, 'a.object_id < b.object_id')} SELECT i, j, {_r('h')} AS distance FROM pr")
    # Shares of counts repeat: the index holds each vector once, so copies cost no more than one of them.
    shares = _cells(reader, view.dimension, metric)
    near = lambda s, d: neighbors.block_knn(_near(reader, view.dimension, metric, ranks=())(s, d), K)
    _register(f"knn_{metric}{suffix}", near if view is BELIEFS else shares, _knn_sql(view, metric))


def _knn_sql(view: tables.View, metric: str) -> str:
    return f"{_pairs_sql(view, metric)} SELECT i AS src_id, j AS neighbor_id, CAST(rank AS INTEGER) AS rank, {_r('h')} AS distance FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY round(h, 9), j) AS rank FROM pr) WHERE rank <= {K}"


for _m in _DISTANCES:
    _register_metric(_m)
for _m in ("aitchison", "jensen_shannon"):  # names of an earlier time, when the plain ones read some customers only
    _register_metric(_m, "_whole")

_register("knn_raw_embeddings", lambda s, d: neighbors.block_knn(_near(tables.embeddings, 64, "euclidean", ranks=())(s, d), K), _knn_sql(EMBEDDINGS, "euclidean"))
_register(
    "knn_target_pushdown",
    lambda s, d: neighbors.knn_of(pairs.pairs(_space(tables.beliefs, 10, "fisher_rao")(s, d), target="vec_000007"), K),
    f"{_pairs_sql(BELIEFS, 'fisher_rao')} SELECT i AS src_id, j AS neighbor_id, {_r('h')} AS distance FROM pr WHERE i = 'vec_000007' ORDER BY round(h, 9), j LIMIT {K}",
)


def _cross_sets(s: SparkSession, d: str) -> DataFrame:
    metric = REGISTRY.get("hellinger")
    a, b = (pairs.space(read(s, d), "vec", 5, metric) for read in (tables.activities, tables.mixes))
    return pairs.pairs(a, other=b).select("i", "j", result_of_pair(F.col("h")).alias("distance"))


_CROSS = f"""WITH RECURSIVE {ACTIVITIES.sql.replace('e AS', 'ea AS').replace('FROM e WHERE', 'FROM ea WHERE').replace('v AS', 'va AS')},
{MIXES.sql.replace('e AS', 'eb AS', 1).replace('FROM e WHERE', 'FROM eb WHERE').replace('v AS', 'vb AS')},
a AS (SELECT object_id, {_ROOT} AS w FROM va), b AS (SELECT object_id, {_ROOT} AS w FROM vb)
SELECT a.object_id AS i, b.object_id AS j, {_r(_DISTANCES['hellinger'][0])} AS distance FROM a, b"""
_register("dist_cross_sets", _cross_sets, _CROSS)
_register("dist_cross_sets_whole", _cross_sets, _CROSS)


# -- metric index ------------------------------------------------------------------------------


#: Cells that the approximate search visits, of about the root of the number of points.
PROBES = 24
RECALL = 0.9
_ASKED = "cast(substring(object_id, 5) AS INT) % 50 = 0"
_register("knn_exact_index", _cells(tables.beliefs, 10, "hellinger"), _knn_sql(BELIEFS, "hellinger"))
_register("knn_exact_index_divergence", _cells(tables.activities, 5, "jensen_shannon"), _knn_sql(ACTIVITIES, "jensen_shannon"))
_register("knn_approximate", _cells(tables.beliefs, 10, "fisher_rao", probes=PROBES))


def _recall(s: SparkSession, d: str) -> DataFrame:
    """The approximate search against the exact one, for the ids divisible by 50 among all rows."""
    exact = _cells(tables.beliefs, 10, "fisher_rao", asked=F.expr(_ASKED))(s, d)
    found = cells.recall(_cells(tables.beliefs, 10, "fisher_rao", probes=PROBES, asked=F.expr(_ASKED))(s, d), exact)
    whole = exact.agg(result(F.avg("distance"), 5).alias("mean_distance"), F.count_distinct("src_id").alias("n_queries"))
    return found.crossJoin(whole).select("n_queries", "n_neighbors", "mean_distance", (F.col("recall") >= RECALL).alias("recall_reached"))  # one row and one


_register("knn_recall", _recall, f"SELECT count(DISTINCT src_id) AS n_queries, count(*) AS n_neighbors, {_r('avg(distance)', 5)} AS mean_distance, true AS recall_reached FROM ({_knn_sql(BELIEFS, 'fisher_rao')}) WHERE CAST(substr(src_id, 5) AS INTEGER) % 50 = 0")

_register(
    "rank_matrix_topn",
    lambda s, d: neighbors.block_ranks(_near(tables.activities, 5, "hellinger", 20, (PLANE,))(s, d)).where("rh <= 20"),
    f"{_pairs_sql(ACTIVITIES, 'hellinger', plane=PLANE)} SELECT i, j, CAST(rh AS INTEGER) AS rh, CAST(rl AS INTEGER) AS rl FROM (SELECT *, row_number() OVER (PARTITION BY i ORDER BY round(h, 9), j) AS rh, row_number() OVER (PARTITION BY i ORDER BY round(l, 9), j) AS rl FROM pr) WHERE rh <= 20",
)

# -- projections -------------------------------------------------------------------------------


def _axis_plane(dimension: int, plane: tuple[int, int]) -> np.ndarray:
    b = np.zeros((dimension, 2))
    b[plane[0], 0] = b[plane[1], 1] = 1.0
    return b


def _xy(df: DataFrame) -> DataFrame:
    return projection.rounded(df.select("object_id", "x", "y"), "x", "y")


def _centred(s: SparkSession, d: str) -> DataFrame:
    v = tables.embeddings(s, d)
    return _xy(projection.project(v, _axis_plane(64, PLANE), centre=projection.column_means(v, 64)))


_register("project_axis_plane", lambda s, d: _xy(projection.project(tables.embeddings(s, d), _axis_plane(64, PLANE))), f"WITH {EMBEDDINGS.sql} SELECT object_id, {_r('vec[1]')} AS x, {_r('vec[2]')} AS y FROM v")
_register("project_centered", _centred, f"WITH {EMBEDDINGS.sql} SELECT object_id, {_r('vec[1] - avg(vec[1]) OVER ()')} AS x, {_r('vec[2] - avg(vec[2]) OVER ()')} AS y FROM v")


def _bridge(s: SparkSession, d: str) -> DataFrame:
    four = tables.activities(s, d).withColumn("vec", vectors.renormalize(F.transform(F.slice("vec", 1, 4), lambda x: x + 0.01)))
    return _xy(projection.project(four, bases.bridge_plane(4)))


_FOUR = "list_transform([list_transform(vec[1:4], lambda x: x + 0.01)], lambda l: list_transform(l, lambda x: x / list_sum(l)))[1]"
_register("project_bridge", _bridge, f"WITH {ACTIVITIES.sql}, f AS (SELECT object_id, {_FOUR} AS p FROM v) SELECT object_id, {_r('(p[1] + p[2]) * sqrt(0.5)')} AS x, {_r('(p[3] + p[4]) * sqrt(0.5)')} AS y FROM f")
_register("zscore", lambda s, d: _long(projection.zscore(tables.activities(s, d), 5), F.col("z")), f"WITH {ACTIVITIES.sql}, m AS (SELECT object_id, vec[k] AS x, k FROM v, unnest(range(1, 6)) AS u(k)) SELECT object_id, CAST(k - 1 AS INTEGER) AS k, {_r('(x - avg(x) OVER (PARTITION BY k)) / CASE WHEN stddev_pop(x) OVER (PARTITION BY k) < 1e-8 THEN 1 ELSE stddev_pop(x) OVER (PARTITION BY k) END')} AS value FROM m")


def _minmax(s: SparkSession, d: str) -> DataFrame:
    framed = projection.frames(tables.activities(s, d), [_axis_plane(5, p) for p in ((0, 1), (2, 3))])
    return projection.rounded(projection.minmax(framed), "x", "y")


_register("minmax_frames", _minmax, f"WITH {ACTIVITIES.sql}, f AS (SELECT CAST(f AS INTEGER) AS frame, object_id, vec[2 * f + 1] AS x, vec[2 * f + 2] AS y FROM v, unnest(range(0, 2)) AS u(f)) SELECT frame, object_id, {_r('2 * (x - min(x) OVER ()) / (max(x) OVER () - min(x) OVER ()) - 1')} AS x, {_r('2 * (y - min(y) OVER ()) / (max(y) OVER () - min(y) OVER ()) - 1')} AS y FROM f")
_register(
    "minmax_per_view",
    lambda s, d: projection.rounded(projection.minmax_each(projection.frames(tables.activities(s, d), [_axis_plane(5, p) for p in ((0, 1), (2, 3))])), "x", "y"),
    f"WITH {ACTIVITIES.sql}, f AS (SELECT CAST(f AS INTEGER) AS frame, object_id, vec[2 * f + 1] AS x, vec[2 * f + 2] AS y FROM v, unnest(range(0, 2)) AS u(f)) SELECT frame, object_id, {_r('2 * (x - min(x) OVER w) / (max(x) OVER w - min(x) OVER w) - 1')} AS x, {_r('2 * (y - min(y) OVER w) / (max(y) OVER w - min(y) OVER w) - 1')} AS y FROM f WINDOW w AS (PARTITION BY frame)",
)
_register("isotropic_view", lambda s, d: projection.rounded(projection.isotropic(projection.project(tables.activities(s, d), _axis_plane(5, PLANE))).select("object_id", "x", "y"), "x", "y"), f"WITH {ACTIVITIES.sql}, b AS (SELECT object_id, vec[1] AS x, vec[2] AS y FROM v), r AS (SELECT (min(x) + max(x)) / 2 AS cx, (min(y) + max(y)) / 2 AS cy, greatest(max(x) - min(x), max(y) - min(y)) / 2 AS half FROM b) SELECT object_id, {_r('(x - cx) / half')} AS x, {_r('(y - cy) / half')} AS y FROM b, r")

# -- neighbourhoods and diagnostics ----------------------------------------------------------------

_RANKS = f"{_pairs_sql(BELIEFS, 'fisher_rao', plane=PLANE)}, r AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY round(h, 9), j) AS rh, row_number() OVER (PARTITION BY i ORDER BY round(l, 9), j) AS rl FROM pr)"
_CLASSES = f"{_RANKS}, c AS (SELECT i AS src_id, j AS neighbor_id, CASE WHEN rh <= {K} AND rl <= {K} THEN 'preserved' WHEN rh <= {K} THEN 'torn' ELSE 'false' END AS class, CAST(rh AS INTEGER) AS source_rank, CAST(rl AS INTEGER) AS view_rank FROM r WHERE rh <= {K} OR rl <= {K})"


def _beliefs_ranked(s: SparkSession, d: str, target: str | None = None) -> DataFrame:
    return neighbors.block_ranks(_near(tables.beliefs, 10, "fisher_rao", K, (PLANE,), target)(s, d))


def _classes(s: SparkSession, d: str) -> DataFrame:
    return neighbors.classes(_beliefs_ranked(s, d), K)


_register("neighbor_classes", _classes, f"{_CLASSES} SELECT * FROM c")
_COUNTS = "count(*) FILTER (WHERE class = 'preserved') AS preserved, count(*) FILTER (WHERE class = 'torn') AS torn, count(*) FILTER (WHERE class = 'false') AS false_neighbors"
_share = lambda a, b: _r(f"CASE WHEN {b} = 0 THEN 1.0 ELSE 1.0 * {a} / ({b}) END")
_register("neighbor_precision_recall", lambda s, d: neighbors.precision_recall(_classes(s, d)), f"{_CLASSES}, n AS (SELECT src_id, {_COUNTS} FROM c GROUP BY src_id) SELECT *, {_share('preserved', '(preserved + false_neighbors)')} AS precision, {_share('preserved', '(preserved + torn)')} AS recall, {_share('preserved', '(preserved + torn + false_neighbors)')} AS jaccard FROM n")
_register("topology_edges", lambda s, d: neighbors.topology(_classes(s, d)), f"{_CLASSES} SELECT src_id AS source, neighbor_id AS target, class AS type FROM (SELECT *, row_number() OVER (PARTITION BY least(src_id, neighbor_id), greatest(src_id, neighbor_id), class ORDER BY src_id, CASE WHEN class = 'false' THEN view_rank ELSE source_rank END, neighbor_id) AS n FROM c) WHERE n = 1")


def _edges(s: SparkSession, d: str) -> DataFrame:
    v = tables.beliefs(s, d)
    placed = v.select("object_id", *(result(F.col("vec")[k]).alias(c) for k, c in zip(PLANE, "xy", strict=True)))
    return neighbors.drawn(neighbors.topology(_classes(s, d)), placed)


_EDGES = f"{_CLASSES}, g AS (SELECT src_id AS source, neighbor_id AS target, class AS type FROM (SELECT *, row_number() OVER (PARTITION BY least(src_id, neighbor_id), greatest(src_id, neighbor_id), class ORDER BY src_id, CASE WHEN class = 'false' THEN view_rank ELSE source_rank END, neighbor_id) AS n FROM c) WHERE n = 1), q AS (SELECT object_id, {_r('vec[1]')} AS x, {_r('vec[2]')} AS y FROM v)"
_register("topology_drawn", _edges, f"{_EDGES} SELECT source, target, type, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM g JOIN q a ON a.object_id = source JOIN q b ON b.object_id = target")


def _target_classes(s: SparkSession, d: str) -> DataFrame:
    return neighbors.precision_recall(neighbors.classes(_beliefs_ranked(s, d, "vec_000003"), K))


_register("point_diagnostics", _target_classes, f"{_CLASSES}, n AS (SELECT src_id, {_COUNTS} FROM c WHERE src_id = 'vec_000003' GROUP BY src_id) SELECT *, {_share('preserved', '(preserved + false_neighbors)')} AS precision, {_share('preserved', '(preserved + torn)')} AS recall, {_share('preserved', '(preserved + torn + false_neighbors)')} AS jaccard FROM n")

_N = "(SELECT count(*) FROM w)"
_Z = f"(CASE WHEN {K} <= {_N} / 2.0 THEN 2.0 / ({_N} * {K} * (2 * {_N} - 3 * {K} - 1)) ELSE 2.0 / ({_N} * ({_N} - {K}) * ({_N} - {K} - 1)) END)"
_T = _r(f"1.0 - {_Z} * sum(CASE WHEN rl <= {K} AND rh > {K} THEN rh - {K} ELSE 0 END)")
_C = _r(f"1.0 - {_Z} * sum(CASE WHEN rh <= {K} AND rl > {K} THEN rl - {K} ELSE 0 END)")
_S = _r("sqrt(greatest(0, 1 - sum(h * l) * sum(h * l) / (sum(h * h) * sum(l * l))))")


def _ranked(s: SparkSession, d: str) -> tuple[DataFrame, int]:
    return _beliefs_ranked(s, d), tables.beliefs(s, d).count()


def _stress(s: SparkSession, d: str) -> DataFrame:
    m = REGISTRY.compatible("fisher_rao", "probability")
    placed = blocks.placed(tables.beliefs(s, d), "vec", 10, m, [tuple(F.col("vec")[k] for k in PLANE)])
    return diagnostics.stress_of_blocks(blocks.square_sums(placed, 10, m, placed.count()))


_register("trustworthiness", lambda s, d: diagnostics.trustworthiness(*_ranked(s, d), K), f"{_RANKS} SELECT {_T} AS trustworthiness FROM r")
_register("continuity", lambda s, d: diagnostics.continuity(*_ranked(s, d), K), f"{_RANKS} SELECT {_C} AS continuity FROM r")
_register("kruskal_stress", _stress, f"{_RANKS} SELECT {_S} AS stress FROM r WHERE i < j")


def _summary(s: SparkSession, d: str) -> DataFrame:
    return diagnostics.summary_of_blocks(_near(tables.beliefs, 10, "fisher_rao", K, (PLANE,), sums=True)(s, d), tables.beliefs(s, d).count(), K)


_register("diagnostics_summary", _summary, f"{_RANKS} SELECT {_T} AS trustworthiness, {_C} AS continuity, {_S} AS stress, count(*) FILTER (WHERE rh <= {K} AND rl <= {K}) AS preserved, count(*) FILTER (WHERE rh <= {K} AND rl > {K}) AS torn, count(*) FILTER (WHERE rl <= {K} AND rh > {K}) AS false_neighbors FROM r")

_DISTORTION = f"{_pairs_sql(BELIEFS, 'fisher_rao', plane=PLANE)}, m AS (SELECT avg(h) FILTER (WHERE h > 0) AS mh, avg(l) FILTER (WHERE l > 0) AS ml FROM pr), d AS (SELECT i AS object_id, coalesce(avg(CASE WHEN h / mh > 1e-6 THEN (l / ml) / (h / mh) END), 1.0) AS distortion FROM pr, m GROUP BY i)"
def _distorted(s: SparkSession, d: str) -> DataFrame:
    metric = REGISTRY.get("fisher_rao")
    placed = blocks.placed(tables.beliefs(s, d), "vec", 10, metric, [tuple(F.col("vec")[k] for k in PLANE)])
    return diagnostics.distortion_of_blocks(placed, 10, metric)


_register("point_distortion", lambda s, d: _distorted(s, d).withColumn("distortion", result(F.col("distortion"))), f"{_DISTORTION} SELECT object_id, {_r('distortion')} AS distortion FROM d")


def _grid(s: SparkSession, d: str) -> DataFrame:
    v = tables.beliefs(s, d).select("object_id", F.col("vec")[0].alias("x"), F.col("vec")[1].alias("y"))
    return diagnostics.grid(v.join(_distorted(s, d), "object_id"), diagnostics.bounds(v), 16)


_register("distortion_grid", _grid, f"""{_DISTORTION}, q AS (SELECT object_id, vec[1] AS x, vec[2] AS y FROM v),
b AS (SELECT min(x) - greatest(0.05, 0.12 * (max(x) - min(x))) AS x0, max(x) + greatest(0.05, 0.12 * (max(x) - min(x))) AS x1, min(y) - greatest(0.05, 0.12 * (max(y) - min(y))) AS y0, max(y) + greatest(0.05, 0.12 * (max(y) - min(y))) AS y1 FROM q),
a AS (SELECT (y1 - y) / ((y1 - y0) / 16) AS r, (x - x0) / ((x1 - x0) / 16) AS c, distortion FROM q JOIN d USING (object_id), b),
g AS (SELECT CAST(row AS INTEGER) AS row, CAST(col AS INTEGER) AS col, distortion FROM a, unnest(range(0, 16)) AS u(row), unnest(range(0, 16)) AS t(col) WHERE r BETWEEN row AND row + 1 AND c BETWEEN col AND col + 1)
SELECT row, col, {_r('avg(distortion)', 3)} AS mean_distortion FROM g GROUP BY row, col""")


def _stability(s: SparkSession, d: str) -> DataFrame:
    return diagnostics.stability_of_blocks(_near(tables.beliefs, 10, "fisher_rao", K, PLANES, ranks=())(s, d), len(PLANES), K)


_PLANE_RANKS = ", ".join(f"row_number() OVER (PARTITION BY i ORDER BY round(l{n}, 9), j) AS r{n}" for n in range(3))
_STABILITY = f"""WITH {BELIEFS.sql}, w AS (SELECT object_id, {_ROOT} AS w, vec FROM v),
pr AS (SELECT a.object_id AS i, b.object_id AS j, {_DISTANCES['fisher_rao'][0]} AS h, {', '.join(f'sqrt((a.vec[{p + 1}] - b.vec[{p + 1}]) ** 2 + (a.vec[{q + 1}] - b.vec[{q + 1}]) ** 2) AS l{n}' for n, (p, q) in enumerate(PLANES))} FROM w a, w b WHERE a.object_id <> b.object_id),
r AS (SELECT i, row_number() OVER (PARTITION BY i ORDER BY round(h, 9), j) AS rh, {_PLANE_RANKS} FROM pr),
t AS (SELECT i AS object_id, sum({' + '.join(f'(rh <= {K} AND r{n} <= {K})::INT' for n in range(3))}) / {3.0 * K} AS stability FROM r GROUP BY i)"""
_register("point_stability", lambda s, d: _stability(s, d).withColumn("stability", result(F.col("stability"), 4)), f"{_STABILITY} SELECT object_id, {_r('stability', 4)} AS stability FROM t")
_register("stability_summary", lambda s, d: diagnostics.stability_summary(_stability(s, d)), f"{_STABILITY} SELECT {_r('avg(stability)', 4)} AS mean_stability, {_r('avg((stability >= 0.65)::INT)', 4)} AS persistence, {_r('avg((stability < 0.35)::INT)', 4)} AS volatile FROM t")
_register("stability_tags", lambda s, d: _stability(s, d).select("object_id", diagnostics.stability_tag(F.col("stability")).alias("tag")), f"{_STABILITY} SELECT object_id, CASE WHEN stability >= 0.65 THEN 'invariant' WHEN stability >= 0.35 THEN 'moderate' ELSE 'sensitive' END AS tag FROM t")

# -- moments -----------------------------------------------------------------------------------


def _matrix(query: Callable[[DataFrame], np.ndarray]) -> Query:
    def run(s: SparkSession, d: str) -> DataFrame:
        v = tables.embeddings(s, d)
        return moments.table_of(query(v), v)

    return run


_AXES = f"{EMBEDDINGS.sql}, x AS (SELECT a, b, label, vec[a + 1] AS xa, vec[b + 1] AS xb FROM v, unnest(range(0, {ENTRIES})) AS p(a), unnest(range(0, {ENTRIES})) AS q(b))"
_ab = "CAST(a AS INTEGER) AS a, CAST(b AS INTEGER) AS b"
_register("column_moments", _matrix(lambda v: moments.moments(v, ENTRIES).covariance), f"WITH {_AXES} SELECT {_ab}, {_r('covar_samp(xa, xb)')} AS value FROM x GROUP BY a, b")
_register("class_scatter_within", _matrix(lambda v: moments.scatter_within(moments.moments_by(v, ENTRIES))), f"WITH {_AXES}, c AS (SELECT a, b, label, covar_pop(xa, xb) * count(*) AS s FROM x GROUP BY a, b, label) SELECT {_ab}, {_r('sum(s)')} AS value FROM c GROUP BY a, b")
_register("class_scatter_between", _matrix(lambda v: moments.scatter_between(moments.moments_by(v, ENTRIES))), f"WITH {_AXES}, c AS (SELECT a, b, label, count(*) AS n, avg(xa) AS ma, avg(xb) AS mb FROM x GROUP BY a, b, label), g AS (SELECT a, b, avg(xa) AS ga, avg(xb) AS gb FROM x GROUP BY a, b) SELECT {_ab}, {_r('sum(n * (ma - ga) * (mb - gb))')} AS value FROM c JOIN g USING (a, b) GROUP BY a, b")
_register("entropy_second_moment", _matrix(lambda v: moments.moments(v, ENTRIES).about(np.full(ENTRIES, 1 / ENTRIES))), f"WITH {_AXES} SELECT {_ab}, {_r('sum((xa - 1.0 / 64) * (xb - 1.0 / 64))')} AS value FROM x GROUP BY a, b")

# -- selections and checks -----------------------------------------------------------------------


def _marquee(s: SparkSession, d: str) -> DataFrame:
    p = _predicted(s, d).withColumn("x", F.col("vec")[0]).withColumn("y", F.col("vec")[1])
    return selection.selection_summary(selection.marquee(p, 0.0, 0.1, 0.05, 0.3))


_register("marquee_summary", _marquee, f"WITH {_PREDICTED} SELECT n, mean_confidence, classes FROM (SELECT count(*) AS n, {_r('avg(confidence)')} AS mean_confidence, string_agg(DISTINCT predicted_label, ',' ORDER BY predicted_label) AS classes FROM p WHERE vec[1] BETWEEN 0.0 AND 0.1 AND vec[2] BETWEEN 0.05 AND 0.3) WHERE n >= 2")


def _hit(s: SparkSession, d: str) -> DataFrame:
    p = tables.beliefs(s, d).select("object_id", F.col("vec")[0].alias("x"), F.col("vec")[1].alias("y"), F.col("object_id").alias("pos"))
    return selection.hit(p, 0.1, 0.1, 0.03).select("object_id")


_register("hit_test", _hit, f"WITH {BELIEFS.sql} SELECT object_id FROM v WHERE sqrt((vec[1] - 0.1) ** 2 + (vec[2] - 0.1) ** 2) <= 0.03 ORDER BY object_id DESC LIMIT 1")


_register("validate_constraints", lambda s, d: selection.constraint_counts(tables.mixes(s, d).withColumn("vec", F.transform("vec", lambda x: x * F.when(F.col("object_id").endswith("7"), 1.5).otherwise(1.0)))), f"WITH {MIXES.sql}, q AS (SELECT list_transform(vec, lambda x: x * CASE WHEN object_id LIKE '%7' THEN 1.5 ELSE 1.0 END) AS vec FROM v) SELECT count(*) AS n, 0 AS finite, count(*) FILTER (WHERE list_min(vec) < 0) AS nonnegative, count(*) FILTER (WHERE abs(list_sum(vec) - 1) > 1e-10) AS row_sum_1, count(*) FILTER (WHERE abs(list_sum(vec)) > 1e-10) AS row_sum_0 FROM q")
_register("duplicate_ids", lambda s, d: selection.duplicate_ids(tables._read(s, d, "orders").select(F.col("o_custkey").cast("string").alias("object_id"))), "SELECT CAST(o_custkey AS VARCHAR) AS object_id, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 1")
_register("id_set_difference", lambda s, d: selection.missing_ids(tables._read(s, d, "customer").select(F.col("c_custkey").cast("string").alias("object_id")), tables._read(s, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").cast("string").alias("object_id"))), "SELECT DISTINCT CAST(c_custkey AS VARCHAR) AS object_id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
_register(
    "row_order_check",
    lambda s, d: selection.out_of_order(tables._read(s, d, "nation").select(F.col("n_name").alias("object_id"), F.col("n_nationkey").cast("long").alias("pos")), tables._read(s, d, "nation").select(F.col("n_name").alias("object_id"), (F.col("n_nationkey") - F.col("n_nationkey") % 5).cast("long").alias("pos"))),
    "SELECT n_name AS object_id, CAST(n_nationkey AS BIGINT) AS pos_a, CAST(n_nationkey - n_nationkey % 5 AS BIGINT) AS pos_b FROM nation WHERE n_nationkey % 5 <> 0",
)

# -- fitted views ----------------------------------------------------------------------------------


def _fitted(basis: Callable[[DataFrame], np.ndarray]) -> Query:
    def run(s: SparkSession, d: str) -> DataFrame:
        v = tables.beliefs(s, d)
        return _xy(projection.project(v, basis(v), centre=projection.column_means(v, 10)))

    return run


def _subset(v: DataFrame) -> np.ndarray:
    return bases.integrity_plane(moments.moments(v.where("object_id < 'vec_000020'"), 10), moments.moments(v, 10))


def _axes_sql(source: str, first: int, centre: str | None = None) -> str:
    """CTEs that end in ``pl(a, b)``: the plane of principal axes ``first`` and the next of beliefs."""
    return f"{plane_sql.scatter('sc', source, 'vec', 10, centre)}, {plane_sql.axes('ax', 'sc', 10, first + 1)}, {plane_sql.plane('pl', f'ax{first}', f'ax{first + 1}')}"


def _classes_sql(label: str, axes: str = "ax", plane: str = "pl") -> str:
    """CTEs that end in ``plane(a, b)``: Fisher's plane of beliefs by a label, from the axes of the between scatter over the ridged within scatter."""
    ij = [(i, j) for i in range(1, 11) for j in range(1, 11)]
    table = lambda cell: "[" + ", ".join("[" + ", ".join(cell(i, j) for j in range(1, 11)) + "]" for i in range(1, 11)) + "]"
    within = ", ".join(f"covar_pop(vec[{i}], vec[{j}]) * count(*) AS w{i}_{j}" for i, j in ij)
    means = ", ".join(f"avg(vec[{i}]) AS m{i}" for i in range(1, 11))
    whole = ", ".join(f"avg(vec[{i}]) AS g{i}" for i in range(1, 11))
    inner = table(lambda i, j: f"sum(w{i}_{j}) + {bases.RIDGE if i == j else 0.0}")
    outer = table(lambda i, j: f"sum(n * (m{i} - g{i}) * (m{j} - g{j}))")
    return f"""cl AS (SELECT {label} AS label, count(*) AS n, {means}, {within} FROM v GROUP BY 1), gm AS (SELECT {whole} FROM v),
wi AS (SELECT {inner} AS m FROM cl), be AS (SELECT {outer} AS m FROM cl, gm), {plane_sql.inverse('iv', 'wi', 10)},
ra AS (SELECT {plane_sql.product('x', 'y', 10)} AS m FROM (SELECT iv.m AS x, be.m AS y FROM iv, be)), {plane_sql.axes(axes, 'ra', 10, 2)}, {plane_sql.plane(plane, f'{axes}1', f'{axes}2', orthonormal=True)}"""


def _placed_sql(planes: str) -> str:
    centred = "list_transform(range(1, 11), lambda k: vec[k] - c.m[k])"
    means = ", ".join(f"avg(vec[{i}])" for i in range(1, 11))
    return f"WITH RECURSIVE {BELIEFS.sql}, {planes}, c AS (SELECT [{means}] AS m FROM v) SELECT object_id, {_r(f'list_dot_product({centred}, pl.a)')} AS x, {_r(f'list_dot_product({centred}, pl.b)')} AS y FROM v, c, pl"


_FEW = "(SELECT * FROM v WHERE object_id < 'vec_000020')"
_register("pca_view", _fitted(lambda v: bases.pca(moments.moments(v, 10))[0]), _placed_sql(_axes_sql("v", 1)))
_register("minor_pca_view", _fitted(lambda v: bases.axes(moments.moments(v, 10).covariance, 2)), _placed_sql(_axes_sql("v", 3)))
_register("entropy_view", _fitted(lambda v: bases.entropy_plane(moments.moments(v, 10))), _placed_sql(_axes_sql("v", 2, "0.1")))
_register("lda_view", _fitted(lambda v: bases.discriminant_plane(moments.moments_by(v, 10))), _placed_sql(_classes_sql("label")))
_register("integrity_view", _fitted(_subset), _placed_sql(_axes_sql(_FEW, 1)))


def _loadings(s: SparkSession, d: str) -> DataFrame:
    rows = projection.loadings(bases.pca(moments.moments(tables.beliefs(s, d), 10))[0], CLASS_NAMES)
    return s.createDataFrame([(n, round(v, 6) + 0.0) for n, v in rows], "feature string, loading double")


def _share_of_first(s: SparkSession, d: str) -> DataFrame:
    share = projection.variance_share(bases.pca(moments.moments(tables.beliefs(s, d), 10))[1])
    return s.createDataFrame([(round(share, 6),)], "share double")


_PCA = f"WITH RECURSIVE {BELIEFS.sql}, {_axes_sql('v', 1)}"
_along = lambda v: f"list_dot_product({v}, list_transform(m, lambda r: list_dot_product(r, {v})))"
_register("feature_loadings_top4", _loadings, f"{_PCA}, l AS (SELECT 'class_' || (k - 1) AS feature, sqrt(a[k] ** 2 + b[k] ** 2) AS loading FROM pl, unnest(range(1, 11)) AS u(k)) SELECT feature, {_r('loading')} AS loading FROM l ORDER BY round(loading, 9) DESC, feature LIMIT 4")
_register("variance_share", _share_of_first, f"{_PCA} SELECT {_r(f'{_along('a')} / ({_along('a')} + {_along('b')})')} AS share FROM pl, sc")


def _catalog(s: SparkSession, d: str) -> DataFrame:
    rows = [(v.view_id, k, *(round(float(x), 6) + 0.0 for x in v.basis[k]), v.misleading, v.valid) for v in catalog.catalog(tables.beliefs(s, d), 10).values() for k in range(10)]
    return s.createDataFrame(rows, "view_id string, k int, x double, y double, misleading boolean, valid boolean")


def _views_sql() -> dict[str, str]:
    """CTEs that end in ``pl(a, b)`` for each of the five views; the bridge comes from its seed alone."""
    bridge = bases.bridge_plane(10)
    return {
        "pca_corners": _axes_sql("v", 1), "minor_pca": _axes_sql("v", 3), "fisher_lda": _classes_sql("list_position(vec, list_max(vec))"),
        "collapsed_bridge": f"pl AS (SELECT {plane_sql.literal(bridge[:, 0])} AS a, {plane_sql.literal(bridge[:, 1])} AS b)", "entropy": _axes_sql("v", 2, "0.1"),
    }


def _catalog_sql() -> str:
    """The five views' bases."""
    one = lambda name, sql: f"SELECT '{name}' AS view_id, CAST(k - 1 AS INTEGER) AS k, {_r('a[k]')} AS x, {_r('b[k]')} AS y, {name == 'collapsed_bridge'} AS misleading, true AS valid FROM (WITH RECURSIVE {BELIEFS.sql}, {sql} SELECT a, b FROM pl), unnest(range(1, 11)) AS u(k)"
    return " UNION ALL ".join(one(n, sql) for n, sql in _views_sql().items())


_register("projection_catalog", _catalog, _catalog_sql())


def _catalog_stability(s: SparkSession, d: str) -> DataFrame:
    """The share of each point's source neighbours that the catalogue's views keep, all views in one meeting of blocks."""
    v, metric = tables.beliefs(s, d), REGISTRY.get("euclidean")
    planes = [w.basis for w in catalog.catalog(v, 10).values()]
    placed = blocks.placed(v, "vec", 10, metric, [tuple(projection.along_named("vec", b[:, i]) for i in (0, 1)) for b in planes])
    scores = diagnostics.stability_of_blocks(blocks.neighbours(placed, 10, metric, len(planes), K, ranks=()), len(planes), K)
    return scores.select("object_id", result(F.col("stability"), 4).alias("stability"), diagnostics.stability_tag(F.col("stability")).alias("tag"))


def _catalog_stability_sql() -> str:
    pool = " UNION ALL ".join(f"SELECT {n} AS pos, a, b FROM (WITH RECURSIVE {BELIEFS.sql}, {sql} SELECT a, b FROM pl)" for n, sql in enumerate(_views_sql().values()))
    return f"""WITH {BELIEFS.sql}, pool AS ({pool}),
sr AS (SELECT a.object_id AS i, b.object_id AS j, row_number() OVER (PARTITION BY a.object_id ORDER BY round(list_distance(a.vec, b.vec), 9), b.object_id) AS rh FROM v a, v b WHERE a.object_id <> b.object_id),
xy AS (SELECT pos, object_id, list_dot_product(vec, a) AS x, list_dot_product(vec, b) AS y FROM v, pool),
vr AS (SELECT a.object_id AS i, b.object_id AS j, row_number() OVER (PARTITION BY a.pos, a.object_id ORDER BY round(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2), 9), b.object_id) AS rl FROM xy a JOIN xy b ON a.pos = b.pos AND a.object_id <> b.object_id),
t AS (SELECT i AS object_id, sum((rh <= {K})::INT) / {float(K * len(_views_sql()))} AS stability FROM vr JOIN sr USING (i, j) WHERE rl <= {K} GROUP BY i)
SELECT object_id, {_r('stability', 4)} AS stability, CASE WHEN stability >= 0.65 THEN 'invariant' WHEN stability >= 0.35 THEN 'moderate' ELSE 'sensitive' END AS tag FROM t"""


_register("catalog_stability", _catalog_stability, _catalog_stability_sql())


def _tour_sql(frames: int) -> str:
    """The tour's planes come from its seed alone; points are scaled, laid into them and fitted to the frame here."""
    planes = tours.grand_tour_bases(10, frames)
    rows = ", ".join(f"({n}, {plane_sql.literal(b[:, 0])}, {plane_sql.literal(b[:, 1])})" for n, b in enumerate(planes))
    moment = ", ".join(f"avg(vec[{i}]), CASE WHEN stddev_pop(vec[{i}]) < 1e-8 THEN 1.0 ELSE stddev_pop(vec[{i}]) END" for i in range(1, 11))
    z = "list_transform(range(1, 11), lambda k: (vec[k] - m[2 * k - 1]) / m[2 * k])"
    unit = lambda c: _r(f"2 * ({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()) - 1")
    return f"WITH {BELIEFS.sql}, m AS (SELECT [{moment}] AS m FROM v), z AS (SELECT object_id, {z} AS z FROM v, m), p(frame, a, b) AS (VALUES {rows}), f AS (SELECT frame, object_id, list_dot_product(z, a) AS x, list_dot_product(z, b) AS y FROM z, p) SELECT CAST(frame AS INTEGER) AS frame, object_id, {unit('x')} AS x, {unit('y')} AS y FROM f"


_register("tour_frames", lambda s, d: projection.rounded(tours.grand_tour(tables.beliefs(s, d), 10, 60), "x", "y"), _tour_sql(60))
_register("guided_view_frames", lambda s, d: projection.rounded(tours.guided_view(tables.beliefs(s, d), 10, "class_separation", n_frames=12).frames, "x", "y"))
_register("guided_view_integrity", lambda s, d: projection.rounded(tours.guided_view(tables.beliefs(s, d), 10, "neighborhood_integrity", "vec_000003", 12).frames, "x", "y"))


def _rashomon(s: SparkSession, d: str) -> DataFrame:
    rows = [(n, c.id, c.trustworthiness, c.grassmann_degrees) for n, c in enumerate(rashomon.rashomon_set(tables.beliefs(s, d), 10))]
    return s.createDataFrame(rows, "place int, id string, trustworthiness double, grassmann_degrees double")


def _planes_sql() -> str:
    """CTEs p1 to p4(a, b): the fitted planes of beliefs that Rashomon sets choose from."""
    return ", ".join([
        plane_sql.scatter("sc", "v", "vec", 10), plane_sql.axes("ax", "sc", 10, 4), plane_sql.plane("p1", "ax1", "ax2"), plane_sql.plane("p2", "ax3", "ax4"),
        _classes_sql("label", "ay", "p3"), f"co AS (SELECT {plane_sql.combined('m', 'm', 10, '{a} / sqrt(m[ci][ci] * m[cj][cj])')} AS m FROM sc)", plane_sql.axes("az", "co", 10, 2), plane_sql.plane("p4", "az1", "az2"),
    ])


_NAMED = [f"SELECT {n} AS pos, '{name}' AS id, a, b FROM p{n + 1}" for n, name in enumerate(("pca_12", "pca_34", "fisher_lda", "covariance"))]


def _between(f: str, t: str) -> tuple[str, str, Callable[[str], str]]:
    """SQL of two planes' 2 x 2 product: its squared size, its determinant, and the cosine of the smaller (+) or larger (-) angle from columns s and d."""
    dot = lambda x, y: f"list_dot_product({f}.{x}, {t}.{y})"
    size, det = " + ".join(f"{dot(x, y)} ** 2" for x in "ab" for y in "ab"), f"abs({dot('a', 'a')} * {dot('b', 'b')} - {dot('a', 'b')} * {dot('b', 'a')})"
    return size, det, lambda sign: f"least(1.0, greatest(0.0, (sqrt(s + 2 * d) {sign} sqrt(greatest(s - 2 * d, 0.0))) / 2))"


def _rashomon_sql() -> str:
    """The candidates' planes, their trustworthiness, and the choice one by one; random planes come from their seeds alone."""
    named = list(_NAMED)
    drawn = [bases.haar(10, 2, 42 + i) for i in range(rashomon.RANDOM_PLANES)]
    named += [f"SELECT {4 + i}, 'haar_{i:02d}', {plane_sql.literal(b[:, 0])}, {plane_sql.literal(b[:, 1])}" for i, b in enumerate(drawn)]
    size, det, cosine = _between("f", "t")
    k, n = rashomon.NEIGHBORS, "(SELECT count(*) FROM v)"
    scale = f"(CASE WHEN {k} <= {n} / 2.0 THEN 2.0 / ({n} * {k} * (2 * {n} - {3 * k} - 1)) ELSE 2.0 / ({n} * ({n} - {k}) * ({n} - {k} - 1)) END)"
    return f"""WITH RECURSIVE {BELIEFS.sql}, {_planes_sql()}, pool AS ({' UNION ALL '.join(named)}),
sr AS (SELECT a.object_id AS i, b.object_id AS j, row_number() OVER (PARTITION BY a.object_id ORDER BY round(list_distance(a.vec, b.vec), 9), b.object_id) AS rh FROM v a, v b WHERE a.object_id <> b.object_id),
xy AS (SELECT pos, object_id, list_dot_product(vec, a) AS x, list_dot_product(vec, b) AS y FROM v, pool),
vr AS (SELECT pos, i, j FROM (SELECT a.pos, a.object_id AS i, b.object_id AS j, row_number() OVER (PARTITION BY a.pos, a.object_id ORDER BY round(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2), 9), b.object_id) AS rl FROM xy a JOIN xy b ON a.pos = b.pos AND a.object_id <> b.object_id) WHERE rl <= {k}),
tr AS (SELECT pos, least(1.0, greatest(0.0, 1 - {scale} * sum(greatest(rh - {k}, 0)))) AS trust FROM vr JOIN sr USING (i, j) GROUP BY pos),
far AS (SELECT p, q, degrees(sqrt(acos({cosine('+')}) ** 2 + acos({cosine('-')}) ** 2)) AS deg FROM (SELECT f.pos AS p, t.pos AS q, {size} AS s, {det} AS d FROM pool f, pool t)),
ord AS (SELECT row_number() OVER (ORDER BY trust DESC, pos) AS nth, pos, id, trust, coalesce((SELECT list(q) FROM far WHERE far.p = pool.pos AND far.q <> pool.pos AND deg < {rashomon.APART_DEGREES}), []) AS close FROM pool JOIN tr USING (pos)),
rec(nth, taken) AS (SELECT 0::BIGINT, []::INTEGER[] UNION ALL SELECT o.nth, CASE WHEN o.trust >= 0.5 AND len(taken) < 6 AND NOT list_has_any(taken, o.close) THEN list_append(taken, o.pos) ELSE taken END FROM rec JOIN ord o ON o.nth = rec.nth + 1)
SELECT CAST(list_position(taken, pos) - 1 AS INTEGER) AS place, id, {_r('trust', 4)} AS trustworthiness, {_r('deg', 2)} AS grassmann_degrees
FROM ord JOIN far ON far.p = 0 AND far.q = ord.pos, (SELECT taken FROM rec ORDER BY nth DESC LIMIT 1) WHERE list_contains(taken, pos)"""


_register("rashomon_set", _rashomon, _rashomon_sql())


def _angles(s: SparkSession, d: str) -> DataFrame:
    """Angles between each two of the planes that beliefs are fitted with; only planes reach the driver."""
    planes = [(name, b) for name, b in rashomon.pool(tables.beliefs(s, d), 10) if not name.startswith("haar")]
    rows = []
    for n, (left, a) in enumerate(planes):
        for right, b in planes[n + 1 :]:
            t = np.degrees(bases.principal_angles(a, b))
            rows.append((f"{left}, {right}", round(float(t[0]), 2) + 0.0, round(float(t[1]), 2) + 0.0, round(float(np.hypot(*t)), 2) + 0.0, diagnostics.angle_label(float(np.hypot(*t)))))
    return s.createDataFrame(rows, "pair string, theta_1_deg double, theta_2_deg double, grassmannian_dist_deg double, interpretation string")


def _angles_sql() -> str:
    """Cosines of the angles are the singular values of the 2 x 2 products, in closed form."""
    size, det, cosine = _between("f", "t")
    return f"""WITH RECURSIVE {BELIEFS.sql}, {_planes_sql()}, pool AS ({" UNION ALL ".join(_NAMED)}),
c AS (SELECT f.id || ', ' || t.id AS pair, {size} AS s, {det} AS d FROM pool f, pool t WHERE f.pos < t.pos), g AS (SELECT pair, degrees(acos({cosine('+')})) AS u, degrees(acos({cosine('-')})) AS w FROM c)
SELECT pair, {_r('u', 2)} AS theta_1_deg, {_r('w', 2)} AS theta_2_deg, {_r('sqrt(u ** 2 + w ** 2)', 2)} AS grassmannian_dist_deg, CASE WHEN sqrt(u ** 2 + w ** 2) < 15 THEN 'tight' WHEN sqrt(u ** 2 + w ** 2) < 45 THEN 'moderate' ELSE 'divergent' END AS interpretation FROM g"""


_register("subspace_angles", _angles, _angles_sql())


# -- table functions ---------------------------------------------------------------------------


def _by_table_functions(s: SparkSession, d: str) -> DataFrame:
    """Nearest neighbours written in SQL alone, each pair of blocks one call of a table function."""
    table_functions.register(s)
    points = tables.beliefs(s, d)
    points.createOrReplaceTempView("planewise_beliefs")
    sides = 4 * blocks.shape(points.count(), s.sparkContext.defaultParallelism)[1]
    return s.sql(f"""WITH dealt AS (SELECT * FROM dealt(TABLE(planewise_beliefs), {sides})),
        near AS (SELECT * FROM neighbours(TABLE(dealt) PARTITION BY (a, b), {K}, 'aitchison')),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY src_id ORDER BY round(distance, 9), neighbor_id) AS rank FROM near)
        SELECT src_id, neighbor_id, CAST(rank AS INT) AS rank, round(distance, 6) + 0D AS distance FROM ranked WHERE rank <= {K}""")


_register("knn_table_functions", _by_table_functions, _knn_sql(BELIEFS, "aitchison"))

# -- joins by time -----------------------------------------------------------------------------


def _asof(s: SparkSession, d: str) -> DataFrame:
    """How much of the user's last day with events was of each event's type: its share in the composition that was known at the time."""
    events = tables._read(s, d, "events").select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp_ntz").alias("ts"))
    daily = events.groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), *(F.count_if(F.col("event_type") == k).alias(f"n{i}") for i, k in enumerate(EVENT_TYPES)))
    daily = daily.select("user_id", F.date_add("day", 1).cast("timestamp_ntz").alias("ts"), "n", *(f"n{i}" for i in range(len(EVENT_TYPES))))
    found = times.asof(events, daily, "user_id", "ts", spread="event_id")
    own = F.coalesce(*(F.when(F.col("event_type") == k, F.col(f"right_n{i}")) for i, k in enumerate(EVENT_TYPES)))
    return found.select("event_id", F.to_date("right_ts").cast("string").alias("as_of"), F.col("right_n").alias("n"), result(own / F.col("right_n")).alias("share"))


_DAILY = ", ".join(f"count(*) FILTER (WHERE event_type = '{k}') AS n{i}" for i, k in enumerate(EVENT_TYPES))
_OWN = " ".join(f"WHEN '{k}' THEN n{i}" for i, k in enumerate(EVENT_TYPES))
_register("asof_composition", _asof, f"WITH d AS (SELECT user_id, (ts::DATE + INTERVAL 1 DAY)::TIMESTAMP AS known, count(*) AS n, {_DAILY} FROM events GROUP BY 1, 2) SELECT event_id, strftime(known, '%Y-%m-%d') AS as_of, n, {_r(f'CASE event_type {_OWN} END / n')} AS share FROM events e ASOF LEFT JOIN d ON e.user_id = d.user_id AND e.ts >= d.known")

TEN_MINUTES = 600_000_000


def _followed(s: SparkSession, d: str) -> DataFrame:
    """Each error and its user's events in the hours after it, as many as the error's value says."""
    events = tables._read(s, d, "events").select("event_id", "user_id", "event_type", "value", times.micros(F.col("ts").cast("timestamp_ntz")).alias("at"))
    spans = events.where("event_type = 'error'").select("event_id", "user_id", "at", (F.col("at") + F.round(F.col("value") * 3.6e9).cast("long")).alias("until"))
    met = times.within(spans, events.drop("value"), "user_id", "at", "until", "at", TEN_MINUTES)
    return met.groupBy("event_id").agg(F.count("*").alias("n"), F.count_if(F.col("point_event_type") == "purchase").alias("n_purchases"), (F.max("point_at") - F.min("point_at")).alias("span_us"))


_register("events_after_errors", _followed, "WITH s AS (SELECT event_id, user_id, epoch_us(ts) AS a, epoch_us(ts) + round(value * 3.6e9)::BIGINT AS b FROM events WHERE event_type = 'error') SELECT s.event_id, count(*) AS n, count(*) FILTER (WHERE e.event_type = 'purchase') AS n_purchases, max(epoch_us(e.ts)) - min(epoch_us(e.ts)) AS span_us FROM s JOIN events e ON e.user_id = s.user_id AND epoch_us(e.ts) BETWEEN a AND b GROUP BY 1")

# -- transitions -----------------------------------------------------------------------------------


def _later_beliefs(s: SparkSession, d: str) -> DataFrame:
    """Beliefs of the same objects from their next ten entries."""
    v = tables.embeddings(s, d)
    return v.select("object_id", vectors.softmax(F.transform(F.slice("vec", 11, 10), lambda x: x * 8.0)).alias("vec"))


_BOTH = f"""{BELIEFS.sql}, e2 AS (SELECT 'vec_' || lpad(vec_id::VARCHAR, 6, '0') AS object_id, list_transform(embedding[11:20]::DOUBLE[], lambda x: exp(8 * x)) AS e FROM embeddings),
ab AS (SELECT v.object_id, v.vec AS p, list_transform(e2.e, lambda x: x / list_sum(e2.e)) AS q FROM v JOIN e2 USING (object_id))"""
_GEODESIC = f"""WITH {_BOTH}, g AS (SELECT *, acos(least(1.0, list_sum(list_transform(range(1, 11), lambda k: sqrt(p[k] * q[k]))))) AS angle FROM ab),
f AS (SELECT *, f / 4.0::DOUBLE AS tau FROM g, unnest(range(0, 5)) AS u(f))
SELECT CAST(f AS INTEGER) AS frame, object_id, CAST(k - 1 AS INTEGER) AS k, {_r('((sin((1 - tau) * angle) * sqrt(p[k]) + sin(tau * angle) * sqrt(q[k])) / sin(angle)) ** 2')} AS value FROM f, unnest(range(1, 11)) AS t(k)"""
_register("domain_geodesic_frames", lambda s, d: transitions.domain_geodesic(tables.beliefs(s, d), _later_beliefs(s, d), 5).select("frame", "object_id", F.posexplode("vec").alias("k", "value")).withColumn("value", result(F.col("value"))), _GEODESIC)


def _morph(s: SparkSession, d: str) -> DataFrame:
    """From the plane of the first two classes to that of their roots' next two."""
    v = tables.beliefs(s, d)
    ends = [projection.project(df, _axis_plane(10, plane)).select("object_id", "x", "y") for df, plane in ((v, (0, 1)), (v.withColumn("vec", vectors.sqrt_probability(F.col("vec"))), (2, 3)))]
    return projection.rounded(transitions.procrustes_morph(*ends, 5), "x", "y")


_MORPH = f"""WITH {BELIEFS.sql}, c AS (SELECT object_id, vec[1] - avg(vec[1]) OVER () AS ax, vec[2] - avg(vec[2]) OVER () AS ay, sqrt(vec[3]) - avg(sqrt(vec[3])) OVER () AS dx, sqrt(vec[4]) - avg(sqrt(vec[4])) OVER () AS dy, avg(vec[1]) OVER () AS mx, avg(vec[2]) OVER () AS my FROM v),
m AS (SELECT sum(dx * ax) AS xx, sum(dx * ay) AS xy, sum(dy * ax) AS yx, sum(dy * ay) AS yy, sum(dx * dx + dy * dy) AS bb FROM c),
o AS (SELECT *, sqrt((xx + yy) ** 2 + (xy - yx) ** 2) AS turn, sqrt((xx - yy) ** 2 + (xy + yx) ** 2) AS flip FROM m),
r AS (SELECT CASE WHEN turn >= flip THEN (xx + yy) / bb ELSE (xx - yy) / bb END AS co, CASE WHEN turn >= flip THEN (xy - yx) / bb ELSE (xy + yx) / bb END AS si, CASE WHEN turn >= flip THEN 1 ELSE -1 END AS sign FROM o),
f AS (SELECT f, f / 4.0::DOUBLE AS tau FROM unnest(range(0, 5)) AS u(f))
SELECT CAST(f AS INTEGER) AS frame, object_id, {_r('mx + (1 - tau) * ax + tau * (co * dx - sign * si * dy)')} AS x, {_r('my + (1 - tau) * ay + tau * (si * dx + sign * co * dy)')} AS y, false AS valid FROM c, r, f"""
_register("procrustes_morph_frames", _morph, _MORPH)

_register("point_metadata", lambda s, d: datasets.point_metadata(tables.beliefs(s, d), CLASS_NAMES).withColumn("confidence", result(F.col("confidence"))).withColumn("entropy", result(F.col("entropy"))), f"WITH {_PREDICTED} SELECT object_id, label, predicted_label, {_r('confidence')} AS confidence, {_r(_BITS)} AS entropy, coalesce(label = predicted_label, false) AS correct FROM p")
_register("baseline_classifier", lambda s, d: _long(datasets.embedding_beliefs(s, d), F.col("vec")).withColumn("value", F.round("value", 2) + 0.0))


# -- profiles and sessions -----------------------------------------------------------------------


def _cube(s: SparkSession, d: str) -> DataFrame:
    """Points by class, predicted class and stability tag, at every level."""
    points = _predicted(s, d).select("object_id", "label", "predicted_label").join(_stability(s, d).withColumn("tag", diagnostics.stability_tag(F.col("stability"))), "object_id")
    return profiles.cube(points, ["label", "predicted_label", "tag"], "stability").withColumnRenamed("mean", "mean_stability").withColumn("mean_stability", result(F.col("mean_stability")))


_TAG = "CASE WHEN stability >= 0.65 THEN 'invariant' WHEN stability >= 0.35 THEN 'moderate' ELSE 'sensitive' END"
_register("diagnostics_cube", _cube, f"WITH {_PREDICTED}, {_STABILITY.removeprefix(f'WITH {BELIEFS.sql}, ')}, a AS (SELECT label, predicted_label, {_TAG} AS tag, stability FROM p JOIN t USING (object_id)) SELECT label, predicted_label, tag, CAST(GROUPING(label, predicted_label, tag) AS INTEGER) AS folded, count(*) AS n, {_r('avg(stability)')} AS mean_stability FROM a GROUP BY CUBE (label, predicted_label, tag)")

DECILES = tuple(n / 10 for n in range(1, 10))


def _quantiles(s: SparkSession, d: str) -> DataFrame:
    """Deciles of events' values by type, and of all types from the same sketches, each held against the exact ranks."""
    events = tables._read(s, d, "events")
    by_type = profiles.sketches(events, ["event_type"], "value")
    whole = profiles.merged(by_type).withColumn("event_type", F.lit("all"))
    found = profiles.quantiles(by_type.unionByName(whole), DECILES)
    rows = events.select(F.explode(F.array(F.col("event_type"), F.lit("all"))).alias("event_type"), "value")
    return profiles.rank_errors(rows, found, ["event_type"], "value").select("event_type", "quantile", "n", (F.col("error") <= 0.01).alias("close"))


_register("quantile_sketches", _quantiles, f"SELECT event_type, q AS quantile, n, true AS close FROM (SELECT coalesce(event_type, 'all') AS event_type, count(value) AS n FROM events GROUP BY ROLLUP (event_type)), (VALUES {', '.join(f'({q}::DOUBLE)' for q in DECILES)}) AS t(q)")


def _drift(s: SparkSession, d: str) -> DataFrame:
    """How far each session of a user lies from all sessions before it."""
    found = composition.drift(composition.sessions(tables._read(s, d, "events"), EVENT_TYPES, "6 hours"), len(EVENT_TYPES))
    return found.select(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("session_start"), "object_id", "n", "n_before", result(F.col("drift")).alias("drift"))


_SESSION_COUNTS = ", ".join(f"count(*) FILTER (WHERE event_type = '{k}') AS n{i}" for i, k in enumerate(EVENT_TYPES))
_BEFORE = ", ".join(f"sum(n{i}) OVER w AS b{i}" for i in range(len(EVENT_TYPES)))
_APART = " + ".join(f"(sqrt(n{i} / n) - sqrt(b{i} / before)) ** 2" for i in range(len(EVENT_TYPES)))
_register("session_drift", _drift, f"""WITH g AS (SELECT *, coalesce(ts - lag(ts) OVER o > INTERVAL 6 HOUR, true)::INT AS begins FROM events WINDOW o AS (PARTITION BY user_id ORDER BY ts)),
i AS (SELECT *, sum(begins) OVER (PARTITION BY user_id ORDER BY ts) AS nth FROM g),
c AS (SELECT user_id, min(ts) AS began, {_SESSION_COUNTS} FROM i GROUP BY user_id, nth), c2 AS (SELECT *, {' + '.join(f'n{i}' for i in range(len(EVENT_TYPES)))} AS n FROM c),
b AS (SELECT *, sum(n) OVER w AS before, {_BEFORE} FROM c2 WHERE n > 0 WINDOW w AS (PARTITION BY user_id ORDER BY began ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT strftime(began, '%Y-%m-%d %H:%M:%S') AS session_start, user_id::VARCHAR AS object_id, n, coalesce(before, 0)::BIGINT AS n_before, {_r(f'CASE WHEN before > 0 THEN least(1.0, sqrt(({_APART}) / 2)) END')} AS drift FROM b""")


TREE_ROWS, TREE_FANOUT = 64, 16
_TREE_COLUMNS = ["c_name", "c_nationkey", "c_mktsegment"]


def _tree(s: SparkSession, d: str) -> DataFrame:
    """Customers in the order of their keys, by blocks, with the digest over all."""
    held = ordered.blocks(tables._read(s, d, "customer"), _TREE_COLUMNS, "c_custkey", TREE_ROWS)
    return held.withColumn("root", F.lit(ordered.root(held, TREE_FANOUT).first()[0]))


def _tree_changes(s: SparkSession, d: str) -> DataFrame:
    """The blocks in which some customers moved to another nation, one is gone and one is new."""
    now = tables._read(s, d, "customer")
    key = F.col("c_custkey")
    later = now.where(key != 100).withColumn("c_nationkey", F.when(key % 499 == 7, F.col("c_nationkey") + 1).otherwise(F.col("c_nationkey")))
    later = later.unionByName(now.where(key == 5).withColumn("c_custkey", F.lit(10**9).cast("long")))
    return ordered.changed(*(ordered.blocks(t, _TREE_COLUMNS, "c_custkey", TREE_ROWS) for t in (now, later)))


_TREE_TEXT = " || ".join(f"coalesce(strlen({c}::VARCHAR) || ':' || {c}, '-')" for c in ["c_custkey", *_TREE_COLUMNS])
_TREE_LEVELS = ", ".join(f"l{i + 1} AS (SELECT block // {TREE_FANOUT} AS block, CASE WHEN (SELECT max(block) FROM l{i}) > 0 THEN sha256(string_agg(digest, '' ORDER BY block)) ELSE max(digest) END AS digest FROM l{i} GROUP BY 1)" for i in range(8))
_register("order_tree", _tree, f"WITH r AS (SELECT c_custkey // {TREE_ROWS} AS block, c_custkey, sha256({_TREE_TEXT}) AS d FROM customer), l0 AS (SELECT block, count(*) AS n, sha256(string_agg(d, '' ORDER BY c_custkey)) AS digest FROM r GROUP BY 1), {_TREE_LEVELS} SELECT block, n, l0.digest, (SELECT sha256(digest) FROM l8) AS root FROM l0")
_register("order_tree_changes", _tree_changes, f"WITH a AS (SELECT c_custkey // {TREE_ROWS} AS block, count(*) AS n_before, bool_or(c_custkey % 499 = 7 OR c_custkey = 100) AS differs, count(*) FILTER (WHERE c_custkey <> 100) AS n_after FROM customer GROUP BY 1) SELECT block, n_before, n_after FROM a WHERE differs UNION ALL SELECT {10**9 // TREE_ROWS}, NULL, count(*) FROM customer WHERE c_custkey = 5")


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)
