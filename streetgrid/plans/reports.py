"""Queries of report tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import reports, runlog
from .evaluation import RUN, _ranked
from .fixtures import load
from .registry import query
from .runs import _LATEST

#: Gain that counts in a verdict, and the runs' size below which nothing is said.
EPS, LEAST = 0.02, 100


@query(
    "block_group_rollup",
    "backbone seed:i city n_groups:i r2:f r:f",
    """SELECT backbone, seed, city, count(*) AS n_groups, CASE WHEN count(*) >= 2 THEN 1 - avg(power(t - p, 2)) / nullif(var_pop(t), 0) END AS r2, CASE WHEN count(*) >= 2 THEN corr(p, t) END AS r
    FROM (SELECT backbone, seed, city, floor(point_id / 12e0) AS bg, avg(score) AS p, max(y_reg / 1e5) AS t FROM fx_predictions GROUP BY ALL) GROUP BY backbone, seed, city""",
)
def block_group_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "fx_predictions").withColumn("bg", F.floor(F.col("point_id") / 12)).withColumn("t", F.col("y_reg") / 1e5)
    return reports.group_rollup(rows, RUN, "bg", "t", "score")


@query(
    "secondary_correlations",
    "backbone seed:i target n:i r:f",
    """SELECT backbone, seed, c AS target, count(*) AS n, CASE WHEN count(*) >= 3 AND var_pop(score) > 1e-16 AND var_pop(v) > 1e-16 THEN corr(score, v) END AS r FROM (SELECT backbone, seed, score, unnest(['y_bin', 'dlat', 'dlon']) AS c, unnest([CAST(y_bin AS DOUBLE), CAST(dlat AS DOUBLE), CAST(dlon AS DOUBLE)]) AS v
    FROM fx_predictions p JOIN fx_segments s ON s.seg_id = p.point_id) WHERE v IS NOT NULL GROUP BY backbone, seed, c""",
)
def secondary_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores against several columns, each where it is known."""
    more = load(spark, sf_dir, "fx_segments").select(F.col("seg_id").alias("point_id"), "dlat", "dlon")
    return reports.correlations(load(spark, sf_dir, "fx_predictions").join(more, "point_id"), ["backbone", "seed"], "score", ["y_bin", "dlat", "dlon"])


@query(
    "source_comparison",
    "city rho:f n:i r:f mae:f mean_a:f mean_b:f",
    f"SELECT city, corr(ra, rb) AS rho, count(*) AS n, corr(sidewalk_frac, vegetation_frac) AS r, avg(abs(sidewalk_frac - vegetation_frac)) AS mae, avg(sidewalk_frac) AS mean_a, avg(vegetation_frac) AS mean_b FROM ({_ranked('SELECT * FROM fx_mask_stats', 'city', 'sidewalk_frac', 'vegetation_frac')}) GROUP BY city",
)
def source_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.compare_sources(load(spark, sf_dir, "fx_mask_stats"), ["city"], "sidewalk_frac", "vegetation_frac")


@query(
    "overall_verdict",
    "backbone n_better:i n_not:i n_open:i overall",
    f"""WITH d AS (SELECT backbone, train_city, test_city, max(CASE WHEN ablation = 'full' THEN auroc END) - max(CASE WHEN ablation = 'vision_only' THEN auroc END) AS d, min(n) AS n FROM ({_LATEST}) WHERE train_city <> test_city GROUP BY ALL),
    v AS (SELECT backbone, CASE WHEN d IS NULL OR n < {LEAST} THEN 'inconclusive' WHEN d > {EPS}e0 THEN 'better' WHEN d < -{EPS}e0 THEN 'worse' ELSE 'equivalent' END AS v FROM d),
    c AS (SELECT backbone, count(*) FILTER (v = 'better') AS n_better, count(*) FILTER (v IN ('worse', 'equivalent')) AS n_not, count(*) FILTER (v = 'inconclusive') AS n_open FROM v GROUP BY backbone)
    SELECT *, CASE WHEN n_better > 0 THEN 'mixed' WHEN n_open = 0 AND n_not > 0 THEN 'not_better' WHEN n_not > 0 THEN 'not_better_with_inconclusive' ELSE 'inconclusive' END AS overall FROM c""",
)
def overall_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All features against vision only, direction by direction, then one verdict a backbone."""
    rows = runlog.latest(load(spark, sf_dir, "fx_run_log")).filter("train_city <> test_city")
    of = lambda a: F.max(F.when(F.col("ablation") == a, F.col("auroc")))
    each = rows.groupBy("backbone", "train_city", "test_city").agg((of("full") - of("vision_only")).alias("d"), F.min("n").alias("n"))
    said = F.when(F.col("d").isNull() | (F.col("n") < LEAST), "inconclusive").when(F.col("d") > EPS, "better").when(F.col("d") < -EPS, "worse").otherwise("equivalent")
    return reports.overall_verdict(each.withColumn("verdict", said), ["backbone"], "verdict")


_FOLD = "CASE WHEN (run_index + k) % 11 <> 0 THEN auroc + ((run_index * (k + 3)) % 7 - 3) / 1e2 END"


@query(
    "spatial_cv_table",
    "city folds:i mean:f std:f random_split:f",
    f"""WITH r AS (SELECT test_city AS city, run_index, auroc, row_number() OVER (PARTITION BY test_city ORDER BY ts DESC, run_index DESC) AS place FROM fx_run_log WHERE train_city = test_city)
    SELECT city, count(a) AS folds, avg(a) AS mean, stddev_pop(a) AS std, max(auroc) + 2e-2 AS random_split FROM (SELECT *, {_FOLD} AS a FROM r CROSS JOIN range(0, 5) q(k) WHERE place = 1) GROUP BY city""",
)
def spatial_cv_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest record inside each city: its folds' areas, and the random split's."""
    rows = load(spark, sf_dir, "fx_run_log").filter("train_city = test_city").withColumnRenamed("test_city", "city")
    fold = lambda k: F.struct(F.lit(k).alias("fold"), F.create_map(F.lit("overture_sidewalk_present"), F.struct(F.expr(_FOLD.replace("+ k)", f"+ {k})").replace("(k + 3)", f"({k} + 3)")).alias("auroc"))).alias("metrics"))
    records = rows.select("city", "ts", "run_index", F.array(*map(fold, range(5))).alias("per_fold_results"), (F.col("auroc") + 0.02).alias("random_split_auroc"))
    return reports.nested_folds(records, ["city"], ["ts", "run_index"], "overture_sidewalk_present")


@query(
    "graph_id_fallback",
    "city n_points:i n_in_graph:i fallback_pct:f rebuild:i",
    """SELECT *, CASE WHEN fallback_pct >= 1 THEN 1 ELSE 0 END AS rebuild FROM (SELECT city, count(*) AS n_points, count(node) AS n_in_graph, 100e0 * (count(*) - count(node)) / count(*) AS fallback_pct
    FROM fx_points LEFT JOIN (SELECT u AS node FROM fx_edges WHERE length >= 60 UNION SELECT v FROM fx_edges WHERE length >= 60) ON node = osmid GROUP BY city)""",
)
def graph_id_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points that the graph of the longer edges lacks."""
    edges = load(spark, sf_dir, "fx_edges").filter("length >= 60")
    nodes = edges.select(F.explode(F.array("u", "v")).alias("osmid")).distinct()
    return reports.fallback_rate(load(spark, sf_dir, "fx_points"), nodes, ["city"], "osmid")


@query(
    "top_classes",
    "city class n:i place:i",
    "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY city ORDER BY n DESC, class) AS place FROM (SELECT city, class, count(*) AS n FROM fx_segments WHERE class IS NOT NULL GROUP BY city, class)) WHERE place <= 3",
)
def top_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three most frequent segment classes of each city."""
    return reports.top_values(load(spark, sf_dir, "fx_segments"), ["city"], "class", 3)


@query(
    "in_city_split",
    "city osmid:i is_train:i",
    "SELECT city, osmid, CASE WHEN row_number() OVER (PARTITION BY city ORDER BY (osmid * 7919 + 42 * 104729) % 1000003, osmid) <= round_even(count(*) OVER (PARTITION BY city) * 7e-1, 0) THEN 1 ELSE 0 END AS is_train FROM fx_points",
)
def in_city_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """70 % of each city's points, in the order of seed 42, train."""
    order = (F.col("osmid") * 7919 + 42 * 104729) % 1000003
    return reports.split_share(load(spark, sf_dir, "fx_points").select("city", "osmid"), ["city"], order, "osmid", 0.7, 1000)


@query(
    "source_availability",
    "c_nationkey:i n:i kinds:i enough:i low:f high:f",
    "SELECT c_nationkey, n, kinds, CASE WHEN n >= 50 THEN 1 ELSE 0 END AS enough, CASE WHEN n >= 50 THEN low END AS low, CASE WHEN n >= 50 THEN high END AS high FROM (SELECT c_nationkey, count(*) AS n, count(DISTINCT c_mktsegment) AS kinds, min(c_acctbal) AS low, max(c_acctbal) AS high FROM customer GROUP BY c_nationkey)",
)
def source_availability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.availability(load(spark, sf_dir, "customer"), ["c_nationkey"], "c_acctbal", "c_mktsegment", 50)
