"""Queries on the run log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import runlog
from .fixtures import load
from .registry import query

CELL = runlog.CELL
_LATEST = "SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY backbone, train_city, test_city, ablation ORDER BY ts DESC, run_index DESC) AS r FROM fx_run_log) WHERE r = 1"
_HELD = "SELECT * REPLACE (CASE WHEN backbone LIKE 'siglip_lora_loco_%' THEN 'siglip_lora_loco' ELSE backbone END AS backbone) FROM fx_run_log WHERE backbone NOT LIKE 'siglip_lora_loco_%' OR backbone = 'siglip_lora_loco_' || test_city"


def _log(spark, sf_dir):
    return load(spark, sf_dir, "fx_run_log")


@query("log_latest", "backbone train_city test_city ablation run_index n:i auroc:f", f"SELECT * FROM ({_LATEST})")
def log_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runlog.latest(_log(spark, sf_dir)).drop("ts")


@query("log_filter", "backbone n_runs:i mean:f", f"SELECT backbone, count(*) AS n_runs, avg(auroc) AS mean FROM ({_HELD}) WHERE n >= 100 AND ablation = 'full' AND train_city <> test_city GROUP BY backbone")
def log_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid runs between cities with all features; metrics are read from a map by target."""
    rows = runlog.held_out_of(_log(spark, sf_dir)).withColumn("results", F.create_map(F.lit("sidewalk"), F.struct("auroc", "n")))
    kept = rows.filter(F.map_contains_key("results", "sidewalk") & F.forall(F.map_values("results"), lambda r: r["n"] >= 100) & (F.col("ablation") == "full") & (F.col("train_city") != F.col("test_city")))
    long = kept.select("backbone", F.explode("results").alias("target", "m"))
    return long.groupBy("backbone").agg(F.count(F.lit(1)).alias("n_runs"), F.avg("m.auroc").alias("mean"))


@query("log_matrix", "backbone train_city msp:f seattle:f dc:f", f"SELECT backbone, train_city, max(CASE WHEN test_city = 'msp' THEN auroc END) AS msp, max(CASE WHEN test_city = 'seattle' THEN auroc END) AS seattle, max(CASE WHEN test_city = 'dc' THEN auroc END) AS dc FROM ({_LATEST}) WHERE ablation = 'full' GROUP BY backbone, train_city")
def log_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = runlog.latest(_log(spark, sf_dir)).filter("ablation = 'full'")
    return runlog.matrix(rows, ["backbone", "train_city"], "test_city", ["msp", "seattle", "dc"], "auroc")


@query("log_ablation", "test_city ablation mean:f is_best:i", f"SELECT *, CASE WHEN mean = max(mean) OVER (PARTITION BY test_city) THEN 1 ELSE 0 END AS is_best FROM (SELECT test_city, ablation, avg(auroc) AS mean FROM ({_LATEST}) WHERE backbone = 'siglip' GROUP BY test_city, ablation)")
def log_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = runlog.latest(_log(spark, sf_dir)).filter("backbone = 'siglip'").groupBy("test_city", "ablation").agg(F.avg("auroc").alias("mean"))
    return rows.withColumn("is_best", runlog.best_in_column("mean", ["test_city"]))


@query("log_fallback", "backbone train_city test_city used auroc:f", f"SELECT backbone, train_city, test_city, ablation AS used, auroc FROM (SELECT *, row_number() OVER (PARTITION BY backbone, train_city, test_city ORDER BY CASE ablation WHEN 'full' THEN 1 ELSE 2 END) AS r FROM ({_LATEST}) WHERE NOT (ablation = 'full' AND n < 150)) WHERE r = 1")
def log_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full features where such a run is large enough, else vision only."""
    rows = runlog.latest(_log(spark, sf_dir)).filter("NOT (ablation = 'full' AND n < 150)")
    best = runlog.first_choice(rows, ["backbone", "train_city", "test_city"], "ablation", ["full", "vision_only"])
    return best.select("backbone", "train_city", "test_city", F.col("ablation").alias("used"), "auroc")


_GRID = "SELECT b.backbone, s.c AS train_city, d.c AS test_city, r.seed FROM (SELECT DISTINCT backbone FROM fx_run_log) b, (SELECT DISTINCT test_city AS c FROM fx_run_log) s, (SELECT DISTINCT test_city AS c FROM fx_run_log) d, (VALUES (41), (42), (43)) r(seed) WHERE s.c <> d.c"


def _design(spark, sf_dir):
    """The design that the log's own backbones and cities make: a few names each."""
    log = _log(spark, sf_dir)
    names = lambda c: sorted(r[0] for r in log.select(c).distinct().collect())
    return runlog.grid(spark, names("backbone"), names("test_city"), [41, 42, 43])


@query("run_grid", "backbone train_city test_city seed:i", _GRID)
def run_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _design(spark, sf_dir)


@query("log_missing", "backbone train_city test_city seed:i", f"SELECT * FROM ({_GRID}) g WHERE NOT EXISTS (SELECT 1 FROM fx_run_log l WHERE l.backbone = g.backbone AND l.train_city = g.train_city AND l.test_city = g.test_city AND l.n % 3 + 41 = g.seed AND auroc > 8e-1)")
def log_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of the design that the log does not have (with an area over 0.8)."""
    done = _log(spark, sf_dir).filter("auroc > 0.8").select("backbone", "train_city", "test_city", (F.col("n") % 3 + 41).alias("seed"))
    return _design(spark, sf_dir).join(done, ["backbone", "train_city", "test_city", "seed"], "left_anti")


@query("log_provenance", "backbone test_city auroc:f run_index ts", f"SELECT backbone, test_city, auroc, run_index, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts FROM (SELECT *, row_number() OVER (PARTITION BY backbone, test_city ORDER BY auroc DESC, run_index) AS r FROM ({_LATEST})) WHERE r = 1")
def log_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which run fed each best cell."""
    best = runlog.latest(_log(spark, sf_dir)).groupBy("backbone", "test_city").agg(F.max_by(F.struct("auroc", "run_index", "ts"), F.struct("auroc", (-F.col("run_index")).alias("i"))).alias("b"))
    return best.select("backbone", "test_city", "b.auroc", "b.run_index", F.date_format("b.ts", "yyyy-MM-dd HH:mm:ss").alias("ts"))


@query("resume_set", "city point_id", "SELECT p.city, p.point_id FROM fx_points p WHERE NOT EXISTS (SELECT 1 FROM fx_captions c WHERE c.city = p.city AND c.point_id = p.point_id AND c.answer NOT LIKE '%sidewalk=unknown%')")
def resume_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points that have no good caption yet."""
    done = load(spark, sf_dir, "fx_captions").filter(~F.col("answer").contains("sidewalk=unknown"))
    return load(spark, sf_dir, "fx_points").join(done, ["city", "point_id"], "left_anti").select("city", "point_id")
