"""Queries on sampling frames, stored indices, target sets, and report tables of transfer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import composite, metrics, runlog, sampling, tables, targets
from ..sources import reports
from ..sources.shared import new_path
from .evaluation import _BY, _P, _POINT_CI, RUN, _auc_sql, bootstrap_ci_1000
from .fixtures import load
from .registry import query
from .runs import _LATEST

KEY = ["city", "point_id"]
#: Points of a city's frame, and how many covered ones are drawn before strata are looked at.
TARGET, TIMES = 30, 1.4
SPAN = 100_003
_H = f"(point_id * 7919 + 104729) % {SPAN}"


@query(
    "covered_frame",
    "city new_id:i point_id:i cell_x:i cell_y:i round_:i",
    f"""WITH ok AS (SELECT city, point_id FROM fx_mask_stats WHERE mask_coverage > 0 GROUP BY city, point_id HAVING count(DISTINCT heading) = 4),
    c AS (SELECT p.city, p.point_id, lat, lon, floor((lon + 180) * 50) AS cell_x, floor(lat * 50) AS cell_y, {_H.replace("point_id", "p.point_id")} AS h FROM fx_points p JOIN ok ON ok.city = p.city AND ok.point_id = p.point_id WHERE street_count >= 3),
    d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY city ORDER BY h, point_id) AS k FROM c) WHERE k <= {int(TARGET * TIMES)}),
    r AS (SELECT *, row_number() OVER (PARTITION BY city, cell_x, cell_y ORDER BY h, point_id) AS round_ FROM d),
    s AS (SELECT *, row_number() OVER (PARTITION BY city ORDER BY round_, cell_x, cell_y) AS pick FROM r)
    SELECT city, row_number() OVER (PARTITION BY city ORDER BY cell_y, cell_x, lat, lon, point_id) - 1 AS new_id, point_id, cell_x, cell_y, round_ FROM s WHERE pick <= {TARGET}""",
)
def covered_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intersections with images of all four headings, in seeded order until 1.4 times the target, then round by round over cells."""
    covered = load(spark, sf_dir, "fx_mask_stats").filter("mask_coverage > 0").groupBy(*KEY).agg(F.count_distinct("heading").alias("_n")).filter("_n = 4")
    c = load(spark, sf_dir, "fx_points").filter("street_count >= 3").join(covered.select(*KEY), KEY, "left_semi")
    c = c.select(*KEY, "lat", "lon", F.floor((F.col("lon") + 180) * 50).alias("cell_x"), F.floor(F.col("lat") * 50).alias("cell_y"), F.expr(_H).alias("h"))
    drawn = sampling.first_in_order(c, "city", "h", ["point_id"], int(TARGET * TIMES), SPAN)
    picked = sampling.round_robin(drawn, "city", ["cell_x", "cell_y"], ["h", "point_id"], TARGET)
    # A frame has TARGET rows a city.
    number = F.row_number().over(Window.partitionBy("city").orderBy("cell_y", "cell_x", "lat", "lon", "point_id")) - 1
    return picked.select("city", number.alias("new_id"), "point_id", "cell_x", "cell_y", "round_")


#: Components of both indices, and how they enter.
V1 = {"walk": "raw", "cross": "raw", "streets": "log1p", "trees": "raw", "natwalk": "raw", "transit": "raw", "cover": "raw", "width": "log1p"}
V2 = ["walk", "cross", "streets", "trees", "width"]


def _component_rows(spark, sf_dir):
    m = load(spark, sf_dir, "fx_mask_stats").groupBy(*KEY).agg(F.avg("sidewalk_frac").alias("walk"), F.max("crosswalk_frac").alias("cross"), F.avg("vegetation_frac").alias("trees"), F.avg("mask_coverage").alias("cover"), F.avg("sidewalk_width_px").alias("width"))
    p = load(spark, sf_dir, "fx_points").select(*KEY, F.col("street_count").alias("streets"), ((F.col("osmid") * 13) % 97 / 97).alias("natwalk"), F.when(F.col("osmid") % 19 != 0, (F.col("osmid") * 31) % 89 / 10).alias("transit"))
    return p.join(m, KEY)


def _stored_index(spark, sf_dir):
    """The first index: fitted on three cities, stored as a version, read back and applied to all."""
    rows, path = _component_rows(spark, sf_dir), new_path(spark, "indices")
    composite.store(composite.fit(rows, V1, "walk", "v1", F.col("city") != "pittsburgh"), path)
    return composite.apply(rows, composite.stored(spark, path, "v1"), "index_v1")


@query("index_stored")
def index_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distribution of the stored index by city."""
    q = F.percentile("index_v1", F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95)))
    return _stored_index(spark, sf_dir).groupBy("city").agg(F.count(F.lit(1)).alias("n"), F.avg("index_v1").alias("mean"), F.stddev_pop("index_v1").alias("std"), *(q[i].alias(n) for i, n in enumerate(("p05", "p50", "p95"))))


@query("index_rebuilt")
def index_rebuilt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second index, on five of the components that were stored with the first, and how the two agree."""
    path = new_path(spark, "index-rows")
    _stored_index(spark, sf_dir).select(*KEY, "index_v1", "components_json").write.parquet(path)
    both = composite.rebuild(spark.read.parquet(path), V2, "walk", "index_v2").withColumn("all", F.lit("all"))
    r = metrics.pearson(both, ["all"], "index_v2", "index_v1").join(metrics.spearman(both, ["all"], "index_v2", "index_v1"), "all")
    sizes = both.groupBy("all").agg(F.count(F.lit(1)).alias("n"), F.avg("index_v2").alias("mean"), F.stddev_pop("index_v2").alias("std"))
    return sizes.join(r, "all").drop("all")


_WIDE_LABELS = """SELECT p.city, p.point_id, CASE WHEN max(sidewalk_frac) > 1e-1 THEN 1 ELSE 0 END AS overture_sidewalk_present, CASE WHEN max(crosswalk_frac) > 4e-2 THEN 1 ELSE 0 END AS overture_crosswalk_present,
  CAST(max(street_count) AS DOUBLE) AS overture_intersection_count_200m, avg(vegetation_frac) AS overture_building_footprint_frac_100m, CAST(max(osmid) % 12 AS DOUBLE) AS stops_400m, CASE WHEN max(osmid) % 19 <> 0 THEN (max(osmid) * 13) % 97 / 1e0 END AS D3B
  FROM fx_points p JOIN fx_mask_stats m ON m.city = p.city AND m.point_id = p.point_id GROUP BY p.city, p.point_id"""
_NAMES = ("overture_sidewalk_present", "overture_crosswalk_present", "overture_intersection_count_200m", "overture_building_footprint_frac_100m", "D3B", "stops_400m")
_REGISTRY = ", ".join(f"('{t}', {tier}, '{kind}', {round(w * 10)}e-1)" for t, tier, kind, w in targets.REGISTRY)
_LONG = f"SELECT * FROM (SELECT city, point_id, unnest([{', '.join(repr(n) for n in _NAMES)}]) AS target, unnest([{', '.join(f'CAST({n} AS DOUBLE)' for n in _NAMES)}]) AS value FROM ({_WIDE_LABELS})) WHERE value IS NOT NULL"
_TRAIN = f"SELECT * FROM ({_LONG}) WHERE city IN ('msp', 'seattle', 'dc') AND point_id % 10 <> 3"
_SCALERS = f"SELECT r.target, r.tier, r.kind, r.weight, CASE WHEN kind = 'regression' AND m IS NOT NULL THEN m ELSE 0 END AS mean, CASE WHEN kind = 'regression' AND m IS NOT NULL THEN greatest(s, 1e-6) ELSE 1 END AS scale, coalesce(n, 0) AS n FROM (VALUES {_REGISTRY}) r(target, tier, kind, weight) LEFT JOIN (SELECT target, avg(value) AS m, stddev_pop(value) AS s, count(*) AS n FROM ({_TRAIN}) GROUP BY target) t ON t.target = r.target"


def _labels(spark, sf_dir):
    m = load(spark, sf_dir, "fx_mask_stats").groupBy(*KEY).agg(F.max("sidewalk_frac").alias("_s"), F.max("crosswalk_frac").alias("_c"), F.avg("vegetation_frac").alias("overture_building_footprint_frac_100m"))
    p = load(spark, sf_dir, "fx_points").join(m, KEY)
    return p.select(*KEY, (F.col("_s") > 0.1).cast("int").alias("overture_sidewalk_present"), (F.col("_c") > 0.04).cast("int").alias("overture_crosswalk_present"), F.col("street_count").alias("overture_intersection_count_200m"), "overture_building_footprint_frac_100m", (F.col("osmid") % 12).alias("stops_400m"), F.when(F.col("osmid") % 19 != 0, (F.col("osmid") * 13) % 97).alias("D3B"))


def _sets(spark, sf_dir):
    """The registry, all labels, and the training set of three cities under their locks."""
    known = targets.registry(spark)
    labels = targets.long_labels(_labels(spark, sf_dir), KEY, known)
    lock = load(spark, sf_dir, "fx_points").filter("point_id % 10 <> 3").select(*KEY)
    return known, labels, targets.training_set(labels, lock, ["msp", "seattle", "dc"], KEY)


@query("target_scalers", "target tier:i kind weight:f mean:f scale:f n:i", _SCALERS)
def target_scalers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every registered target with its scaler on the training set."""
    known, _, train = _sets(spark, sf_dir)
    return known.join(targets.scalers(train, known), "target")


@query(
    "auxiliary_correlations",
    "target n:i r:f mae:f",
    f"""WITH s AS ({_SCALERS}), t AS (SELECT l.*, s.mean, s.scale, (value - mean) / scale + sin(point_id) / 2 AS guess FROM ({_LONG}) l JOIN s ON s.target = l.target WHERE city = 'pittsburgh' AND kind = 'regression')
    SELECT target, count(*) AS n, CASE WHEN count(*) >= 3 AND stddev_pop(value) > 1e-8 THEN corr(guess * scale + mean, value) END AS r, avg(abs(guess * scale + mean - value)) AS mae FROM t GROUP BY target""",
)
def auxiliary_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions on the training set's scale, put back on each target's own, against the values of a city left out."""
    known, labels, train = _sets(spark, sf_dir)
    of = targets.scalers(train, known)
    test = targets.scale(labels.filter("city = 'pittsburgh' AND kind = 'regression'"), of)
    guessed = test.withColumn("guess", F.col("scaled") + F.sin(F.col("point_id").cast("double")) / 2)
    back = targets.unscale(guessed, of, "guess", "pred")
    errors = back.groupBy("target").agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs(F.col("pred") - F.col("value"))).alias("mae"))
    return errors.join(metrics.pearson(back, ["target"], "pred", "value"), "target")


_SUMMARY = f"SELECT backbone, test_city, count(*) AS n_runs, avg(auroc) AS mean FROM ({_LATEST}) GROUP BY backbone, test_city"


@query("published_report", "format version:i backbone test_city n_runs:i mean:f", " UNION ALL ".join(f"SELECT '{f}' AS format, 2 AS version, * FROM ({_SUMMARY})" for f in reports.FORMATS))
def published_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A summary published twice in each format, of which readers get the second, whole."""
    rows = runlog.latest(load(spark, sf_dir, "fx_run_log")).groupBy("backbone", "test_city").agg(F.count(F.lit(1)).alias("n_runs"), F.avg("auroc").alias("mean"))
    out = None
    for kind in reports.FORMATS:
        path = new_path(spark, f"report-{kind}")
        reports.publish(rows.filter("test_city = 'dc'"), path, kind)
        version = reports.publish(rows, path, kind)
        one = reports.read_report(spark, path).select(F.lit(kind).alias("format"), F.lit(version).alias("version"), "*")
        out = one if out is None else out.unionByName(one)
    return out


@query("zero_shot_table", "backbone auroc:f n:i run_index:i ts", "SELECT backbone, auroc, n, run_index, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts FROM (SELECT *, row_number() OVER (PARTITION BY backbone ORDER BY ts DESC, run_index DESC) AS r FROM fx_run_log WHERE ablation = 'full' AND test_city = 'dc' AND train_city <> 'dc') WHERE r = 1")
def zero_shot_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest run of every backbone on a city that it has not been trained on, with its provenance."""
    runs = load(spark, sf_dir, "fx_run_log").filter("ablation = 'full' AND test_city = 'dc' AND train_city <> 'dc'")
    return runlog.latest(runs, ["backbone"]).select("backbone", "auroc", "n", "run_index", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"))


@query(
    "transfer_summary",
    "backbone n_directions:i mean:f std:f lo:f hi:f zero_shot:f zero_shot_lo:f zero_shot_hi:f cell",
    f"""WITH a AS (SELECT backbone, city, avg(auroc) AS auroc FROM ({_auc_sql(_P, _BY)}) GROUP BY backbone, city), i AS (SELECT backbone, city, avg(lo) AS lo, avg(hi) AS hi FROM ({_POINT_CI}) GROUP BY backbone, city),
    t AS (SELECT a.backbone, a.city, auroc, coalesce(lo, auroc) AS lo, coalesce(hi, auroc) AS hi FROM a JOIN i ON i.backbone = a.backbone AND i.city = a.city),
    s AS (SELECT backbone, count(CASE WHEN city <> 'pittsburgh' THEN auroc END) AS n_directions, avg(CASE WHEN city <> 'pittsburgh' THEN auroc END) AS mean, stddev_pop(CASE WHEN city <> 'pittsburgh' THEN auroc END) AS std,
      avg(CASE WHEN city <> 'pittsburgh' THEN lo END) AS lo, avg(CASE WHEN city <> 'pittsburgh' THEN hi END) AS hi, max(CASE WHEN city = 'pittsburgh' THEN auroc END) AS zero_shot, max(CASE WHEN city = 'pittsburgh' THEN lo END) AS zero_shot_lo, max(CASE WHEN city = 'pittsburgh' THEN hi END) AS zero_shot_hi FROM t GROUP BY backbone)
    SELECT *, printf('%.3f', zero_shot) || ' [' || printf('%.3f', zero_shot_lo) || ', ' || printf('%.3f', zero_shot_hi) || ']' AS cell FROM s""",
)
def transfer_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeds, then directions: mean and deviation over cities, the mean of their intervals, and the cell of the city never trained on."""
    rows = metrics.finite(load(spark, sf_dir, "fx_predictions"), "y_bin")
    cells = metrics.auroc(rows, RUN, "y_bin", "score").groupBy("backbone", "city").agg(F.avg("auroc").alias("auroc"))
    intervals = bootstrap_ci_1000(spark, sf_dir).groupBy("backbone", "city").agg(F.avg("lo").alias("lo"), F.avg("hi").alias("hi"))
    t = cells.join(intervals, ["backbone", "city"]).withColumns({c: F.coalesce(c, "auroc") for c in ("lo", "hi")})
    away, here = (lambda c: F.when(F.col("city") != "pittsburgh", F.col(c))), (lambda c: F.max(F.when(F.col("city") == "pittsburgh", F.col(c))))
    out = t.groupBy("backbone").agg(
        F.count(away("auroc")).alias("n_directions"), F.avg(away("auroc")).alias("mean"), F.stddev_pop(away("auroc")).alias("std"), F.avg(away("lo")).alias("lo"), F.avg(away("hi")).alias("hi"),
        here("auroc").alias("zero_shot"), here("lo").alias("zero_shot_lo"), here("hi").alias("zero_shot_hi"),
    )
    return out.withColumn("cell", F.format_string("%.3f [%.3f, %.3f]", "zero_shot", "zero_shot_lo", "zero_shot_hi"))


@query("column_purge", "city point_id kept columns", "SELECT city, point_id, street_count AS kept, 'point_id,city,street_count' AS columns FROM fx_points")
def column_purge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A wide table without the columns of a list and those of two prefixes."""
    wide = load(spark, sf_dir, "fx_points").withColumns({"cap_sidewalk": F.lit(1), "cap_trees": F.lit(2), "sam2_frac": F.lit(0.1), "Agreement": F.lit(0)})
    left = tables.purge(wide, ["lat", "lon", "osmid", "agreement", "absent"], ["cap_", "sam2_"])
    return left.select("city", "point_id", F.col("street_count").cast("long").alias("kept"), F.lit(",".join(left.columns)).alias("columns"))
