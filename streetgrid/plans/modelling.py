"""Queries on features, vectors, models, formats and streams."""

from __future__ import annotations

import struct
import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ..functions import geo
from ..operators import features, metrics, models, tables
from ..sources import files
from ..sources.shared import new_path
from ..streaming import jobs
from .fixtures import load
from .registry import query

KEY = ["city", "point_id"]


_COMP = "SELECT city, point_id, avg(sidewalk_frac) AS walk, ln(1 + greatest(avg(sidewalk_width_px), 0)) AS width, avg(vegetation_frac) AS trees FROM fx_mask_stats GROUP BY city, point_id"
COMPONENTS = ["walk", "width", "trees"]


def _components(spark, sf_dir):
    rows = load(spark, sf_dir, "fx_mask_stats").groupBy(*KEY).agg(F.avg("sidewalk_frac").alias("walk"), features.log_clipped(F.avg("sidewalk_width_px")).alias("width"), F.avg("vegetation_frac").alias("trees"))
    return rows


@query("composite_index", "city n:i walk__width:f walk__trees:f width__trees:f mean_walk:f std_walk:f", f"SELECT city, count(*) AS n, corr(walk, width) AS walk__width, corr(walk, trees) AS walk__trees, corr(width, trees) AS width__trees, avg(walk) AS mean_walk, stddev_pop(walk) AS std_walk FROM ({_COMP}) GROUP BY city")
def composite_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index's ingredients: scaling and correlations of its components by city."""
    return _components(spark, sf_dir).groupBy("city").agg(F.count(F.lit(1)).alias("n"), *features.correlation_matrix(None, COMPONENTS), F.avg("walk").alias("mean_walk"), F.stddev_pop("walk").alias("std_walk"))


@query("composite_index_apply")
def composite_index_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First component fitted on three cities and applied to all: n, mean and quantiles of the index by city."""
    rows = _components(spark, sf_dir)
    mean, deviation, loading, _ = features.first_component(rows.filter("city <> 'pittsburgh'"), COMPONENTS, "walk")
    scored = rows.withColumn("index", features.index_of(COMPONENTS, mean, deviation, loading))
    q = F.percentile("index", F.array(F.lit(0.05), F.lit(0.95)))
    return scored.groupBy("city").agg(F.count(F.lit(1)).alias("n"), F.avg("index").alias("mean"), F.stddev_pop("index").alias("std"), q[0].alias("p05"), q[1].alias("p95"))


_GAPS = "SELECT city, point_id, heading, CASE WHEN (point_id + heading) % 11 = 0 THEN NULL ELSE vegetation_frac END AS v, CASE WHEN city = 'dc' THEN NULL ELSE sidewalk_width_px END AS w FROM fx_mask_stats"


def _gaps(spark, sf_dir):
    m = load(spark, sf_dir, "fx_mask_stats")
    return m.select(*KEY, "heading", F.when((F.col("point_id") + F.col("heading")) % 11 != 0, F.col("vegetation_frac")).alias("v"), F.when(F.col("city") != "dc", F.col("sidewalk_width_px")).alias("w"))


@query("median_impute_scale", "city point_id heading:i v:f w:f", f"WITH g AS ({_GAPS}), m AS (SELECT city, quantile_cont(v, 5e-1) AS mv, quantile_cont(w, 5e-1) AS mw FROM g GROUP BY city), i AS (SELECT g.city, point_id, heading, coalesce(v, mv, 0) AS v, coalesce(w, mw, 0) AS w FROM g JOIN m ON m.city = g.city), s AS (SELECT avg(v) AS av, stddev_pop(v) AS sv, avg(w) AS aw, stddev_pop(w) AS sw FROM i WHERE city <> 'pittsburgh') SELECT city, point_id, heading, (v - av) / sv AS v, (w - aw) / sw AS w FROM i, s")
def median_impute_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    filled = features.impute(_gaps(spark, sf_dir), ["v", "w"], ["city"])
    return features.scale(filled, ["v", "w"], filled.filter("city <> 'pittsburgh'")).select(*KEY, "heading", "v", "w")


@query("masked_scaler", "city mean_v:f std_v:f n_known:i const:f", f"SELECT city, avg((v - av) / sv) AS mean_v, stddev_pop((v - av) / sv) AS std_v, count(v) AS n_known, avg(0e0) AS const FROM ({_GAPS}), (SELECT avg(v) AS av, stddev_pop(v) AS sv FROM ({_GAPS})) GROUP BY city")
def masked_scaler(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nulls stay null and out of the statistics; a constant column is only centred."""
    rows = _gaps(spark, sf_dir).withColumn("c", F.lit(3.0))
    return features.scale(rows, ["v", "c"], rows).groupBy("city").agg(F.avg("v").alias("mean_v"), F.stddev_pop("v").alias("std_v"), F.count("v").alias("n_known"), F.avg("c").alias("const"))


_E = "(SELECT *, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings)"


@query("vector_l2", "vec_id first_:f norm:f", f"SELECT vec_id, e[1] / n AS first_, sqrt(list_sum(list_transform(e, lambda x: x / n * x / n))) AS norm FROM (SELECT vec_id, e, greatest(sqrt(list_sum(list_transform(e, lambda x: x * x))), 1e-8) AS n FROM {_E})")
def vector_l2(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = load(spark, sf_dir, "embeddings").withColumn("e", features.l2_normal(F.col("embedding")))
    return v.select("vec_id", F.col("e")[0].alias("first_"), F.sqrt(F.aggregate("e", F.lit(0.0), lambda a, x: a + x * x)).alias("norm"))


@query("vector_meanpool", "city:i source dim:i x1:f x64:f n:i", f"SELECT vec_id % 4 AS city, CASE WHEN vec_id % 2 = 0 THEN 'street' ELSE 'naip' END AS source, 64 AS dim, avg(e[1]) AS x1, avg(e[64]) AS x64, count(*) AS n FROM {_E} GROUP BY 1, 2")
def vector_meanpool(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = load(spark, sf_dir, "embeddings").select((F.col("vec_id") % 4).alias("city"), F.when(F.col("vec_id") % 2 == 0, "street").otherwise("naip").alias("source"), "embedding")
    pooled = features.mean_pool(v, ["city", "source"], "embedding").join(v.groupBy("city", "source").agg(F.count(F.lit(1)).alias("n")), ["city", "source"])
    return pooled.select("city", "source", F.size("pooled").alias("dim"), F.col("pooled")[0].alias("x1"), F.element_at("pooled", -1).alias("x64"), "n")


@query("vector_fill", "vec_id missing:i x1:f", f"WITH m AS (SELECT {', '.join(f'avg(e[{i}]) AS m{i}' for i in range(1, 65))} FROM {_E} WHERE vec_id % 13 <> 0), f AS (SELECT vec_id, CASE WHEN vec_id % 13 = 0 THEN 1 ELSE 0 END AS missing, CASE WHEN vec_id % 13 = 0 THEN [{', '.join(f'm{i}' for i in range(1, 65))}] ELSE e END AS e FROM {_E}, m) SELECT vec_id, missing, e[1] / greatest(sqrt(list_sum(list_transform(e, lambda x: x * x))), 1e-8) AS x1 FROM f")
def vector_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = load(spark, sf_dir, "embeddings").withColumn("e", F.when(F.col("vec_id") % 13 != 0, F.col("embedding").cast("array<double>")))
    mean = features.mean_pool(v.filter("e IS NOT NULL").withColumn("all", F.lit(1)), ["all"], "e").first()["pooled"]
    return features.fill_missing(v, "e", mean).select("vec_id", "missing", F.col("e")[0].alias("x1"))


@query(
    "class_filters",
    "city n_walk:i n_cross:i n_steps:i n_marked:i",
    "SELECT city, count(CASE WHEN lower(coalesce(class, '')) IN ('footway', 'sidewalk', 'pedestrian', 'path', 'steps') THEN 1 END) AS n_walk, count(CASE WHEN lower(class) = 'marked' OR seg_id % 17 = 0 THEN 1 END) AS n_cross, count(CASE WHEN class = 'steps' THEN 1 END) AS n_steps, count(CASE WHEN class = 'marked' OR class = 'residential' OR class IS NULL AND seg_id % 2 = 0 THEN 1 END) AS n_marked FROM fx_segments GROUP BY city",
)
def class_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class lists over columns that may be null, tags that are one value or a list, and marked crossings."""
    c = F.col("class")
    rows = load(spark, sf_dir, "fx_segments").withColumns({"subclass": F.when(F.col("seg_id") % 17 == 0, "crosswalk"), "tag": F.when(F.col("seg_id") % 2 == 0, F.concat(F.lit("['"), c, F.lit("', 'x']"))).otherwise(c)})
    tags = F.create_map(F.lit("crossing"), F.when(c == "marked", "zebra").otherwise("no"), F.lit("crossing_ref"), F.when(c == "residential", "zebra").otherwise(""), F.lit("crossing:markings"), F.when(c.isNull() & (F.col("seg_id") % 2 == 0), "yes").otherwise("no"))
    walk = F.lower(F.coalesce(c, F.lit(""))).isin("footway", "sidewalk", "pedestrian", "path", "steps")
    cross = (F.lower(F.coalesce(c, F.lit(""))) == "marked") | F.coalesce(F.col("subclass").isin("crosswalk", "cycle_crossing", "crossing"), F.lit(False))
    return rows.groupBy("city").agg(F.count_if(walk).alias("n_walk"), F.count_if(cross).alias("n_cross"), F.count_if(files.tag_holds(F.col("tag"), "steps")).alias("n_steps"), F.count_if(files.marked_crossing(tags)).alias("n_marked"))


@query("dimension_joins", "n_name n:i n_both:i n_prior:i mean:f", "SELECT n.n_name, count(*) AS n, count(CASE WHEN s.s_nationkey IS NOT NULL THEN 1 END) AS n_both, count(CASE WHEN c.c_custkey % 2 = 0 THEN 1 END) AS n_prior, avg(c_acctbal) AS mean FROM customer c JOIN nation n ON n.n_nationkey = c.c_nationkey LEFT JOIN (SELECT DISTINCT s_nationkey FROM supplier) s ON s.s_nationkey = c.c_nationkey GROUP BY n.n_name")
def dimension_joins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with their dimension, a build side without repeats, and an earlier value looked up."""
    c, n = load(spark, sf_dir, "customer"), load(spark, sf_dir, "nation")
    s = load(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("c_nationkey"), F.lit(1).alias("has")).dropDuplicates(["c_nationkey"])
    prior = c.filter("c_custkey % 2 = 0").select("c_custkey", F.col("c_acctbal").alias("prior"))
    rows = c.join(n, c["c_nationkey"] == n["n_nationkey"]).join(s, "c_nationkey", "left").join(prior, "c_custkey", "left")
    return rows.groupBy("n_name").agg(F.count(F.lit(1)).alias("n"), F.count("has").alias("n_both"), F.count("prior").alias("n_prior"), F.avg("c_acctbal").alias("mean"))


@query(
    "group_summaries",
    "city heading:i n:i mean:f pop:f samp:f least_:f most:f n_wide:i always_zero:i bg_r2:f",
    "SELECT city, heading, count(*) AS n, avg(vegetation_frac) AS mean, stddev_pop(vegetation_frac) AS pop, stddev_samp(vegetation_frac) AS samp, min(vegetation_frac) AS least_, max(vegetation_frac) AS most, count(CASE WHEN sidewalk_width_px > 150 THEN 1 END) AS n_wide, CASE WHEN max(abs(coalesce(CASE WHEN city = 'dc' THEN 0e0 ELSE sidewalk_width_px END, 0))) = 0 THEN 1 ELSE 0 END AS always_zero, 1 - avg(power(vegetation_frac - sidewalk_frac * 4, 2)) / var_pop(vegetation_frac) AS bg_r2 FROM fx_mask_stats GROUP BY city, heading",
)
def group_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = load(spark, sf_dir, "fx_mask_stats").withColumn("zero", F.when(F.col("city") == "dc", 0.0).otherwise(F.coalesce("sidewalk_width_px", F.lit(0.0))))
    v, by = F.col("vegetation_frac"), ["city", "heading"]
    stats = m.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("pop"), F.stddev_samp(v).alias("samp"), F.min(v).alias("least_"), F.max(v).alias("most"), F.count_if(F.col("sidewalk_width_px") > 150).alias("n_wide"), (F.max(F.abs("zero")) == 0).cast("int").alias("always_zero"))
    fit = metrics.regression_errors(m.withColumn("p", F.col("sidewalk_frac") * 4), by, "vegetation_frac", "p")
    return stats.join(fit.select(*by, F.col("r2").alias("bg_r2")), by)


@query("source_cascade", "city source n:i", "WITH s AS (SELECT city, 1 AS o, 'graph' AS source FROM fx_segments WHERE class = 'marked' AND city IN ('msp', 'dc') UNION ALL SELECT city, 2, 'features' FROM fx_segments WHERE class = 'steps' AND city <> 'pittsburgh'), b AS (SELECT city, min(o) AS o FROM s GROUP BY city) SELECT p.city, coalesce(max(s.source), 'none') AS source, count(s.source) AS n FROM (SELECT DISTINCT city FROM fx_points) p LEFT JOIN b ON b.city = p.city LEFT JOIN s ON s.city = b.city AND s.o = b.o GROUP BY p.city")
def source_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each city the first source that has anything."""
    s = load(spark, sf_dir, "fx_segments")
    both = s.filter("class = 'marked' AND city IN ('msp', 'dc')").select("city", F.lit(1).alias("o"), F.lit("graph").alias("source")).unionByName(s.filter("class = 'steps' AND city <> 'pittsburgh'").select("city", F.lit(2).alias("o"), F.lit("features").alias("source")))
    counts = both.groupBy("city", "o", "source").agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy("city").agg(F.min_by(F.struct("source", "n"), "o").alias("b"))
    return load(spark, sf_dir, "fx_points").select("city").distinct().join(best, "city", "left").select("city", F.coalesce("b.source", F.lit("none")).alias("source"), F.coalesce("b.n", F.lit(0)).alias("n"))


@query("scalar_misc", "city west:f north:f log_width:f sig:f tier_weight:f n_tiles:i", "SELECT p.city, min(lon) - 1e-2 AS west, max(lat) + 1e-2 AS north, avg(ln(1 + greatest(street_count - 2, 0))) AS log_width, avg(1 / (1 + exp(-(street_count - 3e0)))) AS sig, avg(CASE street_count % 4 WHEN 0 THEN 1e0 WHEN 1 THEN 5e-1 WHEN 2 THEN 25e-2 ELSE 5e-1 END) AS tier_weight, ceil((max(lat) - min(lat)) / 1e-2) * ceil((max(lon) - min(lon)) / 1e-2) AS n_tiles FROM fx_points p GROUP BY p.city")
def scalar_misc(spark: SparkSession, sf_dir: str) -> DataFrame:
    tier = F.element_at(F.array(F.lit("high"), F.lit("medium"), F.lit("low"), F.lit(None)), (F.col("street_count") % 4 + 1).cast("int"))
    weight = F.coalesce(F.create_map(*(F.lit(x) for x in ("high", 1.0, "medium", 0.5, "low", 0.25)))[tier], F.lit(0.5))
    p = load(spark, sf_dir, "fx_points").withColumn("w", weight)
    box = p.groupBy("city").agg(F.min("lon").alias("w0"), F.max("lon").alias("e0"), F.min("lat").alias("s0"), F.max("lat").alias("n0"), F.avg(features.log_clipped(F.col("street_count") - 2)).alias("log_width"), F.avg(features.sigmoid(F.col("street_count") - 3.0)).alias("sig"), F.avg("w").alias("tier_weight"))
    steps = lambda a, b: F.sequence(F.lit(0), F.ceil((F.col(b) - F.col(a)) / 0.01).cast("int") - 1)
    tiles = box.select("city", F.explode(steps("s0", "n0")).alias("i"), "w0", "e0").select("city", F.explode(steps("w0", "e0")).alias("j")).groupBy("city").agg(F.count(F.lit(1)).alias("n_tiles"))
    return box.join(tiles, "city").select("city", (F.col("w0") - 0.01).alias("west"), (F.col("n0") + 0.01).alias("north"), "log_width", "sig", "tier_weight", "n_tiles")


#: Columns by ablation.
GROUPS = {"full": ["sidewalk_frac", "crosswalk_frac", "vegetation_frac", "sidewalk_width_px"], "vision_only": ["sidewalk_frac", "crosswalk_frac", "vegetation_frac"], "width_only": ["sidewalk_width_px"]}


@query("ablation_groups", "ablation n:i n_features:i total:f", " UNION ALL ".join(f"SELECT '{k}' AS ablation, count(*) AS n, {len(c)} AS n_features, sum({' + '.join(c)}) AS total FROM fx_mask_stats" for k, c in GROUPS.items()))
def ablation_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = load(spark, sf_dir, "fx_mask_stats")
    total = lambda cs: F.aggregate(F.array(*(F.col(c).cast("double") for c in cs)), F.lit(0.0), lambda a, x: a + x)
    each = m.withColumn("g", F.explode(F.array(*(F.struct(F.lit(k).alias("ablation"), F.lit(len(c)).alias("n_features"), total(c).alias("t")) for k, c in GROUPS.items()))))
    return each.groupBy("g.ablation", "g.n_features").agg(F.count(F.lit(1)).alias("n"), F.sum("g.t").alias("total"))


@query("class_weights", "backbone pos_weight:f", "SELECT backbone, (1 - p) / greatest(p, 1e-6) AS pos_weight FROM (SELECT backbone, avg(CAST(y_bin AS DOUBLE)) AS p FROM fx_predictions GROUP BY backbone)")
def class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = load(spark, sf_dir, "fx_predictions").groupBy("backbone").agg(F.avg("y_bin").alias("p"))
    return p.select("backbone", ((1 - F.col("p")) / F.greatest("p", F.lit(1e-6))).alias("pos_weight"))


@query("masked_loss", "backbone bce:f mse:f loss:f", "SELECT backbone, avg(CASE WHEN y_bin = 1 THEN -ln(q) WHEN y_bin = 0 THEN -ln(1 - q) END) AS bce, avg(power((y_reg - 2e5) / 1e5 - score, 2)) AS mse, (avg(CASE WHEN y_bin = 1 THEN -ln(q) WHEN y_bin = 0 THEN -ln(1 - q) END) + 5e-1 * avg(power((y_reg - 2e5) / 1e5 - score, 2))) / 2 AS loss FROM (SELECT *, 1 / (1 + exp(-score)) AS q FROM fx_predictions) GROUP BY backbone")
def masked_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cross-entropy over known labels, squared error of the scaled value, and their weighted mean."""
    q = features.sigmoid(F.col("score"))
    rows = load(spark, sf_dir, "fx_predictions").withColumn("b", F.when(F.col("y_bin") == 1, -F.ln(q)).when(F.col("y_bin") == 0, -F.ln(1 - q)))
    out = rows.groupBy("backbone").agg(F.avg("b").alias("bce"), F.avg(F.pow((F.col("y_reg") - 2e5) / 1e5 - F.col("score"), 2)).alias("mse"))
    return out.withColumn("loss", (F.col("bce") + 0.5 * F.col("mse")) / 2)


@query("spatial_folds")
def spatial_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of every city in five folds that lie together, in metres around the city's middle."""
    p = load(spark, sf_dir, "fx_points")
    centre = p.groupBy("city").agg(F.avg("lat").alias("lat0"), F.avg("lon").alias("lon0"))
    x, y = geo.equirectangular_xy(F.col("lat"), F.col("lon"), F.col("lat0"), F.col("lon0"))
    return models.spatial_folds(p.join(centre, "city").select(*KEY, x.alias("x"), y.alias("y")), 5).select(*KEY, "fold")


def _vectors(spark, sf_dir):
    e = load(spark, sf_dir, "embeddings").withColumn("y", (F.col("label") >= 5).cast("int")).withColumn("target", F.col("label").cast("double"))
    e = models.vectors(e, "embedding")
    return e.filter("vec_id % 4 <> 3"), e.filter("vec_id % 4 = 3")


@query("pca_project")
def pca_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = _vectors(spark, sf_dir)
    out = models.pca_centred(train, train.unionByName(test), 8)
    return out.select("vec_id", *(F.abs(F.col("pca")[i]).alias(f"pc{i + 1}") for i in range(3)))


@query("linear_probe")
def linear_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area of the tuned probe on the city left out."""
    train, test = _vectors(spark, sf_dir)
    scored = models.logistic_probe(train, test, "y").withColumn("run", F.lit("probe"))
    return metrics.auroc(scored, ["run"], "y", "score")


@query("forest_baseline")
def forest_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trees on place alone, scored on the city left out."""
    p = load(spark, sf_dir, "fx_points").join(tables.heading_rollup(load(spark, sf_dir, "fx_mask_stats")), KEY)
    scored = models.tree_baselines(p.filter("city <> 'dc'"), p.filter("city = 'dc'"), "vegetation_mean", ["lat", "lon", "street_count"])
    long = scored.select("city", "vegetation_mean", F.explode(F.create_map(F.lit("forest"), "forest", F.lit("boosted"), "boosted")).alias("model", "pred"))
    return metrics.regression_errors(long, ["model"], "vegetation_mean", "pred")


_KNN_SQL = "SELECT a.city, a.point_id, sum(b.street_count / greatest(d, 1e-9)) / sum(1 / greatest(d, 1e-9)) AS predicted FROM (SELECT a.city, a.point_id, b.point_id AS nb, HAV AS d, row_number() OVER (PARTITION BY a.city, a.point_id ORDER BY HAV, b.point_id) AS r FROM fx_points a JOIN fx_points b ON a.city = b.city AND a.point_id <> b.point_id) a JOIN fx_points b ON b.city = a.city AND b.point_id = a.nb WHERE r <= 15 GROUP BY a.city, a.point_id"


def _knn_sql() -> str:
    from .registry import hav

    return _KNN_SQL.replace("HAV", hav("a", "b"))


@query("knn_baseline", "city point_id predicted:f", _knn_sql())
def knn_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of the 15 nearest others' values by inverse distance."""
    from ..operators.near import knn

    p = load(spark, sf_dir, "fx_points")
    values = p.select("city", F.col("point_id").alias("neighbour"), "street_count")
    w = 1.0 / F.greatest("dist", F.lit(1e-9))
    return knn(p, 15).join(values, ["city", "neighbour"]).groupBy(*KEY).agg((F.sum(w * F.col("street_count")) / F.sum(w)).alias("predicted"))


def _moments_of(df: DataFrame, column: str) -> DataFrame:
    each = df.select("vec_id", F.posexplode(column).alias("pos", "x"))
    return each.groupBy("pos").agg(F.avg("x").alias("mean"), F.var_samp("x").alias("variance"), F.count(F.lit(1)).alias("n"))


@query("coral")
def coral(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moments of one source's vectors after they are aligned to the other's."""
    e = load(spark, sf_dir, "embeddings")
    return _moments_of(models.coral(e.filter("vec_id % 2 = 0"), e.filter("vec_id % 2 = 1"), "embedding"), "aligned")


@query("subspace")
def subspace(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = load(spark, sf_dir, "embeddings")
    sides = models.subspace(e.filter("vec_id % 2 = 0"), e.filter("vec_id % 2 = 1"), "embedding", 8)
    source, target = (_moments_of(side, "aligned").withColumn("side", F.lit(name)) for name, side in zip(("source", "target"), sides, strict=True))
    return source.unionByName(target)


@query("isotonic")
def isotonic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calibrated probabilities by score: they never fall."""
    rows = load(spark, sf_dir, "fx_predictions").filter("backbone = 'siglip'")
    out = models.isotonic(rows.filter("seed <> 43"), rows.filter("seed = 43"), "y_bin", "score")
    return out.groupBy("score").agg(F.max("p").alias("p"), F.count(F.lit(1)).alias("n"))


@query("scan_roundtrip", "format n:i total:f", " UNION ALL ".join(f"SELECT '{f}' AS format, count(*) AS n, sum(lat + lon + point_id) AS total FROM fx_points" for f in ("csv", "jsonl", "geojson", "parquet_wkb", "by_city")))
def scan_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The points written in each format and read back; a broken JSON line drops out."""
    p, out = load(spark, sf_dir, "fx_points"), new_path(spark, "roundtrip")
    p.write.option("header", True).csv(f"{out}/csv")
    lines = p.select(F.to_json(F.struct("point_id", "lat", "lon")).alias("value"))
    lines.unionByName(p.limit(1).select(F.lit('{"point_id": 1, "lat": ').alias("value"))).write.text(f"{out}/jsonl")
    files.write_geojson(p, f"{out}/geojson")
    wkb = F.expr("unhex('0101000000')")
    @pandas_udf("binary")
    def encode(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([struct.pack("<dd", a, b) for a, b in zip(x, y, strict=True)])

    p.select("point_id", F.concat(wkb, encode("lon", "lat")).alias("wkb")).write.parquet(f"{out}/wkb")
    files.write_by_city(p, f"{out}/by_city")
    files.write_by_city(p.filter("city = 'dc'"), f"{out}/by_city")
    read = {
        "csv": files.read_csv(spark, f"{out}/csv", p.schema.simpleString()[7:-1].replace(":", " "), ["point_id", "lat", "lon"]),
        "jsonl": files.read_jsonl(spark, f"{out}/jsonl", "point_id long, lat double, lon double"),
        "geojson": files.read_geojson(spark, f"{out}/geojson", "point_id: bigint"),
        "parquet_wkb": files.decode_points(spark.read.parquet(f"{out}/wkb")).withColumnsRenamed({"x": "lon", "y": "lat"}),
        "by_city": spark.read.parquet(f"{out}/by_city"),
    }
    found = None
    for name, df in read.items():
        one = df.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("lat") + F.col("lon") + F.col("point_id")).alias("total")).select(F.lit(name).alias("format"), "n", "total")
        found = one if found is None else found.unionByName(one)
    return found


@query("stream_run_log", "backbone train_city test_city ablation run_index auroc:f", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY backbone, train_city, test_city, ablation ORDER BY ts DESC, run_index DESC) AS r FROM fx_run_log) WHERE r = 1")
def stream_run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The run log arrives as files; the latest run of each cell is kept up to date."""
    out = new_path(spark, "stream-runs")
    load(spark, sf_dir, "fx_run_log").repartition(3).write.parquet(f"{out}/in")
    stream = spark.readStream.schema(spark.read.parquet(f"{out}/in").schema).option("maxFilesPerTrigger", 2).parquet(f"{out}/in")
    return jobs.latest_runs(stream, f"{out}/out").select("backbone", "train_city", "test_city", "ablation", "run_index", "auroc")


@query("stream_dedup", "event_id n:i", "SELECT event_id, 1 AS n FROM events")
def stream_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping fetches of events; each key comes through once."""
    out = new_path(spark, "stream-dedup")
    e = load(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    e.unionByName(e.filter("event_id % 3 = 0")).repartition(2).write.parquet(f"{out}/in")
    stream = spark.readStream.schema("event_id long, ts timestamp").parquet(f"{out}/in")
    kept = jobs.run_to_end(jobs.first_of_each(stream, ["event_id"], "ts", "3650 days"), f"{out}/out")
    return kept.groupBy("event_id").agg(F.count(F.lit(1)).alias("n"))


@query("stream_windows", "start event_type n:i", "SELECT strftime(time_bucket(INTERVAL 1 DAY, ts), '%Y-%m-%d') AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by day and kind, counted as they arrive."""
    out = new_path(spark, "stream-windows")
    load(spark, sf_dir, "events").select(F.col("ts").cast("timestamp").alias("ts"), "event_type").repartition(2).write.parquet(f"{out}/in")
    stream = spark.readStream.schema("ts timestamp, event_type string").parquet(f"{out}/in")
    name = f"w{uuid.uuid4().hex}"
    counts = jobs.window_counts(stream, "ts", "1 day", "3650 days", ["event_type"])

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/{name}")

    counts.writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{out}/{name}").select(F.date_format("w.start", "yyyy-MM-dd").alias("start"), "event_type", "n")
