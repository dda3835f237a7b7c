"""Targets as rows of a registry: training sets of several cities, scalers and their inverse."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import metrics

#: Name, tier, kind and weight of every target. Fixed values.
REGISTRY = (
    ("overture_sidewalk_present", 1, "binary", 1.0),
    ("overture_crosswalk_present", 1, "binary", 1.0),
    ("osm_marked_crossing_present", 1, "binary", 1.0),
    ("overture_intersection_count_200m", 1, "regression", 0.5),
    ("overture_building_footprint_frac_100m", 1, "regression", 0.5),
    ("walkability_index_v1", 1, "regression", 1.0),
    ("walkability_index_v2", 1, "regression", 1.0),
    ("D3B", 2, "regression", 0.5),
    ("D1B", 2, "regression", 0.3),
    ("D3APO", 2, "regression", 0.3),
    ("stops_400m", 2, "regression", 0.5),
    ("trips_per_hr_400m", 2, "regression", 0.3),
    ("NatWalkInd", 3, "regression", 0.5),
    ("LPA_CrudePrev", 3, "regression", 0.2),
    ("OBESITY_CrudePrev", 3, "regression", 0.2),
)
#: Least deviation that a scaler divides by.
FLOOR = 1e-6


def registry(spark: SparkSession, tiers: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """(target, tier, kind, weight) of the wanted tiers."""
    rows = [r for r in REGISTRY if r[1] in tiers]
    return spark.createDataFrame(rows, "target string, tier int, kind string, weight double")


def long_labels(wide: DataFrame, key: list[str], targets: DataFrame) -> DataFrame:
    """(*key, target, kind, weight, tier, value): every known, finite value of a registered target that is a column of ``wide``."""
    names = [r[0] for r in REGISTRY if r[0] in wide.columns]
    values = F.explode(F.array(*(F.struct(F.lit(n).alias("target"), F.col(n).cast("double").alias("value")) for n in names)))
    long = wide.select(*key, values.alias("_v")).select(*key, "_v.*")
    known = metrics.finite(long, "value").filter(F.abs("value") < float("inf"))
    # The registry has one row a target.
    return known.join(F.broadcast(targets), "target")


def training_set(labels: DataFrame, lock: DataFrame, cities: list[str], key: list[str]) -> DataFrame:
    """Labels of several cities, each kept to the points that its own lock holds."""
    return labels.filter(F.col("city").isin(*cities)).join(lock.select(*key).distinct(), key, "left_semi")


def scalers(train: DataFrame, targets: DataFrame) -> DataFrame:
    """(target, mean, scale, n) of every registered target: mean 0 and scale 1 for binary ones and those without values."""
    stats = train.groupBy("target").agg(F.avg("value").alias("_m"), F.stddev_pop("value").alias("_s"), F.count(F.lit(1)).alias("n"))
    of = targets.select("target", "kind").join(stats, "target", "left")
    scaled = (F.col("kind") == "regression") & F.col("_m").isNotNull()
    return of.select("target", F.when(scaled, F.col("_m")).otherwise(0.0).alias("mean"), F.when(scaled, F.greatest("_s", F.lit(FLOOR))).otherwise(1.0).alias("scale"), F.coalesce("n", F.lit(0)).alias("n"))


def scale(rows: DataFrame, of: DataFrame, value: str = "value", name: str = "scaled") -> DataFrame:
    return rows.join(F.broadcast(of.select("target", "mean", "scale")), "target").withColumn(name, (F.col(value) - F.col("mean")) / F.col("scale")).drop("mean", "scale")


def unscale(rows: DataFrame, of: DataFrame, scaled: str = "scaled", name: str = "value") -> DataFrame:
    """Values of scaled ones: the inverse of ``scale``."""
    return rows.join(F.broadcast(of.select("target", "mean", "scale")), "target").withColumn(name, F.col(scaled) * F.col("scale") + F.col("mean")).drop("mean", "scale")
