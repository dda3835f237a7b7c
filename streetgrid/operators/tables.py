"""Table operators: keeping, replacing, aligning, rolling up and auditing rows by (city, point_id)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ["city", "point_id"]
HEADINGS = [0, 90, 180, 270]


def in_lock(df: DataFrame, lock: DataFrame, keys: list[str] = KEY) -> DataFrame:
    """Rows whose whole key is in the lock; ids restart in each city, so the city always belongs to it."""
    return df.join(lock.select(*keys).distinct(), keys, "left_semi")


def missing(lock: DataFrame, source: DataFrame, keys: list[str] = KEY) -> DataFrame:
    """Lock rows that a source does not have."""
    return lock.join(source.select(*keys), keys, "left_anti")


def replace_part(old: DataFrame, new: DataFrame, part: str = "city") -> DataFrame:
    """``old`` with the parts that ``new`` has replaced by it, as a dynamic partition overwrite would leave it."""
    return old.join(new.select(part).distinct(), part, "left_anti").unionByName(new, allowMissingColumns=True)


def append_aligned(old: DataFrame, new: DataFrame, renames: dict[str, str]) -> DataFrame:
    """Rows of both under all columns; missing ones are null, ``renames`` go first."""
    return old.unionByName(new.withColumnsRenamed(renames), allowMissingColumns=True)


def keep_one(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in an order."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_r", rank).filter("_r = 1").drop("_r")


def street_status(headings: DataFrame) -> DataFrame:
    """complete, partial or none, by the headings that a point has images of."""
    n = F.size(F.array_intersect(F.collect_set("heading"), F.array(*map(F.lit, HEADINGS))))
    return headings.groupBy(*KEY).agg(F.when(n == len(HEADINGS), "complete").when(n > 0, "partial").otherwise("none").alias("status"))


def heading_rollup(stats: DataFrame) -> DataFrame:
    """Per point: mean fractions, largest ones, mean of positive widths (0 without), headings with coverage, mean coverage."""
    width = F.coalesce(F.avg(F.when(F.col("sidewalk_width_px") > 0, F.col("sidewalk_width_px"))), F.lit(0.0))
    return stats.groupBy(*KEY).agg(
        F.avg("sidewalk_frac").alias("sidewalk_mean"), F.max("sidewalk_frac").alias("sidewalk_max"), F.avg("crosswalk_frac").alias("crosswalk_mean"), F.max("crosswalk_frac").alias("crosswalk_max"),
        F.avg("vegetation_frac").alias("vegetation_mean"), width.alias("width_mean"), F.count_if(F.col("mask_coverage") > 0).alias("n_covered"), F.avg("mask_coverage").alias("coverage_mean"),
    )


def fingerprint(df: DataFrame) -> DataFrame:
    """One row that tells tables apart whatever their order: rows, and xor and sum of the rows' hashes."""
    h = F.xxhash64(*(F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in sorted(df.columns)))
    digest = F.sha2(F.concat_ws("|", F.bit_xor(h).cast("string"), F.sum(h.cast("decimal(38,0)")).cast("string")), 256)
    return df.agg(F.count(F.lit(1)).alias("n"), F.substring(digest, 1, 12).alias("fingerprint"))


def without_sentinel(value: Column, lowest: float = -99999.0) -> Column:
    """Null in place of the large negative numbers that stand for a missing value."""
    return F.when(value > lowest, value)


def purge(df: DataFrame, names: list[str], prefixes: list[str]) -> DataFrame:
    """The table without columns of these names (in any case; absent ones are no error) and of these prefixes."""
    listed = {n.lower() for n in names}
    gone = [c for c in df.columns if c.lower() in listed or any(c.startswith(p) for p in prefixes)]
    return df.drop(*gone)
