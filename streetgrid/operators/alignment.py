"""Vectors and the points they belong to: ids from a sidecar, alignment to a fixed set of points, keys that several sources share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import features

KEY = ["city", "point_id"]


def with_ids(vectors: DataFrame, sidecar: DataFrame, block: list[str], row: str = "row", vector: str = "vector") -> DataFrame:
    """Vectors of length 1 with the ids that the sidecar gives the rows of their block.

    A row without an id or an id without a row means that the two do not belong together, as does a row given twice on either side: ValueError.
    """
    on = [*block, row]
    both = vectors.groupBy(*on).agg(F.first(vector).alias(vector), F.count(F.lit(1)).alias("_v")).join(
        sidecar.groupBy(*on).agg(F.count(F.lit(1)).alias("_s"), *(F.first(c).alias(c) for c in sidecar.columns if c not in on)), on, "full")
    unfit = both.filter((F.coalesce("_v", F.lit(0)) != 1) | (F.coalesce("_s", F.lit(0)) != 1)).groupBy(*block).agg(F.count(F.lit(1)).alias("n")).orderBy(*block).first()
    if unfit is not None:
        raise ValueError(f"{unfit['n']} rows of vectors and ids do not fit in {[unfit[b] for b in block]}")
    return both.withColumn(vector, features.l2_normal(F.col(vector))).drop("_v", "_s")


def align(points: DataFrame, block: DataFrame, vector: str = "vector", keys: list[str] = KEY, order: str = "row", missing: bool = True) -> DataFrame:
    """Every point with its vector and ``present`` (0 or 1); of several vectors of a point the last by ``order``.

    With ``missing`` false a point without a vector is an error that names the first ten.
    """
    last = block.groupBy(*keys).agg(F.max_by(vector, order).alias(vector))
    out = points.join(last, keys, "left").withColumn("present", F.col(vector).isNotNull().cast("int"))
    if not missing:
        absent = out.filter("present = 0").select(*keys).orderBy(*keys).take(10)
        if absent:
            raise ValueError(f"no vectors for {[tuple(r) for r in absent]}")
    return out


def in_all(points: DataFrame, *sources: DataFrame, keys: list[str] = KEY) -> DataFrame:
    """Points whose key every source has; repeated keys there repeat nothing."""
    for source in sources:
        points = points.join(source.select(*keys), keys, "left_semi")
    return points
