"""Composite indices that are fitted once, stored, and rebuilt by other jobs from what was stored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import features

#: How a component enters: as it is, or the logarithm of 1 plus what is over 0.
TRANSFORMS = {"raw": lambda c: c.cast("double"), "log1p": lambda c: features.log_clipped(c.cast("double"))}
_STORED = "version string, component string, place int, transform string, median double, mean double, deviation double, loading double, explained double"


def transformed(df: DataFrame, components: dict[str, str]) -> DataFrame:
    """Components (name -> transform) as they enter the index."""
    return df.withColumns({c: TRANSFORMS[t](F.col(c)) for c, t in components.items()})


def fit(df: DataFrame, components: dict[str, str], anchor: str, version: str, fit_rows: Column | None = None) -> DataFrame:
    """The statistics of an index, one row for each component: medians that fill gaps (over all rows), and means, deviations and
    loadings of the first principal component over ``fit_rows`` (default: all)."""
    names = list(components)
    rows = transformed(df, components)
    medians = features.medians(rows, names).first()
    filled = rows.withColumns({c: F.coalesce(c, F.lit(medians["med_" + c]), F.lit(0.0)) for c in names})
    mean, deviation, loading, explained = features.first_component(filled if fit_rows is None else filled.filter(fit_rows), names, anchor)
    stored = [(version, c, i, components[c], medians["med_" + c], mean[c], deviation[c], loading[c], explained) for i, c in enumerate(names)]
    return df.sparkSession.createDataFrame(stored, _STORED)


def store(stats: DataFrame, path: str) -> None:
    """Add a version to the table of fitted indices."""
    stats.coalesce(1).write.mode("append").partitionBy("version").parquet(path)


def stored(spark: SparkSession, path: str, version: str) -> list:
    """The rows of a version, in order of components."""
    found = spark.read.schema(_STORED).parquet(path).filter(F.col("version") == version).orderBy("place").collect()
    if not found:
        raise ValueError(f"no index of version {version}")
    return found


def apply(df: DataFrame, stats: list, name: str) -> DataFrame:
    """Add the index by stored statistics, and ``components_json``: the transformed and filled components of every row."""
    rows = transformed(df, {r["component"]: r["transform"] for r in stats})
    rows = rows.withColumns({r["component"]: F.coalesce(r["component"], F.lit(r["median"]), F.lit(0.0)) for r in stats})
    names = [r["component"] for r in stats]
    index = features.index_of(names, *({r["component"]: r[k] for r in stats} for k in ("mean", "deviation", "loading")))
    return rows.withColumn(name, index).withColumn("components_json", F.to_json(F.struct(*names)))


def rebuild(rows: DataFrame, components: list[str], anchor: str, name: str) -> DataFrame:
    """An index on some of the stored components, fitted anew on all rows of (..., components_json)."""
    schema = ", ".join(f"{c} double" for c in components)
    parsed = rows.withColumn("_c", F.from_json("components_json", schema)).select(*rows.columns, *(F.col(f"_c.{c}").alias(c) for c in components))
    mean, deviation, loading, _ = features.first_component(parsed, components, anchor)
    return parsed.withColumn(name, features.index_of(components, mean, deviation, loading)).select(*rows.columns, name)
