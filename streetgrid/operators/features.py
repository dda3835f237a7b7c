"""Feature engineering: scaling, imputation, vectors and the composite index."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def medians(df: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """One row (for each ``by``) with each column's exact median."""
    aggs = [F.percentile(c, 0.5).alias("med_" + c) for c in columns]
    return df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)


def impute(df: DataFrame, columns: list[str], by: list[str], fallback: float = 0.0) -> DataFrame:
    """Nulls become the group's median, or ``fallback`` where all are null."""
    joined = df.join(medians(df, columns, by), by)
    return joined.withColumns({c: F.coalesce(c, "med_" + c, F.lit(fallback)) for c in columns}).drop(*("med_" + c for c in columns))


def scale(df: DataFrame, columns: list[str], fit: DataFrame, floor: float = 1e-6) -> DataFrame:
    """Standardise by mean and population deviation of ``fit``; columns that hardly vary are divided by 1."""
    # One row of statistics.
    stats = fit.agg(*(F.avg(c).alias("m_" + c) for c in columns), *(F.stddev_pop(c).alias("s_" + c) for c in columns))
    out = df.crossJoin(F.broadcast(stats))
    by = lambda c: F.when(F.col("s_" + c) < floor, 1.0).otherwise(F.col("s_" + c))
    return out.withColumns({c: (F.col(c) - F.col("m_" + c)) / by(c) for c in columns}).drop(*(p + c for c in columns for p in ("m_", "s_")))


def l2_normal(v: Column) -> Column:
    """A vector over its length, at least 1e-8."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.transform(v, lambda x: x.cast("double") / F.greatest(norm, F.lit(1e-8)))


def mean_pool(df: DataFrame, by: list[str], vector: str, name: str = "pooled") -> DataFrame:
    """Mean vector of each group's vectors."""
    each = df.select(*by, F.posexplode(vector).alias("pos", "x")).groupBy(*by, "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    lists = each.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("l"))
    return lists.select(*by, F.transform("l", lambda e: e["x"]).alias(name))


def fill_missing(df: DataFrame, vector: str, mean: list[float]) -> DataFrame:
    """Missing vectors become the mean, all are normalised again, and a flag tells which were missing."""
    filled = F.coalesce(F.col(vector), F.array(*map(F.lit, mean)))
    return df.withColumn("missing", F.col(vector).isNull().cast("int")).withColumn(vector, l2_normal(filled))


def correlation_matrix(df: DataFrame, columns: list[str]) -> list[Column]:
    """Aggregates for the upper triangle."""
    return [F.corr(a, b).alias(f"{a}__{b}") for i, a in enumerate(columns) for b in columns[i + 1 :]]


def first_component(df: DataFrame, columns: list[str], anchor: str) -> tuple[dict[str, float], dict[str, float], dict[str, float], float]:
    """Means, deviations, loadings of unit length with a positive ``anchor``, and the explained share.

    One aggregation gives the d x d matrix; only that comes to the driver. Nulls count as the mean.
    """
    row = df.agg(*(F.avg(c).alias("m_" + c) for c in columns), *(F.stddev_pop(c).alias("s_" + c) for c in columns)).first()
    mean = {c: row["m_" + c] for c in columns}
    deviation = {c: row["s_" + c] or 1.0 for c in columns}
    z = {c: (F.coalesce(c, F.lit(mean[c])) - mean[c]) / deviation[c] for c in columns}
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    cov = df.agg(*(F.covar_pop(z[a], z[b]).alias(f"c{i}") for i, (a, b) in enumerate(pairs))).first()
    matrix = np.zeros((len(columns), len(columns)))
    for i, (a, b) in enumerate(pairs):
        matrix[columns.index(a), columns.index(b)] = matrix[columns.index(b), columns.index(a)] = cov[i]
    values, vectors = np.linalg.eigh(matrix)
    loading = vectors[:, -1] * (1.0 if vectors[columns.index(anchor), -1] >= 0 else -1.0)
    return mean, deviation, dict(zip(columns, loading.tolist(), strict=True)), float(values[-1] / values.sum())


def index_of(columns: list[str], mean: dict, deviation: dict, loading: dict) -> Column:
    """The composite index as an expression; nulls count as the mean."""
    total = F.lit(0.0)
    for c in columns:
        total = total + (F.coalesce(c, F.lit(mean[c])) - mean[c]) / deviation[c] * loading[c]
    return total


def log_clipped(c: Column) -> Column:
    return F.log1p(F.greatest(c, F.lit(0.0)))


def sigmoid(c: Column) -> Column:
    return 1 / (1 + F.exp(-c))
