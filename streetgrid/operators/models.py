"""Probes, baselines and domain alignment on ``pyspark.ml``."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor, IsotonicRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from ..sources.shared import cut
from . import metrics
from .near import tasks


def vectors(df: DataFrame, column: str, name: str = "features") -> DataFrame:
    return df.withColumn(name, array_to_vector(F.col(column).cast("array<double>")))


def balanced(df: DataFrame, y: str) -> DataFrame:
    """Add ``weight``: each class weighs alike."""
    n = df.groupBy(y).agg(F.count(F.lit(1)).alias("_n"))
    total = n.agg(F.sum("_n").alias("_t"), F.count(F.lit(1)).alias("_k"))
    return df.join(F.broadcast(n), y).crossJoin(F.broadcast(total)).withColumn("weight", F.col("_t") / (F.col("_k") * F.col("_n"))).drop("_n", "_t", "_k")


def logistic_probe(train: DataFrame, test: DataFrame, y: str, strengths=(0.1, 1.0, 10.0), order: str = "vec_id") -> DataFrame:
    """Score ``test`` with a balanced logistic model whose strength is chosen on a hashed fifth of the training rows."""
    fifth = F.pmod(F.xxhash64(order), F.lit(5)) == 0
    tune, rest = train.filter(fifth), train.filter(~fifth)
    n = rest.count()

    def fitted(rows: DataFrame, c: float, size: int):
        model = LogisticRegression(featuresCol="features", labelCol=y, weightCol="weight", regParam=1.0 / (c * max(1, size)), maxIter=50).fit(balanced(rows, y))
        return lambda d: model.transform(d).withColumn("score", vector_to_array("probability")[1]).drop("rawPrediction", "probability", "prediction")

    def quality(c: float) -> float:
        found = metrics.auroc(fitted(rest, c, n)(tune).withColumn("_g", F.lit(1)), ["_g"], y, "score").first()
        return (found and found["auroc"]) or 0.0

    best = max(strengths, key=quality)
    return fitted(train, best, train.count())(test)


def tree_baselines(train: DataFrame, test: DataFrame, y: str, columns: list[str], seed: int = 42, trees: int = 300, depth: int = 30, rounds: int = 100, round_depth: int = 5) -> DataFrame:
    """Random forest and boosted trees on plain columns: columns ``forest`` and ``boosted``.

    30 is the deepest tree that ``ml`` allows. It has no bound of 31 leaves for boosted trees; depth 5 gives up to 32.
    The training rows are written once: both fits read them several times. The forest remembers the node of each row
    in each tree, where ``ml`` would walk every tree from its root in every pass.
    """
    assemble = VectorAssembler(inputCols=columns, outputCol="features", handleInvalid="skip")
    a, b = cut(assemble.transform(train).select("features", y)), assemble.transform(test)
    forest = RandomForestRegressor(labelCol=y, numTrees=trees, maxDepth=depth, seed=seed, predictionCol="forest", cacheNodeIds=True).fit(a)
    boosted = GBTRegressor(labelCol=y, maxIter=rounds, maxDepth=round_depth, seed=seed, predictionCol="boosted").fit(a)
    return boosted.transform(forest.transform(b))


def pca_centred(fit: DataFrame, df: DataFrame, k: int) -> DataFrame:
    """Project on the first ``k`` components after taking off the mean (``ml``'s PCA does not)."""
    model = PCA(k=k, inputCol="features", outputCol="pca").fit(fit)
    mean = np.array(_mean(fit))
    shift = (mean @ model.pc.toArray()).tolist()
    projected = model.transform(df)
    return projected.withColumn("pca", F.zip_with(vector_to_array("pca"), F.array(*map(F.lit, shift)), lambda a, b: a - b))


def _mean(df: DataFrame) -> list[float]:
    from pyspark.ml.stat import Summarizer

    return df.select(Summarizer.mean(F.col("features")).alias("m")).first()["m"].toArray().tolist()


def moments(df: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance of the vectors: only d and d x d numbers come to the driver."""
    from pyspark.mllib.linalg import Vectors
    from pyspark.mllib.linalg.distributed import RowMatrix

    matrix = RowMatrix(df.select("features").rdd.map(lambda r: Vectors.dense(r[0].toArray())))
    return np.array(_mean(df)), matrix.computeCovariance().toArray()


def _power(cov: np.ndarray, p: float, eps: float = 1e-6) -> np.ndarray:
    """A power of a covariance with ``eps`` on its diagonal; eigenvalues count as ``eps`` at least."""
    values, vectors_ = np.linalg.eigh(cov + eps * np.eye(len(cov)))
    return (vectors_ * np.maximum(values, eps) ** p) @ vectors_.T


def linear_map(df: DataFrame, matrix: np.ndarray, before: np.ndarray, after: np.ndarray, source: str, name: str) -> DataFrame:
    """(x - before) M + after for an array column, in Arrow batches; the matrix is d x d."""
    @pandas_udf("array<double>")
    def apply(x: pd.Series) -> pd.Series:
        return pd.Series(list((np.stack(x.to_numpy()) - before) @ matrix + after)) if len(x) else pd.Series([], dtype=object)

    return df.withColumn(name, apply(F.col(source).cast("array<double>")))


def coral(source: DataFrame, target: DataFrame, column: str, name: str = "aligned") -> DataFrame:
    """Source vectors with the target's mean and covariance."""
    ms, cs = moments(vectors(source, column))
    mt, ct = moments(vectors(target, column))
    return linear_map(source, _power(cs, -0.5) @ _power(ct, 0.5), ms, mt, column, name)


def subspace(source: DataFrame, target: DataFrame, column: str, k: int, name: str = "aligned") -> tuple[DataFrame, DataFrame]:
    """Source vectors in the source's first ``k`` components, turned to the target's; and target vectors in the target's.

    Both are centred on their own means; ``k`` is at most what the rows of either side span.
    """
    (ms, cs), (mt, ct) = (moments(vectors(side, column)) for side in (source, target))
    k = min(k, len(ms), source.count() - 1, target.count() - 1)
    top = lambda c: np.linalg.eigh(c)[1][:, ::-1][:, :k]
    bs, bt = top(cs), top(ct)
    return linear_map(source, bs @ (bs.T @ bt), ms, np.zeros(k), column, name), linear_map(target, bt, mt, np.zeros(k), column, name)


def isotonic(train: DataFrame, df: DataFrame, y: str, score: str, least: int = 50) -> DataFrame:
    """Calibrated probability ``p``; the score itself, clipped, where there are under ``least`` rows or one class."""
    fit = metrics.finite(train, y, score).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(y).alias("k")).first()
    if fit["n"] < least or fit["k"] < 2:
        return df.withColumn("p", F.least(F.greatest(F.col(score), F.lit(0.0)), F.lit(1.0)))
    model = IsotonicRegression(featuresCol=score, labelCol=y, predictionCol="p").fit(metrics.finite(train, y, score).withColumn(y, F.col(y).cast("double")))
    return model.transform(df)


#: Groups whose centres are broadcast; the centres of more are joined.
FEW_GROUPS = 1 << 16


def spatial_folds(points: DataFrame, k: int, by: str = "city", order: str = "point_id", rounds: int = 50, few: int = FEW_GROUPS) -> DataFrame:
    """``fold`` (0 to k - 1) of each point among the points of its group that lie together: k-means of metres x, y, all groups at once.

    The start is fixed: the point nearest the group's mean, then always the one farthest from the centres so far (ties: the
    smallest ``order``). A point belongs to its nearest centre (ties: the smaller number); centres move to the mean of their
    points until none moves by a micrometre, for ``rounds`` rounds at most. Points without a group or a finite place have
    no fold; groups of fewer than k distinct places have fewer folds. A round's sums are partial before they are shuffled, so a group
    that holds most points is no hot one.
    """
    known = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    placed = points.filter(F.col(by).isNotNull() & known("x") & known("y")).select(by, order, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    # Every round reads these rows: dealt out first, as small files come in few pieces.
    placed = cut(placed.repartition(tasks(points.sparkSession), by, order))
    place = F.struct("x", "y")
    away = lambda c: F.pow(F.col("x") - c["x"], 2) + F.pow(F.col("y") - c["y"], 2)
    nearest = lambda name: F.array_min(F.transform(name, lambda c, i: F.struct(away(c).alias("d"), i.alias("fold"))))

    means = cut(placed.groupBy(by).agg(F.array(F.struct(F.avg("x").alias("x"), F.avg("y").alias("y"))).alias("_m")))
    first = F.min_by(place, F.struct(nearest("_m")["d"], F.col(order)))
    # There are as many rows of centres as of means throughout.
    small = means.count() <= few
    beside = lambda rows, centres, how="inner": rows.join(F.broadcast(centres) if small else centres, by, how)
    centres = cut(beside(placed, means).groupBy(by).agg(F.array(first).alias("_c")))
    for _ in range(k - 1):
        far = beside(placed, centres).groupBy(by).agg(F.min_by(F.struct("x", "y", nearest("_c")["d"].alias("d")), F.struct(-nearest("_c")["d"], F.col(order))).alias("_f"))
        one = F.array(F.struct(F.col("_f.x").alias("x"), F.col("_f.y").alias("y")))
        centres = cut(centres.join(far, by).select(by, F.when(F.col("_f.d") > 0, F.concat("_c", one)).otherwise(F.col("_c")).alias("_c")))
    for _ in range(rounds):
        sums = beside(placed, centres).select(by, "x", "y", nearest("_c")["fold"].alias("_n")).groupBy(by, "_n").agg(F.avg("x").alias("x"), F.avg("y").alias("y"))
        moved = sums.groupBy(by).agg(F.map_from_entries(F.collect_list(F.struct("_n", place))).alias("_to"))
        # A centre without points stays where it is.
        to = F.transform("_c", lambda c, i: F.coalesce(F.col("_to")[i], c))
        step = F.array_max(F.zip_with("_c", "_new", lambda a, b: F.greatest(F.abs(a["x"] - b["x"]), F.abs(a["y"] - b["y"]))))
        after = cut(centres.join(moved, by).withColumn("_new", to).select(by, F.col("_new").alias("_c"), step.alias("_step")))
        still = after.agg(F.max("_step")).first()[0]
        centres = after.select(by, "_c")
        if still is None or still < 1e-6:
            break
    return beside(points, centres, "left").withColumn("fold", F.when(known("x") & known("y") & F.col("_c").isNotNull(), nearest("_c")["fold"])).drop("_c")
