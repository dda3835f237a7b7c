"""Queries on linear baselines: penalty searches and fits from sums of products."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import features, linear, metrics
from .fixtures import load
from .registry import query

_ROWS = "SELECT point_id % 5 AS f, sidewalk_frac AS x, sidewalk_width_px / 1e2 AS z, vegetation_frac + sidewalk_frac AS y, 1e0 + heading / 9e1 AS w FROM fx_mask_stats"
_SUMS = "count(*) AS n, sum(w) AS sw, sum(w * x) AS sx, sum(w * z) AS sz, sum(w * y) AS sy, sum(w * x * x) AS xx, sum(w * z * z) AS zz, sum(w * x * z) AS xz, sum(w * x * y) AS xy, sum(w * z * y) AS zy, sum(w * y * y) AS yy"
_NAMES = "sw sx sz sy xx zz xz xy zy yy".split()
#: Sums around the means.
_CENTRED = "xx - sx * sx / sw AS a, zz - sz * sz / sw AS c, xz - sx * sz / sw AS b, xy - sx * sy / sw AS p, zy - sz * sy / sw AS q"


def _mask_rows(spark, sf_dir):
    m = load(spark, sf_dir, "fx_mask_stats")
    return m.select((F.col("point_id") % 5).alias("fold"), F.array("sidewalk_frac", F.col("sidewalk_width_px") / 100).alias("x"), (F.col("vegetation_frac") + F.col("sidewalk_frac")).alias("y"), (1 + F.col("heading") / 90.0).alias("w"))


_RIDGE = f"""WITH r AS ({_ROWS.replace("1e0 + heading / 9e1", "1e0")}), s AS (SELECT f, {_SUMS} FROM r GROUP BY f), al AS (SELECT k, pow(10e0, -3 + 7 * k / 29e0) AS alpha FROM range(0, 30) q(k)),
 o AS (SELECT v.f, {", ".join(f"sum(o.{c}) AS {c}" for c in _NAMES)} FROM s v JOIN s o ON o.f <> v.f GROUP BY v.f),
 t AS (SELECT f, sx / sw AS mx, sz / sw AS mz, sy / sw AS my, {_CENTRED} FROM o),
 b AS (SELECT f, k, alpha, mx, mz, my, ((c + alpha) * p - b * q) / ((a + alpha) * (c + alpha) - b * b) AS b1, ((a + alpha) * q - b * p) / ((a + alpha) * (c + alpha) - b * b) AS b2 FROM t, al),
 e AS (SELECT b.k, b.alpha, b.f, 1 - (yy - 2 * (b1 * xy + b2 * zy + i * sy) + b1 * b1 * xx + b2 * b2 * zz + 2 * b1 * b2 * xz + 2 * i * (b1 * sx + b2 * sz) + i * i * sw) / (yy - sy * sy / sw) AS r2
   FROM (SELECT *, my - b1 * mx - b2 * mz AS i FROM b) b JOIN s ON s.f = b.f),
 g AS (SELECT k, alpha, avg(r2) AS mean_r2, min(r2) AS least_r2 FROM e GROUP BY k, alpha)
 SELECT k, alpha, mean_r2, least_r2, CASE WHEN k = (SELECT min(k) FROM g WHERE mean_r2 >= (SELECT max(mean_r2) - 1e-12 FROM g)) THEN 1 ELSE 0 END AS chosen FROM g"""


@query("ridge_path_folds", "k:i alpha:f mean_r2:f least_r2:f chosen:i", _RIDGE)
def ridge_path_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thirty penalties on five folds, all from the folds' sums: mean and least R² on the fold left out, and the choice."""
    found = linear.ridge_by_folds(linear.sums(_mask_rows(spark, sf_dir), "x", "y", fold="fold"))
    rows = [(k, a, float(found.scores[:, k].mean()), float(found.scores[:, k].min()), int(a == found.alpha)) for k, a in enumerate(found.alphas)]
    return spark.createDataFrame(rows, "k long, alpha double, mean_r2 double, least_r2 double, chosen long")


ALPHA, NET_ALPHA, L1 = 10.0, 0.001, 0.5

_SOFT = "sign({r}) * greatest(abs({r}) - 5e-4, 0)"
_BASELINES = f"""WITH RECURSIVE r AS ({_ROWS}), s AS (SELECT {_SUMS} FROM r), t AS (SELECT sw, sx / sw AS mx, sz / sw AS mz, sy / sw AS my, {_CENTRED} FROM s),
 u AS (SELECT {_SUMS.replace("w * ", "").replace("sum(w)", "count(*)")} FROM r), v AS (SELECT sx / n AS mx, sz / n AS mz, sy / n AS my, a / n AS a, b / n AS b, c / n AS c, p / n AS p, q / n AS q FROM (SELECT *, {_CENTRED} FROM u)),
 d(i, b1, b2) AS (SELECT 0, 0e0, 0e0 UNION ALL SELECT i + 1, n1, {_SOFT.format(r="(q - b * n1)")} / (c + 5e-4) FROM (SELECT i, a, b, c, p, q, {_SOFT.format(r="(p - b * b2)")} / (a + 5e-4) AS n1 FROM d, v WHERE i < 400)),
 m AS (SELECT 'linear' AS model, (c * p - b * q) / (a * c - b * b) AS b1, (a * q - b * p) / (a * c - b * b) AS b2, mx, mz, my FROM t
  UNION ALL SELECT 'ridge', ((c + 10) * p - b * q) / ((a + 10) * (c + 10) - b * b), ((a + 10) * q - b * p) / ((a + 10) * (c + 10) - b * b), mx, mz, my FROM t
  UNION ALL SELECT 'elastic_net', b1, b2, mx, mz, my FROM d, v WHERE i = 400)
 SELECT model, b1, b2, my - b1 * mx - b2 * mz AS intercept FROM m"""


@query("linear_baselines", "model b1:f b2:f intercept:f", _BASELINES)
def linear_baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted least squares, weighted ridge, and the elastic net (which has no weights) on the same rows."""
    rows = _mask_rows(spark, sf_dir)
    weighted, plain = linear.sums(rows, "x", "y", "w")[0], linear.sums(rows, "x", "y")[0]
    fits = {"linear": linear.least_squares(weighted), "ridge": linear.ridge_path(weighted, [ALPHA])[0], "elastic_net": linear.elastic_net(plain, NET_ALPHA, L1)}
    return spark.createDataFrame([(m, *map(float, f.coef), float(f.intercept)) for m, f in fits.items()], "model string, b1 double, b2 double, intercept double")


def _embedded(spark, sf_dir):
    e = load(spark, sf_dir, "embeddings").withColumn("target", F.col("label").cast("double"))
    return e.filter("vec_id % 4 <> 3"), e.filter("vec_id % 4 = 3")


@query("ridge_probe")
def ridge_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probes of the plain and the logarithmic target, each with the penalty that leaves out best; scored on the rows put aside."""
    train, test = _embedded(spark, sf_dir)
    out = None
    for name, y, back in (("plain", F.col("target"), lambda c: c), ("log1p", features.log_clipped(F.col("target")), F.expm1)):
        found = linear.ridge_leave_one_out(train.withColumn("y", y), "embedding", "y")
        scored = test.withColumn("run", F.lit(name)).withColumn("alpha", F.lit(found.alpha)).withColumn("prediction", back(found.fit.predict("embedding")))
        out = scored if out is None else out.unionByName(scored)
    by = ["run", "alpha"]
    return metrics.spearman(out, by, "target", "prediction").join(metrics.regression_errors(out, by, "target", "prediction"), by)


@query("elastic_net_path")
def elastic_net_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten penalties of the elastic net on 64 features, from one set of sums: features in use, and R² on the rows put aside."""
    train, test = _embedded(spark, sf_dir)
    fitted, held = linear.sums(train, "embedding", "target")[0], linear.sums(test, "embedding", "target")[0]
    alphas = [10.0 ** (-k / 3) for k in range(10)]
    rows = [(a, int((f.coef != 0).sum()), float(held.r2(f))) for a, f in zip(alphas, linear.elastic_path(fitted, alphas, L1), strict=True)]
    return spark.createDataFrame(rows, "alpha double, n_used long, r2 double")
