"""Queries on predictions: metrics, agreement with labels, resampling and tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import inference, metrics, reports
from .fixtures import load
from .registry import query

RUN = ["backbone", "seed", "city"]
#: Replicates of the bootstraps, and how many must be known for an interval by points and by cells.
WHOLE, LEAST_POINTS, LEAST_CELLS = 1000, 100, 50
#: Rows with both labels that a comparison of two sources needs; what an area may be over the ceiling before it tells of noise.
LEAST_SHARED, OVER_CEILING = 50, 0.02
_P = "SELECT backbone, seed, city, point_id, y_bin, y_reg, score FROM fx_predictions WHERE y_bin IS NOT NULL"


def _rows(spark, sf_dir):
    return load(spark, sf_dir, "fx_predictions")


def _auc_sql(source: str, by: str, w: str = "1e0", y: str = "y_bin", s: str = "score") -> str:
    """SQL of the area by average ranks, weighted."""
    return f"""SELECT {by}, CASE WHEN sum(p) > 0 AND sum(n) > 0 THEN sum(p * b) / (sum(p) * sum(n)) END AS auroc FROM (SELECT *, sum(n) OVER (PARTITION BY {by} ORDER BY s ROWS UNBOUNDED PRECEDING) - n / 2 AS b
    FROM (SELECT {by}, {s} AS s, sum(CASE WHEN {y} = 1 THEN {w} ELSE 0e0 END) AS p, sum(CASE WHEN {y} <> 1 THEN {w} ELSE 0e0 END) AS n FROM ({source}) GROUP BY {by}, {s})) GROUP BY {by}"""


_BY = "backbone, seed, city"


@query("auroc", "backbone seed:i city auroc:f", _auc_sql(_P, _BY))
def auroc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.auroc(_rows(spark, sf_dir), RUN, "y_bin", "score")


@query(
    "avg_precision",
    "backbone seed:i city ap:f",
    f"""SELECT {_BY}, sum(p * pr) / sum(p) AS ap FROM (SELECT *, sum(p) OVER w / sum(m) OVER w AS pr FROM (SELECT {_BY}, score, sum(CASE WHEN y_bin = 1 THEN 1e0 ELSE 0e0 END) AS p, count(*) AS m FROM ({_P}) GROUP BY {_BY}, score)
    WINDOW w AS (PARTITION BY {_BY} ORDER BY score DESC ROWS UNBOUNDED PRECEDING)) GROUP BY {_BY}""",
)
def avg_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.average_precision(_rows(spark, sf_dir), RUN, "y_bin", "score")


def _ranked(source: str, by: str, a: str, b: str) -> str:
    rank = lambda c: f"rank() OVER (PARTITION BY {by} ORDER BY {c}) + (count(*) OVER (PARTITION BY {by}, {c}) - 1) / 2e0"
    return f"SELECT *, {rank(a)} AS ra, {rank(b)} AS rb FROM ({source})"


@query("spearman", "backbone seed:i city rho:f", f"SELECT {_BY}, corr(ra, rb) AS rho FROM ({_ranked('SELECT * FROM fx_predictions', _BY, 'y_reg', 'score')}) GROUP BY {_BY}")
def spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.spearman(_rows(spark, sf_dir), RUN, "y_reg", "score")


@query("pearson", "backbone seed:i city r:f", f"SELECT {_BY}, corr(y_reg, score) AS r FROM fx_predictions GROUP BY {_BY}")
def pearson(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.pearson(_rows(spark, sf_dir), RUN, "y_reg", "score")


@query("regression_errors", "backbone seed:i city r2:f rmse:f mae:f", f"SELECT {_BY}, 1 - avg(power(y - score, 2)) / var_pop(y) AS r2, sqrt(avg(power(y - score, 2))) AS rmse, avg(abs(y - score)) AS mae FROM (SELECT *, y_reg / 1e5 AS y FROM fx_predictions) GROUP BY {_BY}")
def regression_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.regression_errors(_rows(spark, sf_dir).withColumn("y", F.col("y_reg") / 1e5), RUN, "y", "score")


@query(
    "r2_recal",
    "backbone seed:i city r2_recal:f",
    f"""WITH a AS (SELECT {_BY}, avg(score) AS m, stddev_pop(score) AS s FROM fx_predictions WHERE point_id % 5 < 4 GROUP BY {_BY}), t AS (SELECT *, y_reg / 1e5 AS y FROM fx_predictions WHERE point_id % 5 = 4),
    z AS (SELECT {_BY}, avg(y) AS tm, stddev_pop(y) AS ts FROM t GROUP BY {_BY}) SELECT t.backbone, t.seed, t.city, 1 - avg(power(y - ((score - m) / s * ts + tm), 2)) / var_pop(y) AS r2_recal
    FROM t JOIN z ON z.backbone = t.backbone AND z.seed = t.seed AND z.city = t.city JOIN a ON a.backbone = t.backbone AND a.seed = t.seed AND a.city = t.city GROUP BY t.backbone, t.seed, t.city""",
)
def r2_recal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four fifths of the points give the scale, the last fifth is scored."""
    rows = _rows(spark, sf_dir).withColumn("y", F.col("y_reg") / 1e5)
    train = rows.filter("point_id % 5 < 4").groupBy(*RUN).agg(F.avg("score").alias("m"), F.stddev_pop("score").alias("s"))
    return metrics.r2_recalibrated(rows.filter("point_id % 5 = 4"), RUN, "y", "score", train)


_CELLS = "count(CASE WHEN a = 1 AND b = 1 THEN 1 END) AS n11, count(CASE WHEN a = 1 AND b = 0 THEN 1 END) AS n10, count(CASE WHEN a = 0 AND b = 1 THEN 1 END) AS n01, count(CASE WHEN a = 0 AND b = 0 THEN 1 END) AS n00"


@query(
    "confusion_kappa",
    "n11:i n10:i n01:i n00:i kappa:f raw_agreement:f auroc_a:f auroc_b:f",
    f"""SELECT n11, n10, n01, n00, (po - pe) / (1 - pe) AS kappa, po AS raw_agreement, 5e-1 * (1 + n11 / CAST(n11 + n10 AS DOUBLE) - n01 / CAST(n01 + n00 AS DOUBLE)) AS auroc_a, 5e-1 * (1 + n11 / CAST(n11 + n01 AS DOUBLE) - n10 / CAST(n10 + n00 AS DOUBLE)) AS auroc_b
    FROM (SELECT *, (n11 + n00) / n AS po, (n11 + n10) / n * (n11 + n01) / n + (n01 + n00) / n * (n10 + n00) / n AS pe FROM (SELECT *, CAST(n11 + n10 + n01 + n00 AS DOUBLE) AS n FROM (SELECT {_CELLS} FROM (SELECT rater_a AS a, rater_b AS b FROM fx_annotators))))""",
)
def confusion_kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.agreement(metrics.confusion(load(spark, sf_dir, "fx_annotators"), [], "rater_a", "rater_b")).drop("prevalence_a", "prevalence_b")


_PRF = "CASE WHEN n11 + n01 > 0 THEN n11 / CAST(n11 + n01 AS DOUBLE) ELSE 0 END AS precision, CASE WHEN n11 + n10 > 0 THEN n11 / CAST(n11 + n10 AS DOUBLE) ELSE 0 END AS recall, CASE WHEN 2 * n11 + n01 + n10 > 0 THEN 2 * n11 / CAST(2 * n11 + n01 + n10 AS DOUBLE) ELSE 0 END AS f1, (n11 + n00) / CAST(n11 + n10 + n01 + n00 AS DOUBLE) AS accuracy"


@query("threshold_metrics", "backbone seed:i city n11:i n10:i n01:i n00:i precision:f recall:f f1:f accuracy:f", f"SELECT *, {_PRF} FROM (SELECT {_BY}, {_CELLS} FROM (SELECT *, y_bin AS a, CASE WHEN score >= 5e-1 THEN 1 ELSE 0 END AS b FROM ({_P})) GROUP BY {_BY})")
def threshold_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir).withColumn("b", (F.col("score") >= 0.5).cast("int"))
    return metrics.threshold_metrics(metrics.confusion(rows, RUN, "y_bin", "b"))


@query(
    "prevalence_threshold",
    "backbone seed:i city threshold:f n_predicted:i f1:f",
    f"""WITH p AS (SELECT {_BY}, least(greatest(avg(CAST(y_bin AS DOUBLE)), 1e-3), 999e-3) AS p FROM ({_P}) WHERE point_id % 5 < 4 GROUP BY {_BY}), t AS (SELECT x.*, p FROM ({_P}) x JOIN p USING (backbone, seed, city) WHERE point_id % 5 = 4),
    r AS (SELECT {_BY}, list_sort(list(score)) AS s, (count(*) - 1) * (1 - max(p)) AS pos FROM t GROUP BY {_BY}), c AS (SELECT {_BY}, s[CAST(floor(pos) AS INT) + 1] + (s[CAST(ceil(pos) AS INT) + 1] - s[CAST(floor(pos) AS INT) + 1]) * (pos - floor(pos)) AS threshold FROM r)
    SELECT {_BY}, threshold, n11 + n01 AS n_predicted, CASE WHEN 2 * n11 + n01 + n10 > 0 THEN 2 * n11 / CAST(2 * n11 + n01 + n10 AS DOUBLE) ELSE 0 END AS f1 FROM (SELECT {_BY}, max(threshold) AS threshold, {_CELLS} FROM (SELECT t.*, threshold, y_bin AS a, CASE WHEN score >= threshold THEN 1 ELSE 0 END AS b FROM t JOIN c USING (backbone, seed, city)) GROUP BY {_BY})""",
)
def prevalence_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = metrics.finite(_rows(spark, sf_dir), "y_bin", "score")
    share = rows.filter("point_id % 5 < 4").groupBy(*RUN).agg(F.avg("y_bin").alias("p"))
    predicted = metrics.prevalence_threshold(rows.filter("point_id % 5 = 4"), RUN, "score", share)
    counts = metrics.threshold_metrics(metrics.confusion(predicted, [*RUN, "threshold"], "y_bin", "predicted"))
    return counts.select(*RUN, "threshold", (F.col("n11") + F.col("n01")).alias("n_predicted"), "f1")


_TWO = f"SELECT p.*, CASE WHEN e.label_type IN ('CurbRamp', 'Crosswalk') THEN 1 WHEN e.label_type IN ('NoSidewalk', 'NoCurbRamp') THEN 0 END AS y_ext FROM ({_P}) p JOIN fx_ext_labels e ON e.label_id = p.point_id"


def _two(spark, sf_dir):
    ext = load(spark, sf_dir, "fx_ext_labels").select(F.col("label_id").alias("point_id"), "label_type", "lat", "lon")
    y = F.when(F.col("label_type").isin("CurbRamp", "Crosswalk"), 1).when(F.col("label_type").isin("NoSidewalk", "NoCurbRamp"), 0)
    return metrics.finite(_rows(spark, sf_dir), "y_bin").join(ext, "point_id").withColumn("y_ext", y)


@query("two_reference_auroc", "backbone city n:i own:f ext:f delta:f", f"SELECT backbone, city, n, a.auroc AS own, b.auroc AS ext, b.auroc - a.auroc AS delta FROM ({_auc_sql('SELECT * FROM (' + _TWO + ') WHERE y_ext IS NOT NULL', 'backbone, city')}) a JOIN ({_auc_sql('SELECT * FROM (' + _TWO + ') WHERE y_ext IS NOT NULL', 'backbone, city', y='y_ext')}) b USING (backbone, city) JOIN (SELECT backbone, city, count(*) AS n FROM ({_TWO}) WHERE y_ext IS NOT NULL GROUP BY backbone, city) c USING (backbone, city) WHERE n >= {LEAST_SHARED}")
def two_reference_auroc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Areas against two sources of labels over the rows that have both; runs with few of them are left out."""
    rows, by = metrics.finite(_two(spark, sf_dir), "y_ext"), ["backbone", "city"]
    own, ext = metrics.auroc(rows, by, "y_bin", "score", name="own"), metrics.auroc(rows, by, "y_ext", "score", name="ext")
    sizes = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= LEAST_SHARED)
    return own.join(ext, by).join(sizes, by).withColumn("delta", F.col("ext") - F.col("own"))


@query(
    "label_ceiling",
    "step:i kappa:f ceiling:f",
    """SELECT step, kappa, 5e-1 * (1 + b / ps - (po - b) / (1 - ps)) AS ceiling FROM (SELECT *, greatest(least((kappa * (1 - pe) + pe - 1 + po + ps) / 2, least(po, ps)), greatest(po + ps - 1, 0)) AS b
    FROM (SELECT step, step / 2e1 AS kappa, po, ps, po * ps + (1 - po) * (1 - ps) AS pe FROM (SELECT avg(CAST(rater_a AS DOUBLE)) AS po, avg(CAST(rater_b AS DOUBLE)) AS ps FROM fx_annotators), range(0, 21) q(step)))""",
)
def label_ceiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ceiling at each kappa from 0 to 1."""
    shares = load(spark, sf_dir, "fx_annotators").agg(F.avg("rater_a").alias("po"), F.avg("rater_b").alias("ps"))
    curve = shares.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(20)))).withColumn("kappa", F.col("step") / 20)
    return curve.select("step", "kappa", metrics.ceiling_auroc(F.col("kappa"), F.col("po"), F.col("ps")).alias("ceiling"))


@query(
    "ceiling_verdict",
    "city n:i kappa:f ceiling:f model:f over:i",
    f"""WITH t AS (SELECT DISTINCT city, point_id, y_ext AS a, y_bin AS b FROM ({_TWO}) WHERE y_ext IS NOT NULL), m AS (SELECT city, count(*) AS n, avg(CAST(b AS DOUBLE)) AS po, avg(CAST(a AS DOUBLE)) AS ps, avg(CASE WHEN a = b THEN 1e0 ELSE 0e0 END) AS same FROM t GROUP BY city),
    k AS (SELECT *, po * ps + (1 - po) * (1 - ps) AS pe, (same - (po * ps + (1 - po) * (1 - ps))) / (1 - (po * ps + (1 - po) * (1 - ps))) AS kappa FROM m WHERE n >= 30 AND po > 0 AND po < 1 AND ps > 0 AND ps < 1),
    c AS (SELECT city, n, kappa, 5e-1 * (1 + b / ps - (po - b) / (1 - ps)) AS ceiling FROM (SELECT *, greatest(least((kappa * (1 - pe) + pe - 1 + po + ps) / 2, least(po, ps)), greatest(po + ps - 1, 0)) AS b FROM k)),
    a AS (SELECT city, avg(x) AS model FROM (SELECT backbone, city, avg(auroc) AS x FROM ({_auc_sql(_P, _BY)}) GROUP BY backbone, city) GROUP BY city) SELECT *, CASE WHEN model > ceiling + {OVER_CEILING}e0 THEN 1 ELSE 0 END AS over FROM c JOIN a USING (city)""",
)
def ceiling_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the models' areas are over the ceiling that the labels' agreement with an outside source allows."""
    labels = metrics.finite(_two(spark, sf_dir), "y_ext").select("city", "point_id", "y_bin", "y_ext").distinct()
    agreed = metrics.agreement(metrics.confusion(labels, ["city"], "y_bin", "y_ext")).filter("kappa IS NOT NULL")
    ceiling = metrics.ceiling_auroc(F.col("kappa"), F.col("prevalence_a"), F.col("prevalence_b"))
    agreed = agreed.select("city", (F.col("n11") + F.col("n10") + F.col("n01") + F.col("n00")).alias("n"), "kappa", ceiling.alias("ceiling"))
    each = metrics.auroc(_rows(spark, sf_dir), RUN, "y_bin", "score").groupBy("backbone", "city").agg(F.avg("auroc").alias("x"))
    model = each.groupBy("city").agg(F.avg("x").alias("model"))
    return agreed.join(model, "city").withColumn("over", (F.col("model") > F.col("ceiling") + OVER_CEILING).cast("int"))


@query("target_version_delta", "backbone seed:i city rho_v1:f rho_v2:f delta:f", f"SELECT backbone, seed, city, a.rho AS rho_v1, b.rho AS rho_v2, b.rho - a.rho AS delta FROM (SELECT backbone, seed, city, corr(ra, rb) AS rho FROM ({_ranked('SELECT * FROM fx_predictions', _BY, 'y_reg', 'score')}) GROUP BY ALL) a JOIN (SELECT backbone, seed, city, corr(ra, rb) AS rho FROM ({_ranked('SELECT *, y_reg + 1e4 * (point_id % 7) AS y2 FROM fx_predictions', _BY, 'y2', 'score')}) GROUP BY ALL) b USING (backbone, seed, city)")
def target_version_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions against two versions of the target."""
    rows = _rows(spark, sf_dir).withColumn("y2", F.col("y_reg") + 1e4 * (F.col("point_id") % 7))
    both = metrics.spearman(rows, RUN, "y_reg", "score", name="rho_v1").join(metrics.spearman(rows, RUN, "y2", "score", name="rho_v2"), RUN)
    return both.withColumn("delta", F.col("rho_v2") - F.col("rho_v1"))


_CH = f"SELECT seed, city, backbone AS channel, y_ext AS a, CASE WHEN score >= 6e-1 THEN 1 ELSE 0 END AS b FROM ({_TWO}) WHERE y_ext IS NOT NULL"


@query("channel_calibration", "seed:i city channel n11:i n10:i n01:i n00:i precision:f recall:f f1:f accuracy:f", f"SELECT *, {_PRF} FROM (SELECT seed, coalesce(city, 'pooled') AS city, channel, {_CELLS} FROM ({_CH}) GROUP BY GROUPING SETS ((seed, city, channel), (seed, channel)))")
def channel_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = metrics.finite(_two(spark, sf_dir), "y_ext").withColumn("b", (F.col("score") >= 0.6).cast("int")).withColumnRenamed("backbone", "channel")
    cell = lambda i, j: F.count_if((F.col("y_ext") == i) & (F.col("b") == j)).alias(f"n{i}{j}")
    sets = rows.groupingSets([[F.col("seed"), F.col("city"), F.col("channel")], [F.col("seed"), F.col("channel")]], F.col("seed"), F.col("city"), F.col("channel")).agg(*(cell(i, j) for i in (1, 0) for j in (1, 0)))
    return metrics.threshold_metrics(sets.fillna("pooled", ["city"]))


@query("verdicts", "city mean:f std:f gain:f label_verdict best_backbone geo_verdict", f"""WITH a AS ({_auc_sql(_P, _BY)}), g AS (SELECT city, avg(CASE WHEN backbone = 'siglip' THEN auroc END) AS mean, stddev_pop(CASE WHEN backbone = 'siglip' THEN auroc END) AS std, avg(CASE WHEN backbone = 'siglip' THEN auroc END) - avg(CASE WHEN backbone = 'clip' THEN auroc END) AS gain, arg_max(backbone, auroc) AS best_backbone FROM a GROUP BY city)
    SELECT *, CASE WHEN mean >= 65e-2 AND gain >= 8e-2 THEN 'revive' WHEN gain >= 5e-2 THEN 'borderline' ELSE 'drop' END AS label_verdict, CASE WHEN gain > 3e-2 THEN 'imagery_better' WHEN gain < -3e-2 THEN 'geo_better' ELSE 'comparable' END AS geo_verdict FROM g""")
def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = metrics.auroc(_rows(spark, sf_dir), RUN, "y_bin", "score")
    of = lambda b: F.when(F.col("backbone") == b, F.col("auroc"))
    g = a.groupBy("city").agg(F.avg(of("siglip")).alias("mean"), F.stddev_pop(of("siglip")).alias("std"), (F.avg(of("siglip")) - F.avg(of("clip"))).alias("gain"), F.max_by("backbone", "auroc").alias("best_backbone"))
    label = F.when((F.col("mean") >= 0.65) & (F.col("gain") >= 0.08), "revive").when(F.col("gain") >= 0.05, "borderline").otherwise("drop")
    geo = F.when(F.col("gain") > 0.03, "imagery_better").when(F.col("gain") < -0.03, "geo_better").otherwise("comparable")
    return g.withColumns({"label_verdict": label, "geo_verdict": geo})


@query("ensemble_mean", "city point_id score:f n_seeds:i", "SELECT city, point_id, avg(score) AS score, count(*) AS n_seeds FROM fx_predictions WHERE NOT (backbone = 'clip' AND point_id % 9 = 0) GROUP BY city, point_id HAVING count(DISTINCT backbone) = 2")
def ensemble_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean over complete sets of backbones; points that one of them misses are left out."""
    rows = _rows(spark, sf_dir).filter("NOT (backbone = 'clip' AND point_id % 9 = 0)")
    return rows.groupBy("city", "point_id").agg(F.avg("score").alias("score"), F.count(F.lit(1)).alias("n_seeds"), F.count_distinct("backbone").alias("_b")).filter("_b = 2").drop("_b")


def _weighted(source: str, unit: str) -> str:
    """SQL: rows of ``source`` once for each replicate, with the weight w of their unit."""
    p = inference.PRIME
    weight = " + ".join(f"CAST(x >= {border} AS INT)" for border in inference.BORDERS)
    x0 = f"SELECT *, (u * {inference.OF_UNIT} + rep * {inference.OF_REPLICATE} + 12345) % {p} AS x0 FROM (SELECT *, (CAST({unit} AS BIGINT) % {p} + {p}) % {p} AS u FROM ({source})) CROSS JOIN range(0, {WHOLE}) q(rep)"
    x1 = f"SELECT *, (x0 * x0 + u) % {p} AS x1 FROM ({x0})"
    x2 = f"SELECT *, (x1 * x1 + rep) % {p} AS x2 FROM ({x1})"
    x3 = f"SELECT *, (x2 * x2 + x0) % {p} AS x FROM ({x2})"
    return f"SELECT *, CAST({weight} AS DOUBLE) AS w FROM ({x3})"


def _areas(source: str, by: str, unit: str, s: str = "score") -> str:
    """SQL: (by, rep, auroc) of all replicates."""
    return _auc_sql(_weighted(source, unit), f"{by}, rep", "w", "y_bin", s)


def _settled_sql(values: str, rows: str, by: str, value: str, least: int) -> str:
    """SQL of the interval with the rules on few rows and few known replicates."""
    many = f"k >= 30 AND n >= {least}"
    return f"""SELECT {by}, CASE WHEN {many} THEN l END AS lo, CASE WHEN {many} THEN h END AS hi, CASE WHEN k >= 30 THEN m END AS mean, CASE WHEN {many} THEN d END AS std, CASE WHEN k >= 30 THEN coalesce(n, 0) ELSE 0 END AS n, pv
    FROM (SELECT {by}, count(*) AS k FROM ({rows}) GROUP BY {by}) LEFT JOIN (SELECT {by}, quantile_cont({value}, 25e-3) AS l, quantile_cont({value}, 975e-3) AS h, avg({value}) AS m, stddev_samp({value}) AS d, count({value}) AS n,
    least(2 * least(avg(CASE WHEN {value} >= 0 THEN 1e0 WHEN {value} < 0 THEN 0e0 END), avg(CASE WHEN {value} <= 0 THEN 1e0 WHEN {value} > 0 THEN 0e0 END)), 1) AS pv FROM ({values}) GROUP BY {by}) USING ({by})"""


_POINT_CI = _settled_sql(_areas(_P, _BY, "point_id"), _P, _BY, "auroc", LEAST_POINTS)
_CI_COLUMNS = "backbone seed:i city lo:f hi:f mean:f std:f n:i"


def _settled_areas(rows: DataFrame, unit, least: int, shared: bool = False) -> DataFrame:
    reps = inference.bootstrap(rows, RUN, "y_bin", ["score"], unit, WHOLE, shared)
    return inference.settled_interval(reps, metrics.finite(rows, "y_bin", "score"), RUN, "m_score", least)


@query("bootstrap_ci_1000", _CI_COLUMNS, _POINT_CI)
def bootstrap_ci_1000(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interval of each run's area over drawn points."""
    return _settled_areas(_rows(spark, sf_dir), F.col("point_id"), LEAST_POINTS)


_WIDE = f"SELECT seed, city, point_id, max(y_bin) AS y_bin, max(CASE WHEN backbone = 'siglip' THEN score END) AS a, max(CASE WHEN backbone = 'clip' THEN score END) AS b FROM ({_P}) GROUP BY seed, city, point_id"


def _wide(spark, sf_dir):
    rows = metrics.finite(_rows(spark, sf_dir), "y_bin")
    pick = lambda b: F.max(F.when(F.col("backbone") == b, F.col("score")))
    return rows.groupBy("seed", "city", "point_id").agg(F.max("y_bin").alias("y_bin"), pick("siglip").alias("a"), pick("clip").alias("b"))


def _paired_sql(source: str, unit: str, least: int) -> str:
    by = "seed, city"
    gaps = f"SELECT seed, city, rep, x.auroc - z.auroc AS diff FROM ({_areas(source, by, unit, 'a')}) x JOIN ({_areas(source, by, unit, 'b')}) z USING (seed, city, rep)"
    return _settled_sql(gaps, source, by, "diff", least)


def _paired(rows: DataFrame, unit, least: int, shared: bool = False) -> DataFrame:
    by = ["seed", "city"]
    reps = inference.bootstrap(rows, by, "y_bin", ["a", "b"], unit, WHOLE, shared).withColumn("diff", F.col("m_a") - F.col("m_b")).filter("diff IS NOT NULL")
    found = inference.settled_interval(reps, metrics.finite(rows, "y_bin", "a", "b"), by, "diff", least)
    p = reps.groupBy(*by).agg(inference.paired_p(F.col("diff")).alias("p"))
    return found.join(p, by, "left")


@query("paired_bootstrap_1000", "seed:i city lo:f hi:f mean:f std:f n:i p:f", f"SELECT *, CASE WHEN lo IS NOT NULL THEN pv END AS p FROM ({_paired_sql(_WIDE, 'point_id', LEAST_POINTS)})")
def paired_bootstrap_1000(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Difference of two scores over drawn points."""
    return _paired(_wide(spark, sf_dir), F.col("point_id"), LEAST_POINTS).withColumn("p", F.when(F.col("lo").isNotNull(), F.col("p")))


_CELLS_SQL = "SELECT label_id AS point_id, CAST(floor(lon * 111320e0 * cos(radians(45e0)) / 1000) AS BIGINT) AS cx, CAST(floor(lat * 110540e0 / 1000) AS BIGINT) AS cy FROM fx_ext_labels"
_CELLED = f"SELECT p.*, cx, cy FROM ({_P}) p JOIN ({_CELLS_SQL}) e USING (point_id)"
#: Number of a cell; a point without a place is a cell of its own.
_CELL_UNIT = "cx * 200003 + cy"
_ALONE_UNIT = f"CASE WHEN cx IS NULL OR cy IS NULL THEN -1 - point_id ELSE {_CELL_UNIT} END"
_PAIRED_CELLED = f"SELECT p.*, cx, cy FROM ({_WIDE}) p LEFT JOIN ({_CELLS_SQL}) e USING (point_id)"


def _cells(spark, sf_dir):
    from ..functions.geo import block_cell

    x, y = block_cell(F.col("lat"), F.col("lon"), F.lit(45.0), 1000.0)
    return load(spark, sf_dir, "fx_ext_labels").select(F.col("label_id").alias("point_id"), x.cast("long").alias("cx"), y.cast("long").alias("cy"))


def _celled(spark, sf_dir):
    return metrics.finite(_rows(spark, sf_dir), "y_bin", "score").join(_cells(spark, sf_dir), "point_id")


_CELL_CI = _settled_sql(_areas(_CELLED, _BY, _CELL_UNIT), _CELLED, _BY, "auroc", LEAST_CELLS)


@query("block_bootstrap_1000", _CI_COLUMNS + " n_cells:i", f"SELECT * FROM ({_CELL_CI}) JOIN (SELECT {_BY}, count(DISTINCT {_CELL_UNIT}) AS n_cells FROM ({_CELLED}) GROUP BY {_BY}) USING ({_BY})")
def block_bootstrap_1000(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interval of each run's area over drawn cells."""
    rows = _celled(spark, sf_dir)
    cells = rows.groupBy(*RUN).agg(F.count_distinct("cx", "cy").alias("n_cells"))
    return _settled_areas(rows, F.expr(_CELL_UNIT), LEAST_CELLS, shared=True).join(cells, RUN)


@query("ci_width_ratio_1000", "backbone seed:i city width:f naive_width:f ratio:f", f"SELECT {_BY}, c.hi - c.lo AS width, p.hi - p.lo AS naive_width, (c.hi - c.lo) / nullif(p.hi - p.lo, 0) AS ratio FROM ({_CELL_CI}) c JOIN ({_POINT_CI}) p USING ({_BY})")
def ci_width_ratio_1000(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Width of the interval over cells by that over points."""
    width = lambda found, name: found.select(*RUN, (F.col("hi") - F.col("lo")).alias(name))
    both = width(_settled_areas(_celled(spark, sf_dir), F.expr(_CELL_UNIT), LEAST_CELLS, shared=True), "width").join(width(bootstrap_ci_1000(spark, sf_dir), "naive_width"), RUN)
    return both.withColumn("ratio", F.col("width") / F.nullif("naive_width", F.lit(0.0)))


_PAIRED_CELLS = f"SELECT *, CASE WHEN n > 0 THEN pv END AS p FROM ({_paired_sql(_PAIRED_CELLED, _ALONE_UNIT, LEAST_CELLS)})"


@query("paired_block_bootstrap_1000", "seed:i city lo:f hi:f mean:f std:f n:i p:f n_cells:i", f"SELECT * FROM ({_PAIRED_CELLS}) JOIN (SELECT seed, city, count(DISTINCT {_ALONE_UNIT}) AS n_cells FROM ({_PAIRED_CELLED}) GROUP BY seed, city) USING (seed, city)")
def paired_block_bootstrap_1000(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Difference of two scores over drawn cells; a point without a place is a cell of its own."""
    rows = metrics.finite(_wide(spark, sf_dir), "y_bin", "a", "b").join(_cells(spark, sf_dir), "point_id", "left")
    cells = rows.groupBy("seed", "city").agg(F.count_distinct(F.expr(_ALONE_UNIT)).alias("n_cells"))
    return _paired(rows, F.expr(_ALONE_UNIT), LEAST_CELLS, shared=True).withColumn("p", F.when(F.col("n") > 0, F.col("p"))).join(cells, ["seed", "city"])


@query("equivalence_verdict_1000", "seed:i city verdict", f"SELECT seed, city, CASE WHEN lo IS NULL OR hi IS NULL THEN 'inconclusive' WHEN lo > 2e-2 THEN 'better' WHEN hi < -2e-2 THEN 'worse' WHEN lo > -2e-2 AND hi < 2e-2 THEN 'equivalent' WHEN hi < 2e-2 THEN 'not_better' ELSE 'inconclusive' END AS verdict FROM ({_PAIRED_CELLS})")
def equivalence_verdict_1000(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the interval over cells; better and worse have to clear the margin."""
    found = paired_block_bootstrap_1000(spark, sf_dir)
    return found.select("seed", "city", inference.verdict(F.col("lo"), F.col("hi"), clear=0.02).alias("verdict"))


def _rank_sql(by: str, c: str) -> str:
    return f"rank() OVER (PARTITION BY {by} ORDER BY {c}) + (count(*) OVER (PARTITION BY {by}, {c}) - 1) / 2e0"


_DELONG = f"""WITH x AS ({_WIDE}), k AS (SELECT *, {_rank_sql("seed, city", "a")} AS za, {_rank_sql("seed, city", "b")} AS zb, {_rank_sql("seed, city, y_bin", "a")} AS ca, {_rank_sql("seed, city, y_bin", "b")} AS cb, sum(y_bin) OVER (PARTITION BY seed, city) AS m, sum(1 - y_bin) OVER (PARTITION BY seed, city) AS n FROM x),
  v AS (SELECT seed, city, y_bin, m, n, CASE WHEN y_bin = 1 THEN (za - ca) / n ELSE 1 - (za - ca) / m END AS va, CASE WHEN y_bin = 1 THEN (zb - cb) / n ELSE 1 - (zb - cb) / m END AS vb FROM k),
  g AS (SELECT seed, city, avg(CASE WHEN y_bin = 1 THEN va END) AS auc_a, avg(CASE WHEN y_bin = 1 THEN vb END) AS auc_b,
    (var_samp(CASE WHEN y_bin = 1 THEN va END) + var_samp(CASE WHEN y_bin = 1 THEN vb END) - 2 * covar_samp(CASE WHEN y_bin = 1 THEN va END, CASE WHEN y_bin = 1 THEN vb END)) / max(m)
    + (var_samp(CASE WHEN y_bin <> 1 THEN va END) + var_samp(CASE WHEN y_bin <> 1 THEN vb END) - 2 * covar_samp(CASE WHEN y_bin <> 1 THEN va END, CASE WHEN y_bin <> 1 THEN vb END)) / max(n) AS variance FROM v GROUP BY seed, city),
  h AS (SELECT *, CASE WHEN variance > 1e-15 THEN (auc_a - auc_b) / sqrt(variance) END AS z FROM g),
  t AS (SELECT *, 1 / (1 + 3275911e-7 * abs(z) / sqrt(2e0)) AS t FROM h),
  f AS (SELECT seed, city, auc_a, auc_b, variance, z, t * (254829592e-9 + t * (-284496736e-9 + t * (1421413741e-9 + t * (-1453152027e-9 + t * 1061405429e-9)))) * exp(-z * z / 2) AS p FROM t)"""


@query("delong_components", "seed:i city auc_a:f auc_b:f variance:f z:f p:f", _DELONG + " SELECT * FROM f")
def delong_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inference.delong(_wide(spark, sf_dir), ["seed", "city"], "y_bin", "a", "b")


_SEED_MEANS = f"SELECT 0 AS seed, city, point_id, max(y_bin) AS y_bin, round(avg(CASE WHEN backbone = 'siglip' THEN score END), 9) AS a, round(avg(CASE WHEN backbone = 'clip' THEN score END), 9) AS b FROM ({_P}) GROUP BY city, point_id"


@query(
    "headline_cells",
    "backbone city mean:f std:f n:i lo:f hi:f p:f cell",
    _DELONG.replace(_WIDE, _SEED_MEANS)
    + f""", s AS ({_auc_sql(_P, _BY)}), c AS (SELECT backbone, city, avg(auroc) AS mean, coalesce(stddev_samp(auroc), 0) AS std, count(auroc) AS n FROM s GROUP BY backbone, city), i AS (SELECT backbone, city, avg(lo) AS lo, avg(hi) AS hi FROM ({_POINT_CI}) GROUP BY backbone, city)
    SELECT c.*, lo, hi, CASE WHEN backbone <> 'siglip' THEN f.p END AS p, printf('%.3f', mean) || CASE WHEN n > 1 THEN ' ± ' || printf('%.3f', std) ELSE '' END || CASE WHEN lo IS NOT NULL THEN ' [' || printf('%.3f', lo) || ', ' || printf('%.3f', hi) || ']' ELSE '' END || CASE WHEN backbone <> 'siglip' AND f.p < 5e-2 THEN '*' ELSE '' END AS cell FROM c JOIN f USING (city) JOIN i USING (backbone, city)""",
)
def headline_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Area of each cell over its seeds, the mean of their intervals, and a star where the paired test against the frozen backbone has p below 0.05.

    Mean scores are rounded before they are ranked, so that equal means tie whatever the order of their sums.
    """
    rows = metrics.finite(_rows(spark, sf_dir), "y_bin")
    cells = metrics.auroc(rows, RUN, "y_bin", "score").groupBy("backbone", "city").agg(F.avg("auroc").alias("mean"), F.coalesce(F.stddev_samp("auroc"), F.lit(0.0)).alias("std"), F.count("auroc").alias("n"))
    pick = lambda b: F.round(F.avg(F.when(F.col("backbone") == b, F.col("score"))), 9)
    means = rows.groupBy("city", "point_id").agg(F.max("y_bin").alias("y_bin"), pick("siglip").alias("a"), pick("clip").alias("b"))
    tests = inference.delong(means, ["city"], "y_bin", "a", "b").select("city", "p")
    intervals = bootstrap_ci_1000(spark, sf_dir).groupBy("backbone", "city").agg(F.avg("lo").alias("lo"), F.avg("hi").alias("hi"))
    found = cells.join(tests, "city").join(intervals, ["backbone", "city"]).withColumn("p", F.when(F.col("backbone") != "siglip", F.col("p")))
    spread = F.when(F.col("n") > 1, F.format_string(" ± %.3f", "std")).otherwise("")
    return found.withColumn("cell", F.concat(F.format_string("%.3f", "mean"), spread, F.when(F.col("lo").isNotNull(), F.format_string(" [%.3f, %.3f]", "lo", "hi")).otherwise(""), F.when(F.col("p") < 0.05, "*").otherwise("")))


@query("holm", "seed:i city p:f p_holm:f", _DELONG + ", q AS (SELECT *, row_number() OVER (ORDER BY p, seed, city) - 1 AS k, count(*) OVER () AS m FROM f) SELECT seed, city, p, least(max((m - k) * p) OVER (ORDER BY k ROWS UNBOUNDED PRECEDING), 1) AS p_holm FROM q")
def holm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One family of all tests; a row for each run pair."""
    tests = inference.delong(_wide(spark, sf_dir), ["seed", "city"], "y_bin", "a", "b").select("seed", "city", "p")
    return inference.holm(tests, "p", ["seed", "city"])


_VALID = "SELECT backbone, seed, {c} AS city, count(*) AS n, corr(ra, rb) AS rho FROM ({r}) GROUP BY ALL"


@query(
    "construct_validity",
    "backbone seed:i city n:i rho:f t:f verdict",
    f"""SELECT *, CASE WHEN rho >= 5e-1 AND t > 196e-2 THEN 'FEATURE' ELSE 'DO_NOT_FEATURE' END AS verdict FROM (SELECT backbone, seed, city, n, rho, rho * sqrt((n - 2) / nullif(1 - rho * rho, 0)) AS t
    FROM ({_VALID.format(c="city", r=_ranked("SELECT * FROM fx_predictions", _BY, "y_reg", "score"))} UNION ALL {_VALID.format(c="'all'", r=_ranked("SELECT * FROM fx_predictions", "backbone, seed", "y_reg", "score"))})) WHERE n >= 10 OR city = 'all'""",
)
def construct_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlation of each run with an outside score, over all and in cities of ten rows and more; the test is by its t statistic."""
    rows = _rows(spark, sf_dir)
    rows = rows.unionByName(rows.withColumn("city", F.lit("all")))
    sizes = rows.groupBy(*RUN).agg(F.count(F.lit(1)).alias("n")).filter((F.col("n") >= 10) | (F.col("city") == "all"))
    found = metrics.spearman(rows, RUN, "y_reg", "score").join(sizes, RUN)
    found = found.withColumn("t", F.col("rho") * F.sqrt((F.col("n") - 2) / F.nullif(1 - F.col("rho") * F.col("rho"), F.lit(0.0))))
    return found.withColumn("verdict", F.when((F.col("rho") >= 0.5) & (F.col("t") > 1.96), "FEATURE").otherwise("DO_NOT_FEATURE"))


@query("seed_average", "backbone city auroc:f", _auc_sql(f"SELECT backbone, city, point_id, round(avg(score), 9) AS score, max(y_bin) AS y_bin FROM ({_P}) GROUP BY ALL", "backbone, city"))
def seed_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    mean = metrics.finite(_rows(spark, sf_dir), "y_bin").groupBy("backbone", "city", "point_id").agg(F.round(F.avg("score"), 9).alias("score"), F.max("y_bin").alias("y_bin"))
    return metrics.auroc(mean, ["backbone", "city"], "y_bin", "score")


@query("ladder_summary", "rung n_dirs:i mean:f std:f best:f n_high:i n_low:i", f"WITH a AS (SELECT backbone, city, avg(auroc) AS auroc FROM ({_auc_sql(_P, _BY)}) GROUP BY backbone, city) SELECT CASE WHEN backbone LIKE 'siglip%' THEN 'siglip' ELSE 'clip' END AS rung, count(*) AS n_dirs, avg(auroc) AS mean, stddev_samp(auroc) AS std, max(auroc) AS best, count(CASE WHEN auroc >= 6e-1 THEN 1 END) AS n_high, count(CASE WHEN auroc < 6e-1 THEN 1 END) AS n_low FROM a GROUP BY 1")
def ladder_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seeds, then directions; verdict counts as columns."""
    a = metrics.auroc(_rows(spark, sf_dir), RUN, "y_bin", "score").groupBy("backbone", "city").agg(F.avg("auroc").alias("auroc"))
    a = a.withColumn("rung", inference.rung(F.col("backbone"))).withColumn("band", F.when(F.col("auroc") >= 0.6, "n_high").otherwise("n_low"))
    stats = a.groupBy("rung").agg(F.count(F.lit(1)).alias("n_dirs"), F.avg("auroc").alias("mean"), F.stddev_samp("auroc").alias("std"), F.max("auroc").alias("best"))
    counts = a.groupBy("rung").pivot("band", ["n_high", "n_low"]).count().fillna(0)
    return stats.join(counts, "rung")


_MEANS_CELLED = f"SELECT p.*, cx, cy FROM ({_SEED_MEANS}) p LEFT JOIN ({_CELLS_SQL}) e USING (point_id)"
_OF_SEEDS = f"SELECT backbone, city, point_id, round(avg(score), 9) AS score, max(y_bin) AS y_bin FROM ({_P}) GROUP BY ALL"
_BLOCK = "CASE WHEN city = 'pittsburgh' THEN 'pittsburgh' ELSE 'loco' END"


@query(
    "ladder_report",
    "block rung n_directions:i mean:f std:f best:f mean_ensemble:f delta_mean:f delta_min:f delta_max:f n_better:i n_worse:i n_equivalent:i n_not_better:i n_inconclusive:i n_clear:i overall",
    _DELONG.replace(_WIDE, _SEED_MEANS)
    + f""", s AS (SELECT backbone, city, avg(auroc) AS seed_mean FROM ({_auc_sql(_P, _BY)}) GROUP BY backbone, city), e AS (SELECT backbone, city, auroc AS ensemble FROM ({_auc_sql(_OF_SEEDS, "backbone, city")})),
    d AS (SELECT {_BLOCK} AS block, backbone AS rung, count(*) AS n_directions, avg(seed_mean) AS mean, coalesce(stddev_samp(seed_mean), 0) AS std, max(seed_mean) AS best, avg(ensemble) AS mean_ensemble FROM s JOIN e USING (backbone, city) GROUP BY 1, 2),
    q AS (SELECT city, p, row_number() OVER (ORDER BY p, city) - 1 AS k, count(*) OVER () AS m FROM f WHERE p IS NOT NULL), w AS (SELECT city, least(max((m - k) * p) OVER (ORDER BY k ROWS UNBOUNDED PRECEDING), 1) AS p_holm FROM q),
    i AS (SELECT city, CASE WHEN lo IS NULL OR hi IS NULL THEN 'inconclusive' WHEN lo > 2e-2 THEN 'better' WHEN hi < -2e-2 THEN 'worse' WHEN lo > -2e-2 AND hi < 2e-2 THEN 'equivalent' WHEN hi < 2e-2 THEN 'not_better' ELSE 'inconclusive' END AS verdict FROM ({_paired_sql(_MEANS_CELLED, _ALONE_UNIT, LEAST_CELLS)})),
    r AS (SELECT {_BLOCK} AS block, 'siglip' AS rung, avg(auc_a - auc_b) AS delta_mean, min(auc_a - auc_b) AS delta_min, max(auc_a - auc_b) AS delta_max, {", ".join(f"count(CASE WHEN verdict = '{v}' THEN 1 END) AS n_{v}" for v in reports.VERDICTS)}, count(CASE WHEN p_holm < 5e-2 AND auc_a > auc_b THEN 1 END) AS n_clear FROM f JOIN i USING (city) LEFT JOIN w USING (city) GROUP BY 1)
    SELECT d.*, delta_mean, delta_min, delta_max, n_better, n_worse, n_equivalent, n_not_better, n_inconclusive, n_clear, CASE WHEN n_better > 0 THEN 'mixed' WHEN n_inconclusive = 0 AND n_not_better + n_equivalent + n_worse > 0 THEN 'not_better' WHEN n_not_better + n_equivalent + n_worse > 0 THEN 'not_better_with_inconclusive' WHEN n_better IS NOT NULL THEN 'inconclusive' END AS overall
    FROM d LEFT JOIN r USING (block, rung)""",
)
def ladder_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rungs by block of directions: seeds' means, ensembles of seeds, and gaps to the baseline with their verdicts over cells.

    Every city is scored by a model of another city, the last one by a model of the three others.
    """
    source = F.create_map(*map(F.lit, ("msp", "seattle", "seattle", "dc", "dc", "msp", "pittsburgh", "dc+msp+seattle")))[F.col("city")]
    block, key = reports.direction_block(source, F.col("city")).alias("block"), ["backbone", "city"]
    rows = metrics.finite(_rows(spark, sf_dir), "y_bin", "score")
    seeds = metrics.auroc(rows, RUN, "y_bin", "score").groupBy(*key).agg(F.avg("auroc").alias("seed_mean"))
    directions = seeds.join(seed_average(spark, sf_dir).withColumnRenamed("auroc", "ensemble"), key).select(block, F.col("backbone").alias("rung"), "seed_mean", "ensemble")
    pick = lambda b: F.round(F.avg(F.when(F.col("backbone") == b, F.col("score"))), 9)
    means = rows.groupBy("city", "point_id").agg(F.lit(0).alias("seed"), F.max("y_bin").alias("y_bin"), pick("siglip").alias("a"), pick("clip").alias("b"))
    tests = inference.delong(means, ["city"], "y_bin", "a", "b").select("city", (F.col("auc_a") - F.col("auc_b")).alias("delta"), "p")
    tests = inference.holm(tests, "p", ["city"])
    cells = metrics.finite(means, "a", "b").join(_cells(spark, sf_dir), "point_id", "left")
    said = _paired(cells, F.expr(_ALONE_UNIT), LEAST_CELLS, shared=True).select("city", inference.verdict(F.col("lo"), F.col("hi"), clear=0.02).alias("verdict"))
    paired = tests.join(said, "city").select(block, F.lit("siglip").alias("rung"), "delta", "verdict", "p_holm")
    return reports.ladder(directions, paired, ["block", "rung"])


@query("qcut_bins", "backbone bin:i n:i lo:f hi:f", "SELECT p.backbone, CASE WHEN y_reg <= q1 THEN 0 WHEN y_reg <= q2 THEN 1 WHEN y_reg <= q3 THEN 2 ELSE 3 END AS bin, count(*) AS n, min(y_reg) AS lo, max(y_reg) AS hi FROM fx_predictions p JOIN (SELECT backbone, quantile_cont(y_reg, 25e-2) AS q1, quantile_cont(y_reg, 5e-1) AS q2, quantile_cont(y_reg, 75e-2) AS q3 FROM fx_predictions GROUP BY backbone) q ON q.backbone = p.backbone GROUP BY ALL")
def qcut_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = _rows(spark, sf_dir).groupBy("backbone", "y_reg").agg(F.count(F.lit(1)).alias("m"))
    cuts = metrics.quantiles(counts, ["backbone"], "y_reg", "m", [0.25, 0.5, 0.75])
    y = F.col("y_reg")
    bin_ = F.when(y <= F.col("q")[0], 0).when(y <= F.col("q")[1], 1).when(y <= F.col("q")[2], 2).otherwise(3)
    return counts.join(cuts, "backbone", "left").groupBy("backbone", bin_.alias("bin")).agg(F.sum("m").alias("n"), F.min("y_reg").alias("lo"), F.max("y_reg").alias("hi"))


_H = "(point_id * 7919 + 104729) % 1000003"


@query("stratified_split", "city y_bin:i part n:i", f"WITH r AS (SELECT city, y_bin, row_number() OVER (PARTITION BY city, y_bin ORDER BY {_H}, point_id) AS k, count(*) OVER (PARTITION BY city, y_bin) AS n FROM ({_P}) WHERE backbone = 'clip' AND seed = 41) SELECT city, y_bin, CASE WHEN k <= greatest(round(n * 8e-1), 1) THEN 'train' WHEN k <= greatest(round(n * 9e-1), 2) THEN 'val' ELSE 'test' END AS part, count(*) AS n FROM r GROUP BY ALL")
def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points (one run's rows) in a seeded order, parted 80/10/10 inside each city and label."""
    points = metrics.finite(_rows(spark, sf_dir).filter("backbone = 'clip' AND seed = 41"), "y_bin")
    r = reports.placed(points, ["city", "y_bin"], F.floor(F.expr(_H) / 1000), [F.expr(_H), "point_id"], "k", "n")
    part = F.when(F.col("k") <= F.greatest(F.round(F.col("n") * 0.8), F.lit(1)), "train").when(F.col("k") <= F.greatest(F.round(F.col("n") * 0.9), F.lit(2)), "val").otherwise("test")
    return r.groupBy("city", "y_bin", part.alias("part")).agg(F.count(F.lit(1)).alias("n"))


@query("stratified_sample", "city point_id", f"SELECT city, point_id FROM (SELECT city, point_id, row_number() OVER (PARTITION BY city ORDER BY {_H}, point_id) AS k FROM fx_points) WHERE k <= 25")
def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sample of equal size from each city, by seeded order."""
    k = F.row_number().over(Window.partitionBy("city").orderBy(F.expr(_H), "point_id"))
    return load(spark, sf_dir, "fx_points").select("city", "point_id").withColumn("k", k).filter("k <= 25").drop("k")


@query("case_picks", "city kind point_id:i err:f", "WITH e AS (SELECT city, point_id, round(abs(avg(score) - max(y_reg) / 3e5), 9) + 1e-9 AS err FROM fx_predictions GROUP BY city, point_id), r AS (SELECT *, row_number() OVER (PARTITION BY city ORDER BY err, point_id) AS a, row_number() OVER (PARTITION BY city ORDER BY err DESC, point_id) AS z, count(*) OVER (PARTITION BY city) AS n FROM e) SELECT city, CASE WHEN a = 1 THEN 'tightest' WHEN z = 1 THEN 'worst' ELSE 'middle' END AS kind, point_id, err FROM r WHERE a = 1 OR z = 1 OR a = floor(n / 2e0) + 1")
def case_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean prediction of each point against its value: tightest, worst and middle case of each city.

    Errors are decimals: rounded before they are ranked, and nudged so that a half in the last digit shown goes one way.
    """
    e = _rows(spark, sf_dir).groupBy("city", "point_id").agg((F.round(F.abs(F.avg("score") - F.max("y_reg") / 3e5), 9) + 1e-9).alias("err"))
    step = metrics.number_step(F.col("err"))
    r = reports.placed(e, ["city"], step, ["err", "point_id"], "a", "n")
    r = reports.placed(r, ["city"], -step, [F.desc("err"), "point_id"], "z", "n_").drop("n_")
    kind = F.when(F.col("a") == 1, "tightest").when(F.col("z") == 1, "worst").when(F.col("a") == F.floor(F.col("n") / 2) + 1, "middle")
    return r.withColumn("kind", kind).filter("kind IS NOT NULL").select("city", "kind", "point_id", "err")
