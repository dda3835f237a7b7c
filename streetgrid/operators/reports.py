"""Report tables: roll-ups, correlations with several columns, comparisons of sources, verdicts, splits by rank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import metrics


def group_rollup(df: DataFrame, by: list[str], group: str, y: str, score: str) -> DataFrame:
    """R² and r of each group's mean score against its label (the largest one); null with fewer than two groups."""
    groups = df.groupBy(*by, group).agg(F.avg(score).alias("p"), F.max(y).alias("t")).filter("p is not null and t is not null")
    out = groups.groupBy(*by).agg(F.count(F.lit(1)).alias("n_groups"), F.avg(F.pow(F.col("t") - F.col("p"), 2)).alias("mse"), F.var_pop("t").alias("v"), F.corr("p", "t").alias("r"))
    several = F.col("n_groups") >= 2
    return out.select(*by, "n_groups", F.when(several, 1 - F.col("mse") / F.nullif(F.col("v"), F.lit(0.0))).alias("r2"), F.when(several, F.col("r")).alias("r"))


def correlations(df: DataFrame, by: list[str], score: str, columns: list[str]) -> DataFrame:
    """Pearson's r of the score with each column over the rows where both are numbers; null for under 3 rows or a flat side."""
    long = df.select(*by, score, *(F.col(c).cast("double").alias(c) for c in columns)).unpivot([*by, score], columns, "target", "value")
    known = metrics.finite(long, score, "value")
    return known.groupBy(*by, "target").agg(F.count(F.lit(1)).alias("n")).join(metrics.pearson(known, [*by, "target"], score, "value"), [*by, "target"])


def compare_sources(df: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """Rank and linear correlation, mean absolute difference and means of two sources of one quantity."""
    rows = metrics.finite(df, a, b)
    plain = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.corr(a, b).alias("r"), F.avg(F.abs(F.col(a) - F.col(b))).alias("mae"), F.avg(a).alias("mean_a"), F.avg(b).alias("mean_b"))
    return metrics.spearman(rows, by, a, b).join(plain, by)


def overall_verdict(df: DataFrame, by: list[str], verdict: str) -> DataFrame:
    """One verdict from those of all directions."""
    n = lambda *names: F.sum(F.col(verdict).isin(*names).cast("long"))
    counts = df.groupBy(*by).agg(n("better").alias("n_better"), n("not_better", "equivalent", "worse").alias("n_not"), n("inconclusive").alias("n_open"))
    said = F.when(F.col("n_better") > 0, "mixed").when((F.col("n_open") == 0) & (F.col("n_not") > 0), "not_better").when(F.col("n_not") > 0, "not_better_with_inconclusive").otherwise("inconclusive")
    return counts.withColumn("overall", said)


#: Cities that models are trained in, the city that is kept for the end, and the verdicts on a direction. Fixed values.
TRAINED, HELD = ("msp", "seattle", "dc"), "pittsburgh"
VERDICTS = ("better", "worse", "equivalent", "not_better", "inconclusive")


def direction_block(source: Column, target: Column) -> Column:
    """Block of a direction: from one trained city to another, from all of them to the city kept for the end, else null."""
    one = source.isin(*TRAINED) & target.isin(*TRAINED) & (source != target)
    return F.when((target == HELD) & (source == "+".join(sorted(TRAINED))), HELD).when(one, "loco")


def ladder(directions: DataFrame, paired: DataFrame, by: list[str]) -> DataFrame:
    """Summary of each rung over its directions, and of its paired gaps to the baseline (null for rungs without any).

    ``directions``: by, seed_mean, ensemble, one row for each direction. ``paired``: by, delta, verdict, p_holm. The mean,
    deviation and best are of the seeds' means; a deviation of one direction is 0.
    """
    stats = directions.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_directions"), F.avg("seed_mean").alias("mean"), F.when(F.count("seed_mean") > 0, F.coalesce(F.stddev_samp("seed_mean"), F.lit(0.0))).alias("std"),
        F.max("seed_mean").alias("best"), F.avg("ensemble").alias("mean_ensemble"),
    )
    counts = [F.count_if(F.col("verdict") == v).alias("n_" + v) for v in VERDICTS]
    clear = F.count_if((F.col("p_holm") < 0.05) & (F.col("delta") > 0)).alias("n_clear")
    gaps = paired.groupBy(*by).agg(F.avg("delta").alias("delta_mean"), F.min("delta").alias("delta_min"), F.max("delta").alias("delta_max"), *counts, clear)
    said = overall_verdict(paired, by, "verdict").select(*by, "overall")
    return stats.join(gaps, by, "left").join(said, by, "left")


def nested_folds(records: DataFrame, by: list[str], order: list[str], target: str) -> DataFrame:
    """Mean and population deviation of a target's area over the folds of each group's latest record, beside its random split.

    A record has ``per_fold_results`` (array of structs with ``metrics``: target -> struct with auroc) and
    ``random_split_auroc``. Folds without the target or with no number are left out; a record without any has nulls.
    """
    last = records.groupBy(*by).agg(F.max_by(F.struct("per_fold_results", "random_split_auroc"), F.struct(*order)).alias("r"))
    areas = F.filter(F.transform("r.per_fold_results", lambda f: F.try_element_at(f["metrics"], F.lit(target))["auroc"]), lambda x: x.isNotNull() & ~F.isnan(x))
    each = last.select(*by, F.col("r.random_split_auroc").alias("random_split"), F.explode_outer(areas).alias("a"))
    return each.groupBy(*by).agg(F.count("a").alias("folds"), F.avg("a").alias("mean"), F.stddev_pop("a").alias("std"), F.max("random_split").alias("random_split"))


def fallback_rate(points: DataFrame, nodes: DataFrame, by: list[str], key: str) -> DataFrame:
    """How many points the graph's nodes lack; at 1 % and more a new graph is due. ``nodes`` has the key, each value once."""
    found = points.join(nodes.withColumn("there", F.lit(1)), key, "left").groupBy(*by).agg(F.count(F.lit(1)).alias("n_points"), F.count("there").alias("n_in_graph"))
    pct = 100.0 * (F.col("n_points") - F.col("n_in_graph")) / F.col("n_points")
    return found.withColumn("fallback_pct", pct).withColumn("rebuild", (pct >= 1.0).cast("int"))


def top_values(df: DataFrame, by: list[str], column: str, n: int) -> DataFrame:
    """The n most frequent values; ties go to the smaller value. Only counts are ranked."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(*by, column).agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), column))
    return counts.withColumn("place", place).filter(F.col("place") <= n)


def placed(df: DataFrame, by: list[str], step: Column, order: list, place: str, size: str) -> DataFrame:
    """Add each row's place in its group (from 1) and the group's size; ``step`` never falls along ``order``.

    Rows are counted by steps and ranked inside a step only, so no task gets a whole group. ``step`` must not be null.
    """
    rows = df.withColumn("_step", F.coalesce(step, F.lit(0)))
    steps = rows.groupBy(*by, "_step").agg(F.count(F.lit(1)).alias("_n"))
    all_ = Window.partitionBy(*by)
    upto = F.sum("_n").over(all_.orderBy("_step").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    steps = steps.select(*by, "_step", (upto - F.col("_n")).alias("_before"), F.sum("_n").over(all_).alias(size))
    rank = F.row_number().over(Window.partitionBy(*by, "_step").orderBy(*order))
    found = rows.withColumn("_rank", rank).join(steps, [*by, "_step"])
    return found.select(*df.columns, (F.col("_before") + F.col("_rank")).alias(place), size)


def split_share(df: DataFrame, by: list[str], order: Column, key: str, share: float, width: int) -> DataFrame:
    """Add ``is_train``: 1 for the first share (rounded half to even) of each group in the order, ties by key; steps are ``width`` wide."""
    rows = df.withColumn("_at", order)
    found = placed(rows, by, F.floor(F.col("_at") / width), ["_at", key], "_k", "_size")
    return found.select(*df.columns, (F.col("_k") <= F.bround(F.col("_size") * share)).cast("int").alias("is_train"))


def availability(df: DataFrame, by: list[str], value: str, kind: str, least: int) -> DataFrame:
    """Rows and kinds of each source, whether the rows are enough, and then the range of the value."""
    out = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(kind).alias("kinds"), F.min(value).alias("low"), F.max(value).alias("high"))
    enough = F.col("n") >= least
    return out.select(*by, "n", "kinds", enough.cast("int").alias("enough"), F.when(enough, F.col("low")).alias("low"), F.when(enough, F.col("high")).alias("high"))
