"""Run-log analytics: latest runs, matrices, fallbacks and gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CELL = ["backbone", "train_city", "test_city", "ablation"]


def latest(log: DataFrame, cell: list[str] = CELL) -> DataFrame:
    """The latest run of each cell by timestamp, ties to the larger index; which run it was stays in the row."""
    best = F.max_by(F.struct(*[c for c in log.columns if c not in cell]), F.struct("ts", "run_index"))
    return log.groupBy(*cell).agg(best.alias("b")).select(*cell, "b.*")


def held_out_of(log: DataFrame) -> DataFrame:
    """``loco`` adapters only where they were held out for this test city, under one name; other runs as they are."""
    loco = F.col("backbone").startswith("siglip_lora_loco_")
    own = F.col("backbone") == F.concat(F.lit("siglip_lora_loco_"), F.col("test_city"))
    return log.filter(~loco | own).withColumn("backbone", F.when(loco, "siglip_lora_loco").otherwise(F.col("backbone")))


def first_choice(rows: DataFrame, by: list[str], choice: str, order: list[str]) -> DataFrame:
    """Of each group the row whose ``choice`` comes first in an order; ties go to the least of the other columns."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col(choice))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(place, *(c for c in rows.columns if c not in by)))
    return rows.filter(place > 0).withColumn("_r", rank).filter("_r = 1").drop("_r")


def matrix(rows: DataFrame, by: list[str], column: str, values: list[str], value: str) -> DataFrame:
    """One column for each of ``values``."""
    return rows.groupBy(*by).pivot(column, values).agg(F.first(value))


def best_in_column(value: str, by: list[str]) -> Column:
    """1 where a value is its column's best."""
    return (F.col(value) == F.max(value).over(Window.partitionBy(*by))).cast("int")


def grid(spark, backbones: list[str], cities: list[str], seeds: list[int]) -> DataFrame:
    """All runs of a design: backbone, two different cities, seed. The lists are short; one row is exploded by each."""
    each = lambda values: F.explode(F.array(*map(F.lit, values)))
    out = spark.range(1, numPartitions=1).select(each(backbones).alias("backbone"))
    for name, values in (("train_city", cities), ("test_city", cities), ("seed", seeds)):
        out = out.withColumn(name, each(values))
    return out.filter("train_city <> test_city")


def paired(rows: DataFrame, a: str, b: str, cell: list[str], backbone: str = "backbone") -> DataFrame:
    """Points that runs of two backbones both scored in a cell, by the first seed that each has there: y, score_a, score_b, seed_a, seed_b.

    A seed is chosen for a run as a whole, so a target that only one of the two runs has gives no pair. One shuffle brings both sides together.
    """
    rows = rows.filter(F.col(backbone).isin(a, b))
    first = rows.groupBy(*cell, backbone).agg(F.min("seed").alias("seed"))
    side = lambda name, c: F.max(F.when(F.col(backbone) == name, F.col(c)))
    both = rows.join(first, [*cell, backbone, "seed"], "left_semi").groupBy(*cell, "target", "point_id").agg(
        F.coalesce(side(a, "y"), side(b, "y")).alias("y"), side(a, "logit").alias("score_a"), side(b, "logit").alias("score_b"), side(a, "seed").alias("seed_a"), side(b, "seed").alias("seed_b"))
    return both.filter("score_a IS NOT NULL AND score_b IS NOT NULL")
