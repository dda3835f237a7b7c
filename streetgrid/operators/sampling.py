"""Draws in a seeded order that stop early, and draws that go round over strata."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Steps that a seeded order is cut into; a window holds one step of one group.
STEPS = 1024


def first_in_order(rows: DataFrame, by: str, order: str, ties: list[str], limit: int, span: int) -> DataFrame:
    """The first ``limit`` rows of each ``by`` in order of ``order`` (0 to ``span`` - 1) and ``ties``.

    Steps of the order are counted first; steps beyond the one where the limit is reached are not looked at again, and only
    that step is ranked. No window holds a whole group.
    """
    stepped = rows.withColumn("_step", F.floor(F.col(order) * STEPS / span))
    counts = stepped.groupBy(by, "_step").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(by).orderBy("_step").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_n")
    reached = counts.withColumn("_before", before).filter(F.col("_before") < limit)
    found = stepped.join(reached, [by, "_step"])
    whole = found.filter(F.col("_before") + F.col("_n") <= limit)
    last = found.filter(F.col("_before") + F.col("_n") > limit)
    last = last.withColumn("_k", F.row_number().over(Window.partitionBy(by, "_step").orderBy(order, *ties))).filter(F.col("_k") <= limit - F.col("_before"))
    return whole.drop("_n", "_before", "_step").unionByName(last.drop("_n", "_before", "_step", "_k"))


def round_robin(rows: DataFrame, by: str, strata: list[str], order: list[str], limit: int) -> DataFrame:
    """``limit`` rows of each ``by``, drawn round by round over its strata; ``round_`` tells the round.

    For draws that are small already (``first_in_order`` before): ranks of a group are one window.
    """
    rounds = rows.withColumn("round_", F.row_number().over(Window.partitionBy(by, *strata).orderBy(*order)))
    picked = rounds.withColumn("_pick", F.row_number().over(Window.partitionBy(by).orderBy("round_", *strata)))
    return picked.filter(F.col("_pick") <= limit).drop("_pick")
