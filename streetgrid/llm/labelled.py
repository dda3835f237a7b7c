"""Bounded samples of labelled rows to fit classifiers on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(doc_id: Column) -> Column:
    """The rows whose labels are never learned: crc32 of the id as text, modulo 3, is 1. Null ids are."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(True))


def learnable(labels: DataFrame, label: str) -> DataFrame:
    """doc_id and _y of the rows that may be learned; a document labelled more than once counts with the largest label."""
    known = labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    return known.groupBy("doc_id").agg(F.max(label).cast("int").alias("_y"))


def first_of_each(docs: DataFrame, ids: DataFrame, columns: list[str]) -> DataFrame:
    """One row for each of few ``ids`` (doc_id and more) that is there: where an id repeats, the least by a hash of its columns."""
    found = docs.select("doc_id", *columns).join(F.broadcast(ids), "doc_id")
    least = found.groupBy(*ids.columns).agg(F.min(F.struct(F.xxhash64(*columns).alias("_h"), *columns)).alias("_r"))
    return least.select(*ids.columns, *(F.col(f"_r.{c}").alias(c) for c in columns))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, columns: list[str]) -> DataFrame:
    """Up to ``per_class`` labelled documents of each class outside the held-out third, the first in hash order.

    Gives doc_id, _y and ``columns``. Labels that are null or whose document is not there are left out. The chosen ids are
    two times ``per_class`` at most, so the texts are found by a broadcast join.
    """
    known = learnable(labels, label).withColumn("_o", F.xxhash64("doc_id"))
    chosen = [known.filter(F.col("_y") == y).orderBy("_o", "doc_id").limit(per_class) for y in (0, 1)]
    return first_of_each(docs, chosen[0].unionByName(chosen[1]).select("doc_id", "_y"), columns)
