"""Connected components of a graph given as edges, by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut_clean, release

#: Graphs of so many edges at most are joined in one task: each step costs the driver a plan of its own, however few edges.
FEW = 1 << 16


def _joined(edges: DataFrame, by: list[str]) -> DataFrame:
    """(*by, node, component) for the ends of few edges (*by, u, v)."""
    schema = T.StructType([*(edges.schema[c] for c in by), T.StructField("node", edges.schema["u"].dataType), T.StructField("component", edges.schema["u"].dataType)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        above: dict[tuple, tuple] = {}
        types: list[pa.DataType] = []

        def top(a: tuple) -> tuple:
            while (b := above.setdefault(a, a)) != a:
                above[a] = a = above[b]
            return a

        for batch in batches:
            types = [c.type for c in batch.columns]
            for *graph, u, v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                a, b = top((*graph, u)), top((*graph, v))
                above[max(a, b)] = min(a, b)
        nodes = iter(list(above))
        while part := list(islice(nodes, 10_000)):
            rows = zip(*((*a, top(a)[-1]) for a in part), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, types, strict=True)], names=schema.names)
        above.clear()
        release()

    return edges.select(*by, "u", "v").coalesce(1).mapInArrow(run, schema)


def components(edges: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(*by, node, component) for every end of an edge (*by, u, v): the smallest node that can be reached.

    Edges may repeat, run either way and join a node to itself (such a node alone is its own component); those with a
    null end are left out. ``by`` names columns that keep graphs apart. Each step sends every edge once, so hubs cost what
    they have in edges, and the number of steps grows with the logarithm of the longest path. Up to ``FEW`` edges take none.
    """
    by = list(by)

    def each(df: DataFrame, *ends: tuple) -> DataFrame:
        """For every row, a row (*by, u, v) for each of some pairs of columns; null pairs give none."""
        pairs = F.array(*(F.struct(F.col(u).alias("u"), F.col(v).alias("v")) if only is None else F.when(only, F.struct(F.col(u).alias("u"), F.col(v).alias("v"))) for u, v, only in ends))
        return df.select(*by, F.explode(pairs).alias("_e")).filter("_e is not null").select(*by, "_e.u", "_e.v")

    def seen(df: DataFrame) -> tuple[DataFrame, dict]:
        """The rows, written, and what tells whether a step changed them, taken as they are written."""
        state = Observation()
        written = cut_clean(df.observe(state, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("sum"), F.count_if(F.col("u") == F.col("v")).alias("alone")))
        return written, state.get

    ends = edges.filter(F.col("u").isNotNull() & F.col("v").isNotNull())
    first, state = seen(ends.select(*by, F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    if state["n"] <= FEW:
        return _joined(first, by)
    now, loops, before = first.filter("u > v"), state["alone"], None
    while before != (before := state):
        both = each(now, ("u", "v", None), ("v", "u", None))
        least = both.groupBy(*by, "u").agg(F.least(F.min("v"), F.min("u")).alias("m"))
        # As many rows as edges: repeated ones go below.
        large = both.filter("v > u").join(least, [*by, "u"]).select(*by, F.col("v").alias("u"), F.col("m").alias("v"))
        low = large.groupBy(*by, "u").agg(F.min("v").alias("m"))
        now, state = seen(each(large.join(low, [*by, "u"]), ("u", "m", None), ("v", "m", F.col("v") > F.col("m"))).distinct())
    # The edges are stars now: each node hangs on the smallest one.
    nodes = each(now, ("u", "v", None), ("v", "v", None))
    if loops:
        nodes = nodes.union(first.filter("u = v"))
    return nodes.groupBy(*by, F.col("u").alias("node")).agg(F.min("v").alias("component"))
