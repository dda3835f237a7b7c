"""Walk graphs: degrees, bounded shortest paths and features of what is near along the network."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import cut
from . import near


def degrees(edges: DataFrame, least: int = 3) -> DataFrame:
    """(node, degree, is_intersection): ends of edges, parallel ones and loops counted, whatever the direction."""
    ends = edges.select(F.explode(F.array("u", "v")).alias("node"))
    return ends.groupBy("node").agg(F.count(F.lit(1)).alias("degree")).withColumn("is_intersection", (F.col("degree") >= least).cast("int"))


def bounded_paths(edges: DataFrame, sources: DataFrame, cutoff: float) -> DataFrame:
    """(source, node, dist): shortest paths of at most ``cutoff`` from each source, itself (0) included.

    Frontiers are joined with edges; only paths that are shorter than before go on. Each round's result is written to the
    checkpoint folder.
    """
    near = edges.groupBy("u", "v").agg(F.min("length").alias("length")).filter(F.col("length") <= cutoff)
    best = sources.select(F.col("node").alias("source"), "node", F.lit(0.0).alias("dist")).distinct()
    frontier = best
    while True:
        steps = frontier.join(near, frontier["node"] == near["u"]).select("source", F.col("v").alias("node"), (F.col("dist") + F.col("length")).alias("new"))
        steps = steps.filter(F.col("new") <= cutoff).groupBy("source", "node").agg(F.min("new").alias("new"))
        merged = best.join(steps, ["source", "node"], "full").select("source", "node", F.least("dist", "new").alias("dist"), (F.col("new").isNotNull() & (F.col("dist").isNull() | (F.col("new") < F.col("dist")))).alias("better"))
        merged = cut(merged)
        best, frontier = merged.select("source", "node", "dist"), merged.filter("better").select("source", "node", "dist")
        if frontier.isEmpty():
            return best


def network_features(paths: DataFrame, values: DataFrame, k: int, columns: list[str], cutoff: float) -> DataFrame:
    """Per source: mean of ``columns`` over its ``k`` nearest other nodes with values, weighted by 1 / max(dist, 1).

    Sources without such nodes have their own values, count 0 and the cutoff as distance. ``values`` has node and columns.
    """
    others = paths.filter("node <> source").join(values, "node")
    rank = F.row_number().over(Window.partitionBy("source").orderBy("dist", "node"))
    top = others.withColumn("r", rank).filter(F.col("r") <= k)
    w = 1.0 / F.greatest(F.col("dist"), F.lit(1.0))
    found = top.groupBy(F.col("source").alias("node")).agg(F.count(F.lit(1)).alias("n_near"), F.avg("dist").alias("mean_dist"), *((F.sum(w * F.col(c)) / F.sum(w)).alias("near_" + c) for c in columns))
    out = values.join(found, "node", "left")
    return out.select("node", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.coalesce("mean_dist", F.lit(cutoff)).alias("mean_dist"), *(F.coalesce("near_" + c, c).alias("near_" + c) for c in columns))


def anchored(points: DataFrame, nodes: DataFrame, by: str = "city", node_id: str = "osmid") -> DataFrame:
    """Points with the graph node they stand for: ``node``, ``fallback`` (1 where it is the nearest one) and ``unanchored``.

    A point whose own node is in the graph keeps it. Others take the nearest node (ties: the smaller one) of their ``by``;
    those without coordinates, or whose ``by`` has no node with coordinates, have none. ``points``: by, point_id, node id,
    lat, lon; ``nodes``: by, node, lat, lon (null for nodes without a place).
    """
    known = nodes.select(F.col("node").alias("_node")).distinct()
    found = points.join(known, points[node_id] == F.col("_node"), "left")
    away = found.filter("_node IS NULL AND lat IS NOT NULL AND lon IS NOT NULL").select(by, "point_id", "lat", "lon")
    placed = nodes.filter("lat IS NOT NULL AND lon IS NOT NULL").select(by, F.col("node").alias("point_id"), "lat", "lon")
    nearest = near.knn(away, 1, by=by, others=placed).select(by, "point_id", F.col("neighbour").alias("_near"))
    out = found.join(nearest, [by, "point_id"], "left").withColumn("node", F.coalesce("_node", "_near"))
    return out.withColumns({"fallback": (F.col("_node").isNull() & F.col("_near").isNotNull()).cast("int"), "unanchored": F.col("node").isNull().cast("int")}).drop("_node", "_near")


def anchored_features(points: DataFrame, edges: DataFrame, values: DataFrame, key: list[str], columns: list[str], k: int, cutoff: float, node_id: str = "osmid") -> DataFrame:
    """Features of every point of ``anchored`` from what lies near along the network.

    Neighbours are the other points' nodes within ``cutoff`` of a point's node: their number, mean and largest distance of
    the ``k`` nearest (ties: smaller node), and means of ``columns`` (of ``values``: key, columns) weighted by
    1 / max(dist, 1). Points without neighbours, or without a node, have their own values, count 0 and the cutoff as distance.
    """
    paths = bounded_paths(edges, points.filter("node IS NOT NULL").select("node").distinct(), cutoff).filter("node <> source")
    others = points.select(*(F.col(c).alias("_o_" + c) for c in key), F.col(node_id).alias("node")).join(values.select(*(F.col(c).alias("_o_" + c) for c in key), *columns), ["_o_" + c for c in key])
    reached = points.select(*key, F.col("node").alias("source")).join(paths, "source").join(others, "node")
    same = F.lit(True)
    for c in key:
        same = same & (F.col(c) == F.col("_o_" + c))
    ranked = reached.filter(~same).withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy("dist", "node")))
    top = lambda c: F.when(F.col("_r") <= k, c)
    w = 1.0 / F.greatest(F.col("dist"), F.lit(1.0))
    found = ranked.groupBy(*key).agg(F.count(F.lit(1)).alias("n_near"), F.avg(top(F.col("dist"))).alias("mean_dist"), F.max(top(F.col("dist"))).alias("max_dist"), *((F.sum(top(w * F.col(c))) / F.sum(top(w))).alias("near_" + c) for c in columns))
    out = points.join(values, key).join(found, key, "left")
    far = {c: F.coalesce(c, F.lit(cutoff)) for c in ("mean_dist", "max_dist")}
    return out.select(*key, "fallback", "unanchored", F.coalesce("n_near", F.lit(0)).alias("n_near"), *(v.alias(c) for c, v in far.items()), *(F.coalesce("near_" + c, c).alias("near_" + c) for c in columns))
