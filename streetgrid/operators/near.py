"""Joins by distance: cells first, then the exact predicate.

Points fall into cells a little wider than the radius; one side is repeated into its cell's eight neighbours, so an
equi-join on cells finds every pair once and nothing else is compared. Downtown cells are dealt out by adaptive skew
handling.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import METRES_LAT, METRES_LON, haversine_m, heading_error
from ..sources.shared import cut

#: Metres beyond which there is nothing on the globe.
HALF_ROUND = 2.1e7


def _band(lat: Column, radius: float) -> Column:
    """Band of latitude, a little higher than the radius."""
    return F.floor(lat / (radius * 1.02 / METRES_LAT))


def _cells_around(band: Column, radius: float) -> Column:
    """Cells around the globe in a band: the most that are wider than the radius in this band and those beside it."""
    far = F.least(F.greatest(F.abs(band - 1), F.abs(band + 2)) * F.lit(radius * 1.02 / METRES_LAT), F.lit(90.0))
    width = radius * 1.02 / METRES_LON
    return F.greatest(F.floor(F.lit(360.0) * F.greatest(F.cos(F.radians(far)), F.lit(0.0)) / width), F.lit(1)).cast("long")


def _cell(lon: Column, cells: Column) -> Column:
    return F.floor(F.pmod(lon + 180.0, F.lit(360.0)) / 360.0 * cells).cast("long")


def tasks(spark) -> int:
    """Tasks of a join by distance: it makes far more than it reads, so its number must not follow the small input."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)


def placed(left: DataFrame, right: DataFrame, radius: float, by: str = "city", left_at=("lat", "lon"), right_at=("lat", "lon"), prefix: str = "r_") -> tuple[DataFrame, DataFrame]:
    """Rows of the left with their cell (``_cx``, ``_cy``), and those of the right in their own cell and those beside it (``_by``, ``_rx``, ``_ry``)."""
    known = lambda df, at: df.filter(F.col(at[0]).isNotNull() & F.col(at[1]).isNotNull())
    a = known(left, left_at).withColumn("_cy", _band(F.col(left_at[0]), radius))
    a = a.withColumn("_cx", _cell(F.col(left_at[1]), _cells_around(F.col("_cy"), radius)))
    b = known(right, right_at).withColumn("_y", _band(F.col(right_at[0]), radius))
    b = b.withColumn("_ry", F.explode(F.array(*(F.col("_y") + j for j in (-1, 0, 1))))).withColumn("_n", _cells_around(F.col("_ry"), radius))
    around = F.array_distinct(F.array(*(F.pmod(_cell(F.col(right_at[1]), F.col("_n")) + i, F.col("_n")) for i in (-1, 0, 1))))
    b = b.withColumn("_rx", F.explode(around))
    return a, b.select(F.col(by).alias("_by"), "_rx", "_ry", *(F.col(c).alias(prefix + c) for c in right.columns))


def pairs_within(left: DataFrame, right: DataFrame, radius: float, by: str = "city", left_at=("lat", "lon"), right_at=("lat", "lon"), prefix: str = "r_") -> DataFrame:
    """All pairs of one ``by`` at most ``radius`` metres apart (inclusive), with ``dist``; right columns get ``prefix``.

    Rows without coordinates pair with nothing. Cells go round the globe in bands of latitude, as many in a band as are
    wider than the radius there, so pairs across the antimeridian and near the poles are found. Both sides are dealt out by cell:
    the repeated side, whose size Spark guesses too small, would be broadcast through the driver.
    """
    a, b = placed(left, right, radius, by, left_at, right_at, prefix)
    n = tasks(left.sparkSession)
    a, b = a.repartition(n, by, "_cx", "_cy"), b.repartition(n, "_by", "_rx", "_ry")
    joined = a.join(b.hint("merge"), (a[by] == b["_by"]) & (a["_cx"] == b["_rx"]) & (a["_cy"] == b["_ry"]))
    dist = haversine_m(F.col(left_at[0]), F.col(left_at[1]), F.col(prefix + right_at[0]), F.col(prefix + right_at[1]))
    return joined.withColumn("dist", dist).filter(F.col("dist") <= radius).drop("_cx", "_cy", "_rx", "_ry", "_by")


#: Metres of the cells in which crowding is measured.
CROWD = 100.0


def first_look(points: DataFrame, others: DataFrame, by: str, want: int, most: float) -> float:
    """Radius in which a point of ``points`` sees about ``want`` of the ``others`` where these are as crowded as around most points; ``most`` at most.

    It only decides where a search begins. Crowding is the mean number of others in a point's own cell.
    """

    def counted(df: DataFrame, name: str) -> DataFrame:
        band = _band(F.col("lat"), CROWD)
        cells = df.filter(F.col("lat").isNotNull() & F.col("lon").isNotNull()).select(by, band.alias("_y"), _cell(F.col("lon"), _cells_around(band, CROWD)).alias("_x"))
        return cells.groupBy(by, "_y", "_x").agg(F.count(F.lit(1)).alias(name))

    seen = counted(points, "_p").join(counted(others, "_o"), [by, "_y", "_x"], "left")
    mean = seen.agg(F.sum(F.col("_p") * F.coalesce("_o", F.lit(0))) / F.sum("_p")).first()[0]
    return min(most, max(CROWD * math.sqrt(want / (math.pi * mean)), 0.5)) if mean else most


def count_and_sum(points: DataFrame, features: DataFrame, key: list[str], radii: dict[str, float], value: str | None = None, right_at=("lat", "lon")) -> DataFrame:
    """For each point and named radius the number of features and the sum of ``value``; 0 where there is none."""
    from . import tiles

    some = features.select(key[0], F.col(right_at[0]).alias("lat"), F.col(right_at[1]).alias("lon"), *([F.col(value).cast("double").alias("value")] if value else []))

    def work(p: tiles.Arrays, f: tiles.Arrays) -> tiles.Arrays:
        ones = np.ones(len(f["lat"]))
        columns = np.column_stack([ones, np.nan_to_num(f["value"])] if value else [ones])
        found = {name: tiles.disc_sums(p, f, r, columns) for name, r in radii.items()}
        return {f"n_{name}": v[:, 0].astype(np.int64) for name, v in found.items()} | ({f"sum_{name}": v[:, 1] for name, v in found.items()} if value else {})

    out = ", ".join(f"n_{n} long" + (f", sum_{n} double" if value else "") for n in radii)
    return tiles.over_tiles(points, some, key, max(radii.values()), work, out, by=key[0])


def _kinds_within(points: DataFrame, features: DataFrame, key: list[str], radius: float, name: str) -> DataFrame:
    """The largest ``kind`` (a number from 0) of the features that are near each point, else null; those of the largest come first."""
    from . import tiles

    def hit(p: tiles.Arrays, f: tiles.Arrays) -> np.ndarray:
        return tiles.haversine(p["lat"][:, None], p["lon"][:, None], f["lat"][None, :], f["lon"][None, :]) <= radius

    def work(p: tiles.Arrays, f: tiles.Arrays) -> np.ndarray:
        order = np.argsort(-f["kind"], kind="stable")
        f = {c: v[order] for c, v in f.items()}
        found = tiles.first_hit(p, f, hit)
        return np.where(found >= 0, f["kind"][found], -1)

    found = tiles.over_tiles(points, features.select(key[0], "lat", "lon", "kind"), key, radius, tiles.per_block(work, lambda f: radius, name, -1), f"{name} long", by=key[0])
    return found.withColumn(name, F.when(F.col(name) >= 0, F.col(name).cast("int")))


def any_within(points: DataFrame, features: DataFrame, key: list[str], radius: float, name: str = "hit") -> DataFrame:
    """1 where a feature is near, else 0."""
    return _kinds_within(points, features.withColumn("kind", F.lit(1)), key, radius, name).fillna(0, [name])


def label_within(points: DataFrame, features: DataFrame, key: list[str], radius: float, kind: str, positive: list[str], negative: list[str], name: str = "label") -> DataFrame:
    """1 where a positive feature is near, else 0 where a negative one is, else null."""
    told = features.withColumn("kind", F.when(F.col(kind).isin(positive), 1).when(F.col(kind).isin(negative), 0))
    return _kinds_within(points, told.filter("kind IS NOT NULL"), key, radius, name)


def nearest_within(points: DataFrame, features: DataFrame, key: list[str], feature_id: str, radius: float) -> DataFrame:
    """The nearest feature of each point and its distance, ties to the smaller id; null beyond the radius.

    Rings begin where a point sees some four features; points that found one are done, the others look twice as far. Points are
    repeated into the cells around theirs, not the features, which may be many more.
    """
    by, at = key[0], ("lat", "lon")
    points, features = points.select(*dict.fromkeys([*key, *at])), features.select(by, feature_id, *at)
    r, todo, done = first_look(points, features, by, 4, radius), points, None
    while True:
        pairs = pairs_within(features, todo, r, by=by)
        ring = pairs.groupBy(*(F.col("r_" + c).alias(c) for c in key)).agg(F.min(F.struct("dist", F.col(feature_id).alias("id"))).alias("_b"))
        if r >= radius:
            done = ring if done is None else done.unionByName(ring)
            break
        ring = cut(ring)
        done = ring if done is None else done.unionByName(ring)
        todo, r = cut(todo.join(ring, key, "left_anti")), min(2 * r, radius)
        if todo.isEmpty():
            break
    return points.select(*key).join(done, key, "left").select(*key, F.col("_b.id").alias("nearest_id"), F.col("_b.dist").alias("dist"))


def best_views(points: DataFrame, images: DataFrame, key: list[str], headings: tuple[int, ...], radius: float, most_error: float, per_degree: float) -> DataFrame:
    """(*key, heading, image_id, dist, err): of the images within ``radius`` whose ``angle`` is at most ``most_error`` off, the least dist + ``per_degree`` * err.

    Ties go to the smaller id. A point is done when no image beyond the ring could be better for any heading; the others look twice as far.
    """
    by = key[0]
    points, images = points.select(*key, "lat", "lon"), images.select(by, "image_id", "lat", "lon", "angle")
    r, todo, done = min(first_look(points, images, by, 12, radius) + per_degree * most_error, radius), points, None
    while True:
        pairs = pairs_within(images, todo, r, by=by).withColumn("heading", F.explode(F.array(*map(F.lit, headings))))
        pairs = pairs.withColumn("err", heading_error(F.col("heading"), F.col("angle"))).filter(F.col("err") <= most_error)
        best = F.min(F.struct((F.col("dist") + per_degree * F.col("err")).alias("cost"), "image_id", "dist", "err")).alias("_b")
        ring = pairs.groupBy(*(F.col("r_" + c).alias(c) for c in key), "heading").agg(best)
        if r >= radius:
            done = ring if done is None else done.unionByName(ring)
            break
        ring = cut(ring)
        full = ring.filter(F.col("_b.cost") <= r).groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") == len(headings)).select(*key)
        part = ring.join(full, key, "left_semi")
        done = part if done is None else done.unionByName(part)
        todo, r = cut(todo.join(full, key, "left_anti")), min(2 * r, radius)
        if todo.isEmpty():
            break
    return done.select(*key, "heading", F.col("_b.image_id").alias("image_id"), "_b.dist", "_b.err")


def knn(points: DataFrame, k: int, point_id: str = "point_id", by: str = "city", first_radius: float = 300.0, others: DataFrame | None = None) -> DataFrame:
    """(by, point_id, neighbour, dist, rank): the ``k`` nearest others of each point, ties to the smaller id.

    Rings of cells, the first where a point sees some 2 k others (``first_radius`` at most): points with k others inside the radius are
    done, the rest look again in twice the radius, beyond ``first_radius`` in four times. Without ``others`` a point's own row is left out.
    """
    self_join = others is None
    others = (points if self_join else others).select(by, point_id, "lat", "lon")
    points = points.select(by, point_id, "lat", "lon")
    order = Window.partitionBy(by, point_id).orderBy("dist", "neighbour")
    # Points of a small group are done when they have found all others of it.
    sizes = others.groupBy(by).agg((F.count(F.lit(1)) - int(self_join)).alias("_all"))
    todo, done, radius = points.join(sizes, by).filter("_all > 0"), None, first_look(points, others, by, 2 * k, first_radius)
    while True:
        last = radius > HALF_ROUND
        pairs = pairs_within(todo, others, min(radius, HALF_ROUND))
        if self_join:
            pairs = pairs.filter(F.col(point_id) != F.col("r_" + point_id))
        ranked = pairs.select(by, point_id, "_all", F.col("r_" + point_id).alias("neighbour"), "dist").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        # Each ring is worked out once.
        ranked = cut(ranked)
        full = ranked.groupBy(by, point_id).agg(F.count(F.lit(1)).alias("n"), F.max("_all").alias("_all")).filter((F.col("n") >= k) | (F.col("n") >= F.col("_all")) | F.lit(last))
        part = ranked.join(full, [by, point_id], "left_semi").drop("_all")
        done = part if done is None else done.unionByName(part)
        if last:
            return done
        todo = cut(todo.join(full, [by, point_id], "left_anti"))
        if todo.isEmpty():
            return done
        radius *= 4 if radius >= first_radius else 2


def context_features(points: DataFrame, columns: list[str], k: int, radii: tuple[float, ...] = (200.0, 400.0, 800.0), mean_radius: float = 400.0, by: str = "city") -> DataFrame:
    """Features of every point (by, point_id, lat, lon, columns) from the others around it.

    Mean and largest distance of its ``k`` nearest, numbers of others within each radius, means of ``columns`` over the
    nearest, weighted by 1 / max(dist, 1), and their plain means within ``mean_radius`` (its own value where nobody is).
    A point without others has null distances and its own values.
    """
    key = [by, "point_id"]
    of = points.select(by, F.col("point_id").alias("neighbour"), *(F.col(c).alias("_o_" + c) for c in columns))
    w = 1.0 / F.greatest(F.col("dist"), F.lit(1.0))
    nearest = knn(points.select(*key, "lat", "lon"), k, by=by).join(of, [by, "neighbour"]).groupBy(*key)
    nearest = nearest.agg(F.avg("dist").alias("mean_dist"), F.max("dist").alias("max_dist"), *((F.sum(w * F.col("_o_" + c)) / F.sum(w)).alias("_w_" + c) for c in columns))
    own = {c: F.col(c).cast("double").alias(c) for c in columns}
    around = _sums_around(points.select(*key, "lat", "lon", *own.values()), columns, radii, mean_radius, key)
    out = points.join(nearest, key, "left").join(around, key, "left")
    numbers = [F.coalesce(f"n_{int(r)}m", F.lit(0)).alias(f"n_{int(r)}m") for r in radii]
    return out.select(*key, "mean_dist", "max_dist", *numbers, *(F.coalesce("_w_" + c, c).alias("near_" + c) for c in columns), *(F.coalesce("_m_" + c, c).alias("mean_" + c) for c in columns))


def _sums_around(points: DataFrame, columns: list[str], radii: tuple[float, ...], mean_radius: float, key: list[str]) -> DataFrame:
    """(*key, ``n_<radius>m``, ``_m_<column>``): numbers of others within each radius and means of columns within ``mean_radius`` (null without any)."""
    from . import tiles

    def work(p: tiles.Arrays, f: tiles.Arrays) -> tiles.Arrays:
        known = ~(np.isnan(p["lat"]) | np.isnan(p["lon"]))
        ones = np.ones((len(f["lat"]), 1))
        # A point is not among its others.
        found = {f"n_{int(r)}m": tiles.disc_sums(p, f, r, ones)[:, 0].astype(np.int64) - known for r in radii}
        there = lambda a: np.column_stack([v for c in columns for v in (np.nan_to_num(a[c]), (~np.isnan(a[c])).astype(float))])
        sums = tiles.disc_sums(p, f, mean_radius, there(f)) - there(p) * known[:, None]
        for i, c in enumerate(columns):
            n = np.round(sums[:, 2 * i + 1])
            found["_m_" + c] = np.where(n > 0, sums[:, 2 * i] / np.maximum(n, 1), np.nan)
        return found

    out = ", ".join([*(f"n_{int(r)}m long" for r in radii), *(f"_m_{c} double" for c in columns)])
    found = tiles.over_tiles(points, points.select(key[0], "lat", "lon", *columns), key, max(*radii, mean_radius), work, out, tuple(columns), by=key[0])
    return found.withColumns({"_m_" + c: F.nanvl("_m_" + c, F.lit(None)) for c in columns})


def outside_buffer(train: DataFrame, test: DataFrame, radius: float, key: list[str]) -> DataFrame:
    """Training rows more than ``radius`` metres (strictly) from every test row."""
    return train.join(any_within(train, test, key, radius, "_near").filter("_near = 1").select(*key), key, "left_anti")
