"""Answers for points from features around them, at any density, without a row for each pair."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from streetgrid.operators import inference, near, tiles
from streetgrid.plans import catalogue


def test_group_summaries_fit(spark, sf_dir):
    rows = catalogue.QUERIES["group_summaries"](spark, sf_dir).collect()
    assert len(rows) == 16 and all(r["bg_r2"] is not None and r["bg_r2"] < 1 for r in rows)


def _random(rng, n, lat=40.0, lon=-80.0, wide=0.02):
    return {"lat": lat + rng.random(n) * wide, "lon": (lon + rng.random(n) * wide + 180) % 360 - 180}


@pytest.mark.parametrize(("lat", "lon"), [(40.0, -80.0), (-0.01, 179.99), (89.98, 10.0)])
def test_disc_sums(lat, lon):
    rng = np.random.default_rng(5)
    p, f = _random(rng, 200, lat, lon), _random(rng, 3000, lat, lon)
    p["lat"][7] = np.nan
    values = np.column_stack([np.ones(3000), rng.random(3000)])
    for r in (30.0, 400.0):
        near_by = tiles.haversine(p["lat"][:, None], p["lon"][:, None], f["lat"], f["lon"]) <= r
        assert np.allclose(tiles.disc_sums(p, f, r, values), near_by.astype(float) @ values)


def test_first_hit_and_blocks():
    rng = np.random.default_rng(6)
    p, f = _random(rng, 300), _random(rng, 500)
    hit = lambda p, f: tiles.haversine(p["lat"][:, None], p["lon"][:, None], f["lat"][None, :], f["lon"][None, :]) <= 60.0
    every = hit(p, f)
    assert np.array_equal(tiles.first_hit(p, f, hit), np.where(every.any(axis=1), every.argmax(axis=1), -1))
    seen = np.zeros_like(every)
    for i, j in tiles.blocks(p, f, 60.0, at_once=500):
        assert len(i) * len(j) <= 500 or len(i) == 1
        seen[np.ix_(i, j)] = True
    assert not (every & ~seen).any() and seen.mean() < 0.2


def _crowd(spark, n):
    return spark.range(n).select(F.lit("x").alias("city"), F.col("id").alias("point_id"), (F.lit(40.0) + F.col("id") * 7919 % 10007 / 10007 * 0.02).alias("lat"), (F.lit(-80.0) + F.col("id") * 104729 % 9973 / 9973 * 0.02).alias("lon"))


def test_search_begins_by_crowding(spark):
    few, many = (near.first_look(df, df, "city", 16, 300.0) for df in (_crowd(spark, 300), _crowd(spark, 30000)))
    assert few > 4 * many and many < 30


def test_no_broadcast_and_no_pairs(spark, sf_dir):
    p = _crowd(spark, 100)
    assert "Broadcast" not in near.pairs_within(p, p, 100.0)._jdf.queryExecution().toString()
    for name in ("radius_count_sum", "radius_label3"):
        assert "Join" not in catalogue.QUERIES[name](spark, sf_dir)._jdf.queryExecution().toString()


def test_shared_units_are_counted_first(spark):
    rows = spark.range(400).select(F.lit("r").alias("run"), (F.col("id") % 7 % 2).cast("int").alias("y"), (F.col("id") % 5 / 4).alias("s"), (F.col("id") % 6).alias("unit"))
    of = lambda shared: inference.replicate_areas(rows, ["run"], "y", "s", F.col("unit"), 20, shared=shared)
    assert sorted(of(True).collect()) == sorted(of(False).collect())
    assert "count(1)" in of(True)._jdf.queryExecution().toString()
