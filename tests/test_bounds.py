"""What tasks hold: quantiles, ranks and replicates do not keep a group, or a block's replicates, at once."""

import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from streetgrid.operators import inference, metrics, models, tiles
from streetgrid.plans.catalogue import QUERIES


def _plan(df):
    return df._jdf.queryExecution().toString()


def test_quantiles_from_running_sums(spark, sf_dir):
    """As ``percentile`` has them, also for a group without values; the query holds no group's values in one buffer."""
    rnd = np.random.default_rng(3)
    values = {"a": rnd.normal(0, 1e3, 501), "b": rnd.integers(-3, 4, 64).astype(float), "c": np.array([7.5])}
    rows = [(g, float(x)) for g, v in values.items() for x in v] + [("a", None), ("d", None)]
    counts = spark.createDataFrame(rows, "g string, x double").groupBy("g", "x").agg(F.count(F.lit(1)).alias("n"))
    shares = [0.0, 0.25, 0.5, 0.9, 1.0]
    found = {r["g"]: r["q"] for r in metrics.quantiles(counts, ["g"], "x", "n", shares).collect()}
    assert set(found) == set(values)
    for g, v in values.items():
        assert found[g] == pytest.approx(np.quantile(v, shares), rel=1e-12)
    assert "percentile(" not in _plan(QUERIES["qcut_bins"](spark, sf_dir))


def test_bins_of_a_group_without_values(spark, monkeypatch):
    from streetgrid.plans import evaluation

    rows = spark.createDataFrame([("x", 1.0), ("x", 2.0), ("x", None), ("y", None)], "backbone string, y_reg double")
    monkeypatch.setattr(evaluation, "_rows", lambda s, d: rows)
    found = {(r["backbone"], r["bin"]): r["n"] for r in evaluation.qcut_bins(spark, "").collect()}
    assert found == {("x", 0): 1, ("x", 3): 2, ("y", 3): 1}


@pytest.mark.parametrize("weight", [None, "w"])
def test_rank_correlation_deals_rows_out_once(spark, weight):
    """Average ranks with ties and weights; rows are not joined with their ranks, of one side or of both."""
    rnd = np.random.default_rng(5)
    rows = [(g, float(rnd.integers(0, k)) / 7, float(rnd.integers(0, 9)), float(rnd.integers(1, 5))) for g, k in (("a", 900), ("b", 4)) for _ in range(300)]
    df = spark.createDataFrame([*rows, ("a", float("nan"), 1.0, 1.0), ("a", 2.0, None, 1.0)], "g string, x double, z double, w double").repartition(3)
    found = metrics.spearman(df, ["g"], "x", "z", weight)
    for r in found.collect():
        x, z, w = (np.array(c) for c in zip(*(r_[1:] for r_ in rows if r_[0] == r["g"]), strict=True))
        w = w if weight else np.ones(len(x))
        rank = lambda v: np.array([w[v < a].sum() + (w[v == a].sum() + 1) / 2 for a in v])  # noqa: B023, E731
        a, b = rank(x), rank(z)
        cov = np.cov(a, b, aweights=w, ddof=0)
        assert r["rho"] == pytest.approx(cov[0, 1] / np.sqrt(cov[0, 0] * cov[1, 1]), rel=1e-9)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    # Only the first side's steps are joined.
    assert plan.count("Join ") == 1


@pytest.mark.parametrize("scores", [3, 1 << 20])
def test_replicates_of_a_block_stay_small(scores):
    """A block's 1,000 replicates are worked out for few rows at a time, whether scores tie or not."""
    rnd = np.random.default_rng(1)
    n = 2000
    s, y = np.sort(rnd.integers(0, scores, n) / 7), (rnd.random(n) < 0.4).astype(float)
    units = rnd.integers(0, inference.PRIME, n)
    tracemalloc.start()
    found = inference._pieces(s, y, units, np.ones(n), 1000)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 12 << 20
    w = inference.replicate_weights(units, 0, 1000)
    positive, negative = (sum(f[2][k] for f in found) for k in (0, 1))
    assert (positive == (w * y[:, None]).sum(axis=0)).all() and (negative == (w * (1 - y)[:, None]).sum(axis=0)).all()


def test_circles_look_from_west_to_east(monkeypatch):
    """Points of a strip look for their circles' ends in order of place, so that neighbours read the same stretch of memory."""
    rnd = np.random.default_rng(2)
    at = lambda n, wide: {"lat": 45 + rnd.random(n) * wide, "lon": -93 + rnd.random(n) * wide}
    p, f = at(400, 0.01), at(3000, 0.01)
    search, rising = np.searchsorted, []

    def watched(a, v, side="left", **other):
        if np.ndim(v) and len(v) > 1:
            rising.append(np.mean(np.diff(v) >= 0))
        return search(a, v, side, **other)

    monkeypatch.setattr(np, "searchsorted", watched)
    found = tiles.disc_sums(p, f, 300.0, np.ones((3000, 1)))[:, 0]
    monkeypatch.undo()
    assert np.mean(rising) > 0.8
    near = tiles.haversine(p["lat"][:, None], p["lon"][:, None], f["lat"][None], f["lon"][None]) <= 300.0
    assert (found == near.sum(axis=1)).all()


def test_folds_are_dealt_out(spark):
    """Points of one small file are spread over tasks before the rounds read them again and again."""
    rows = spark.range(40).selectExpr("'a' AS city", "id AS point_id", "double(id % 7) AS x", "double(id % 5) AS y").coalesce(1)
    kept = []
    real = models.cut
    models.cut, again = (lambda df: kept.append(df.rdd.getNumPartitions()) or real(df)), real
    try:
        models.spatial_folds(rows, 3).collect()
    finally:
        models.cut = again
    assert kept[0] >= spark.sparkContext.defaultParallelism
