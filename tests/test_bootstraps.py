"""Bootstraps with all replicates against brute force."""

import math

import numpy as np
import pytest

from pyspark.sql import functions as F

from streetgrid.operators import inference
from streetgrid.plans import evaluation
from streetgrid.plans.catalogue import QUERIES


def area(y, s):
    p, n = s[y == 1], s[y != 1]
    return np.nan if not len(p) * len(n) else ((p[:, None] > n).sum() + 0.5 * (p[:, None] == n).sum()) / (len(p) * len(n))


def weight(unit, rep):
    """The weight of a unit in a replicate, step by step in whole numbers."""
    p = 2147483647
    u = unit % p
    x0 = (u * 48271 + rep * 69621 + 12345) % p
    x = (x0 * x0 + u) % p
    x = (x * x + rep) % p
    x = (x * x + x0) % p
    w, share = 0, math.exp(-1)
    below = share
    while x >= p * below and w < 10:
        w += 1
        share /= w
        below += share
    return w


def draws(units):
    """The rows that each of 1,000 replicates holds, by their units, as often as they weigh."""
    return [np.repeat(np.arange(len(units)), [weight(int(u), rep) for u in units]) for rep in range(1000)]


@pytest.fixture
def rows(spark, monkeypatch):
    """40 points a run in dc, 29 (too few) in msp, 36 in pittsburgh of which one is positive; score follows the label a little."""
    rnd = np.random.default_rng(3)
    out = []
    for city, n in (("dc", 40), ("msp", 29), ("pittsburgh", 36)):
        for i in range(n):
            y = int(i == 5) if city == "pittsburgh" else int(rnd.random() < 0.5)
            for backbone, lift in (("siglip", 0.3), ("clip", 0.1)):
                out.append((backbone, 41, city, i, y, round(float(rnd.integers(0, 20) / 20 + lift * y), 6)))
    df = spark.createDataFrame(out, "backbone string, seed int, city string, point_id long, y_bin int, score double").cache()
    monkeypatch.setattr(evaluation, "_rows", lambda spark, sf_dir: df)
    return out


def of(rows, backbone, city):
    got = [r for r in rows if r[0] == backbone and r[2] == city]
    return np.array([r[4] for r in got]), np.array([r[5] for r in got])


def test_point_interval(spark, rows):
    found = {(r["backbone"], r["city"]): r for r in QUERIES["bootstrap_ci_1000"](spark, "").collect()}
    assert len(found) == 6
    for (backbone, city), r in found.items():
        y, s = of(rows, backbone, city)
        if city == "msp":
            assert (r["lo"], r["hi"], r["mean"], r["std"], r["n"]) == (None, None, None, None, 0)
            continue
        values = np.array([area(y[d], s[d]) for d in draws(range(len(y)))])
        values = values[np.isfinite(values)]
        assert r["n"] == len(values) >= 100
        assert (r["lo"], r["hi"]) == pytest.approx(tuple(np.percentile(values, [2.5, 97.5])), abs=2e-6)
        # Another generator's draws give nearly the same deviation.
        rnd = np.random.default_rng(1)
        other = np.array([area(y[d], s[d]) for d in rnd.integers(0, len(y), (1000, len(y)))])
        assert r["std"] == pytest.approx(np.nanstd(other, ddof=1), rel=0.15)
        assert (r["mean"], r["std"]) == pytest.approx((values.mean(), values.std(ddof=1)), abs=2e-6)


def test_paired_interval(spark, rows):
    found = {r["city"]: r for r in QUERIES["paired_bootstrap_1000"](spark, "").collect()}
    assert found["msp"]["lo"] is None and found["msp"]["p"] is None
    (y, a), (_, b) = of(rows, "siglip", "dc"), of(rows, "clip", "dc")
    gaps = np.array([area(y[d], a[d]) - area(y[d], b[d]) for d in draws(range(len(y)))])
    r = found["dc"]
    assert (r["lo"], r["hi"]) == pytest.approx(tuple(np.percentile(gaps, [2.5, 97.5])), abs=2e-6)
    assert r["n"] == 1000 and r["p"] == pytest.approx(min(1, 2 * min((gaps >= 0).mean(), (gaps <= 0).mean())), abs=2e-6)


def test_paired_interval_and_verdict_by_cells(spark, rows, monkeypatch):
    """Cells of 4 points; the last 4 points of a city have no place."""
    cells = spark.createDataFrame([(i, i // 4, 0) for i in range(36)], "point_id long, cx long, cy long")
    monkeypatch.setattr(evaluation, "_cells", lambda spark, sf_dir: cells)
    found = {r["city"]: r for r in QUERIES["paired_block_bootstrap_1000"](spark, "").collect()}
    (y, a), (_, b) = of(rows, "siglip", "dc"), of(rows, "clip", "dc")
    units = [(i // 4) * 200003 if i < 36 else -1 - i for i in range(40)]
    gaps = np.array([area(y[d], a[d]) - area(y[d], b[d]) for d in draws(units)])
    gaps = gaps[np.isfinite(gaps)]
    lo, hi = np.percentile(gaps, [2.5, 97.5])
    r = found["dc"]
    assert (r["lo"], r["hi"]) == pytest.approx((lo, hi), abs=2e-6) and r["n"] == len(gaps) and r["n_cells"] == 13
    assert found["msp"]["lo"] is None and found["msp"]["p"] is None
    verdicts = {r["city"]: r["verdict"] for r in QUERIES["equivalence_verdict_1000"](spark, "").collect()}
    want = "better" if lo > 0.02 else "worse" if hi < -0.02 else "equivalent" if lo > -0.02 and hi < 0.02 else "not_better" if hi < 0.02 else "inconclusive"
    assert verdicts["dc"] == want and verdicts["msp"] == "inconclusive"


def test_weights_are_poisson():
    """Mean and variance 1, and no correlation between units or between replicates."""
    w = inference.replicate_weights(np.arange(3000), 0, 400)
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.02
    assert np.abs(np.corrcoef(w[::30]) - np.eye(100)).max() < 0.25
    assert np.abs(np.corrcoef(w[:, ::8].T) - np.eye(50)).max() < 0.1
    assert w.sum(axis=0).std() == pytest.approx(3000**0.5, rel=0.15)
    assert [inference.replicate_weights(np.array([u]), r, r + 1)[0, 0] for u, r in ((0, 0), (77, 5), (2147483646, 999))] == [weight(u, r) for u, r in ((0, 0), (77, 5), (2147483646, 999))]


@pytest.mark.parametrize("block", [1, 7, 1 << 15])
def test_blocks_with_ties(spark, monkeypatch, block):
    """Blocks that cut through ties, in many partitions, give the areas of the weighted rows."""
    monkeypatch.setattr(inference, "BLOCK_ROWS", block)
    rnd = np.random.default_rng(8)
    rows = [("a" if i % 3 else None, int(i), int(rnd.random() < 0.4), float(rnd.integers(0, 6))) for i in range(240)] + [("one", 900 + i, 1, 0.5) for i in range(3)]
    df = spark.createDataFrame(rows, "g string, unit long, y int, s double").repartition(5)
    found = {}
    for r in inference.replicate_areas(df, ["g"], "y", "s", F.col("unit"), 20).collect():
        found[r["g"], r["rep"]] = r["auroc"]
    assert len(found) == 60 and all(found["one", k] is None for k in range(20))
    for g in ("a", None):
        own = [r for r in rows if r[0] == g]
        y, s = np.array([r[2] for r in own]), np.array([r[3] for r in own])
        for rep in range(20):
            d = np.repeat(np.arange(len(own)), [weight(r[1], rep) for r in own])
            assert found[g, rep] == pytest.approx(area(y[d], s[d]), abs=1e-12)
