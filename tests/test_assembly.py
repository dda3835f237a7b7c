"""Frames, stored indices, target sets, published reports and anchored points against brute force."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from streetgrid.operators import composite, graph, models, near, sampling, tables, targets
from streetgrid.operators import reports as reports_ops
from streetgrid.sources import reports


@pytest.mark.parametrize("steps", [1, 8, 1024])
@pytest.mark.parametrize("limit", [1, 17, 500])
def test_first_in_order(spark, monkeypatch, steps, limit):
    monkeypatch.setattr(sampling, "STEPS", steps)
    rnd = np.random.default_rng(5)
    rows = [(city, i, int(rnd.integers(0, 40))) for city, n in (("a", 100), ("b", 17), ("c", 1), (None, 5)) for i in range(n)]
    df = spark.createDataFrame(rows, "city string, id int, h int")
    found = sampling.first_in_order(df.filter("city IS NOT NULL"), "city", "h", ["id"], limit, 40)
    assert found.columns == ["city", "id", "h"]
    want = []
    for city in "abc":
        want += sorted((r for r in rows if r[0] == city), key=lambda r: (r[2], r[1]))[:limit]
    assert sorted(tuple(r) for r in found.collect()) == sorted(want)


def test_round_robin(spark):
    rows = [("a", s, i) for s, n in ((1, 5), (2, 1), (3, 2)) for i in range(n)]
    found = sampling.round_robin(spark.createDataFrame(rows, "city string, s int, id int"), "city", ["s"], ["id"], 6)
    assert sorted((r["round_"], r["s"]) for r in found.collect()) == [(1, 1), (1, 2), (1, 3), (2, 1), (2, 3), (3, 1)]


def test_stored_index(spark, tmp_path):
    rnd = np.random.default_rng(6)
    n = 200
    base = rnd.normal(size=n)
    a, b, c = base + rnd.normal(size=n) / 2, -base + rnd.normal(size=n), np.exp(base + 1)
    gaps = rnd.random(n) < 0.1
    rows = [(i, "x" if i % 4 else "y", float(a[i]), None if gaps[i] else float(b[i]), float(c[i])) for i in range(n)]
    df = spark.createDataFrame(rows, "id int, city string, a double, b double, c double")
    kinds = {"a": "raw", "b": "raw", "c": "log1p"}
    path = f"{tmp_path}/index"
    composite.store(composite.fit(df, kinds, "a", "v1", F.col("city") == "x"), path)
    composite.store(composite.fit(df, {"a": "raw", "b": "raw"}, "b", "v2"), path)
    stats = composite.stored(spark, path, "v1")
    assert [r["component"] for r in stats] == ["a", "b", "c"] and len(composite.stored(spark, path, "v2")) == 2
    with pytest.raises(ValueError):
        composite.stored(spark, path, "v3")
    x = np.column_stack([a, np.where(gaps, np.median(b[~gaps]), b), np.log1p(c)])
    own = np.arange(n) % 4 != 0
    z = (x - x[own].mean(axis=0)) / x[own].std(axis=0)
    load = np.linalg.svd(z[own] - z[own].mean(axis=0))[2][0]
    load *= np.sign(load[0])
    made = composite.apply(df, stats, "index").orderBy("id")
    assert np.allclose([r["index"] for r in made.collect()], z @ load, atol=1e-8)
    assert json.loads(made.first()["components_json"])["c"] == pytest.approx(x[0, 2])
    again = composite.rebuild(made.select("id", "components_json"), ["a", "c"], "a", "v2").orderBy("id")
    two = x[:, [0, 2]]
    two = (two - two.mean(axis=0)) / two.std(axis=0)
    assert np.allclose([r["v2"] for r in again.collect()], two @ np.array([0.5**0.5, 0.5**0.5]), atol=1e-8)


def test_target_sets(spark):
    known = targets.registry(spark, (1, 2))
    assert known.count() == 12 and targets.registry(spark).count() == 15
    wide = spark.createDataFrame([("a", 1, 1, 2.0, float("nan")), ("a", 2, 0, 4.0, 5.0), ("b", 1, None, 9.0, float("inf")), ("c", 1, 1, 7.0, None)], "city string, point_id int, overture_sidewalk_present int, D3B double, stops_400m double").withColumn("NatWalkInd", F.lit(1.0))
    labels = targets.long_labels(wide, ["city", "point_id"], known)
    assert labels.count() == 3 + 4 + 1
    # The lock has point 1 of a and of c; an id that another city has is no lock for this one.
    lock = spark.createDataFrame([("a", 1), ("c", 1), ("c", 1)], "city string, point_id int")
    train = targets.training_set(labels, lock, ["a", "b"], ["city", "point_id"])
    assert sorted((r["target"], r["value"]) for r in train.collect()) == [("D3B", 2.0), ("overture_sidewalk_present", 1.0)]
    of = {r["target"]: (r["mean"], r["scale"], r["n"]) for r in targets.scalers(labels, known).collect()}
    assert of["D3B"] == pytest.approx((5.5, np.std([2, 4, 9, 7]), 4)) and of["stops_400m"] == (5.0, 1e-6, 1)
    assert of["overture_sidewalk_present"] == (0.0, 1.0, 3) and of["D1B"] == (0.0, 1.0, 0)
    scaled = targets.scale(labels, targets.scalers(labels, known))
    back = targets.unscale(scaled, targets.scalers(labels, known), name="again")
    assert all(r["again"] == pytest.approx(r["value"]) for r in back.collect())


@pytest.mark.parametrize("kind", reports.FORMATS)
def test_reports(spark, tmp_path, kind):
    path = f"{tmp_path}/report"
    df = spark.createDataFrame([(1, "a, \"b\"", 0.5), (2, None, None)], "id int, name string, x double")
    assert reports.publish(df, path, kind) == 1
    # A job that dies before its manifest line leaves files that nobody reads.
    df.filter("id = 1").write.parquet(f"{path}/versions/broken")
    assert sorted(map(tuple, reports.read_report(spark, path).collect())) == [(1, "a, \"b\"", 0.5), (2, None, None)]
    assert reports.publish(df.filter("id = 2"), path, kind) == 2
    assert [r["id"] for r in reports.read_report(spark, path).collect()] == [2]
    assert reports.read_report(spark, path, version=1).count() == 2
    with pytest.raises(ValueError):
        reports.read_report(spark, path, version=7)
    with pytest.raises(ValueError):
        reports.publish(df, path, "xls")


def test_anchored_points(spark):
    points = spark.createDataFrame([("a", 1, 10, 45.0, 7.0), ("a", 2, 99, 45.001, 7.0), ("a", 3, 98, None, None), ("b", 4, 97, 45.0, 7.0), ("a", 5, 11, 45.01, 7.0)], "city string, point_id long, osmid long, lat double, lon double")
    nodes = spark.createDataFrame([("a", 10, 45.0, 7.0), ("a", 11, 45.01, 7.0), ("a", 12, None, None)], "city string, node long, lat double, lon double")
    found = {r["point_id"]: (r["node"], r["fallback"], r["unanchored"]) for r in graph.anchored(points, nodes).collect()}
    assert found == {1: (10, 0, 0), 2: (10, 1, 0), 3: (None, 0, 1), 4: (None, 0, 1), 5: (11, 0, 0)}
    edges = spark.createDataFrame([(10, 11, 300.0), (11, 10, 300.0)], "u long, v long, length double")
    values = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 2.0), ("a", 3, 3.0), ("b", 4, 4.0), ("a", 5, 5.0)], "city string, point_id long, x double")
    rows = {r["point_id"]: r for r in graph.anchored_features(graph.anchored(points, nodes), edges, values, ["city", "point_id"], ["x"], 8, 400.0).collect()}
    assert [(rows[i]["n_near"], rows[i]["mean_dist"], rows[i]["near_x"]) for i in range(1, 6)] == [(1, 300.0, 5.0), (1, 300.0, 5.0), (0, 400.0, 3.0), (0, 400.0, 4.0), (1, 300.0, 1.0)]


def test_context_of_a_lone_point(spark):
    df = spark.createDataFrame([("a", 1, 45.0, 7.0, 2.0), ("b", 1, 45.0, 7.0, 4.0), ("b", 2, 45.001, 7.0, 6.0)], "city string, point_id long, lat double, lon double, x double")
    rows = {(r["city"], r["point_id"]): r for r in near.context_features(df, ["x"], 3).collect()}
    assert rows["a", 1]["mean_dist"] is None and rows["a", 1]["near_x"] == 2.0 and rows["a", 1]["n_800m"] == 0
    assert rows["b", 1]["near_x"] == 6.0 and rows["b", 1]["mean_x"] == 6.0 and rows["b", 1]["n_200m"] == 1


def test_purge(spark):
    df = spark.createDataFrame([(1, 2, 3, 4)], "id int, cap_a int, Lat int, keep int")
    assert tables.purge(df, ["lat", "none"], ["cap_"]).columns == ["id", "keep"]


def test_nested_folds(spark):
    fold = "struct<fold: int, metrics: map<string, struct<auroc: double>>>"
    rows = [("a", 1, [(0, {"t": (0.1,)})], 0.9), ("a", 2, [(0, {"t": (0.5,)}), (1, {"u": (0.1,)}), (2, {"t": (None,)}), (3, {"t": (0.7,)}), (4, {"t": (float("nan"),)})], 0.8), ("b", 1, [], None)]
    df = spark.createDataFrame(rows, f"city string, ts int, per_fold_results array<{fold}>, random_split_auroc double")
    a, b = reports_ops.nested_folds(df, ["city"], ["ts"], "t").orderBy("city").collect()
    assert (a["folds"], a["random_split"]) == (2, 0.8) and (a["mean"], a["std"]) == pytest.approx((0.6, 0.1))
    assert (b["folds"], b["mean"], b["random_split"]) == (0, None, None)


def test_alignment(spark):
    """Both alignments against numpy."""
    rnd = np.random.default_rng(9)
    x, y = rnd.normal(size=(60, 4)) @ rnd.normal(size=(4, 4)) + 1, rnd.normal(size=(50, 4)) @ rnd.normal(size=(4, 4)) - 2
    of = lambda m: spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(m)], "id int, v array<double>")
    got = lambda df: np.array([r["aligned"] for r in df.orderBy("id").collect()])

    def power(m, p):
        values, vectors = np.linalg.eigh(np.cov(m, rowvar=False) + 1e-6 * np.eye(4))
        return (vectors * np.maximum(values, 1e-6) ** p) @ vectors.T

    want = (x - x.mean(axis=0)) @ power(x, -0.5) @ power(y, 0.5) + y.mean(axis=0)
    assert np.allclose(got(models.coral(of(x), of(y), "v")), want, atol=1e-6)
    source, target = models.subspace(of(x), of(y), "v", 2)
    bs, bt = (np.linalg.svd(m - m.mean(axis=0))[2][:2].T for m in (x, y))
    aligned, projected = (x - x.mean(axis=0)) @ bs @ bs.T @ bt, (y - y.mean(axis=0)) @ bt
    # Components have no sign of their own.
    for k in range(2):
        sign = np.sign((got(target)[:, k] * projected[:, k]).sum())
        assert np.allclose(got(target)[:, k] * sign, projected[:, k], atol=1e-6)
        assert np.allclose(got(source)[:, k] * sign, aligned[:, k], atol=1e-6)
