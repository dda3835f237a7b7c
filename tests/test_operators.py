"""Corner cases and known values that the tables do not hold."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from streetgrid.functions import geo, text
from streetgrid.operators import agreement, geometry, graph, inference, metrics, models, near, reports, runlog
from streetgrid.sources import files

#: Confusion tables (rows: reference) with published kappa, both areas and raw agreement.
KNOWN = [((43, 418, 21, 2857), 0.134681490, 0.542989377, 0.772120706, 0.868523510), ((3866, 869, 70, 46), 0.048863451, 0.606512398, 0.516244336, 0.806431664)]


def one(spark, *columns):
    return spark.range(1).select(*(c.alias(f"c{i}") for i, c in enumerate(columns))).first()


@pytest.mark.parametrize("cells,kappa,_a,area,raw", KNOWN)
def test_agreement_of_published_tables(spark, cells, kappa, _a, area, raw):
    df = spark.createDataFrame([cells], "n00 long, n01 long, n10 long, n11 long")
    r = metrics.agreement(df).first()
    assert r["kappa"] == pytest.approx(kappa, abs=1e-8) and r["raw_agreement"] == pytest.approx(raw, abs=1e-8)
    assert {round(r["auroc_a"], 8), round(r["auroc_b"], 8)} >= {round(area, 8)}


def test_ceiling_of_published_values(spark):
    got = one(spark, metrics.ceiling_auroc(F.lit(0.13468149025335197), F.lit(0.9808325846061695), F.lit(0.8619347109913148)))[0]
    assert got == pytest.approx(0.7721207061, abs=1e-6) or got == pytest.approx(0.542989377, abs=1e-6)


def test_heading_error_wraps(spark):
    assert list(one(spark, *(geo.heading_error(F.lit(t), F.lit(a)) for t, a in ((0, 359), (350, 10), (0, 180), (90, 90))))) == [1, 20, 180, 0]


def test_circle_geometry(spark):
    lit = lambda *v: [F.lit(float(x)) for x in v]
    whole = one(spark, geometry.square_in_circle(*lit(0, 0, 100), 10.0), geometry.square_in_circle(*lit(0, 0, 1), 10.0), geometry.square_in_circle(*lit(100, 0, 1), 10.0), geometry.square_in_circle(*lit(5, 0, 5), 10.0))
    assert whole[0] == pytest.approx(math.pi * 100) and whole[1] == pytest.approx(4) and whole[2] == pytest.approx(0, abs=1e-9)
    assert 0 < whole[3] < 100
    lengths = one(spark, geometry.length_in_circle(*lit(-20, 0, 20, 0), 10.0), geometry.length_in_circle(*lit(-20, 10.5, 20, 10.5), 10.0), geometry.length_in_circle(*lit(0, 0, 0, 0), 10.0), geometry.length_in_circle(*lit(1, 1, 2, 1), 10.0))
    assert list(lengths) == [pytest.approx(20), 0, 0, pytest.approx(1)]
    assert list(one(spark, geometry.segment_distance(*lit(3, 4, 3, 4)), geometry.segment_distance(*lit(-1, 2, 1, 2)))) == [5, 2]


def test_sector_and_polygon(spark):
    lit = lambda *v: [F.lit(float(x)) for x in v]
    seen = one(spark, geometry.in_sector(*lit(0, 5), F.lit(0), 10.0, 30.0), geometry.in_sector(*lit(5, 0), F.lit(0), 10.0, 30.0), geometry.in_sector(*lit(-0.5, 5), F.lit(350), 10.0, 30.0), geometry.segment_in_sector(*lit(-20, 5, 20, 5), F.lit(0), 10.0, 30.0), geometry.segment_in_sector(*lit(-20, -5, 20, -5), F.lit(0), 10.0, 30.0))
    assert list(seen) == [True, False, True, True, False]
    ring = lambda s: F.array(*(F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((-s, -s), (s, -s), (s, s), (-s, s), (-s, -s))))
    shape = F.array(ring(2), ring(1))
    assert list(one(spark, *(geometry.point_in_polygon(*lit(x, y), shape) for x, y in ((1.5, 0), (0, 0), (2, 0), (3, 0))))) == [True, False, True, False]


def test_metrics_corner_cases(spark):
    rows = [("a", 1, 0.5), ("a", 0, 0.5), ("a", 1, 0.9), ("a", 0, None), ("a", None, 0.1), ("b", 1, 0.2), ("b", 1, 0.3), ("c", 1, float("nan"))]
    df = spark.createDataFrame(rows, "g string, y int, s double")
    assert {r["g"]: r["auroc"] for r in metrics.auroc(df, ["g"], "y", "s").collect()} == {"a": 0.75, "b": None}
    flipped = df.withColumn("s", -F.col("s"))
    assert {r["g"]: r["auroc"] for r in metrics.auroc(flipped, ["g"], "y", "s").collect()} == {"a": 0.25, "b": None}
    flat = spark.createDataFrame([("a", 1.0, 2.0), ("a", 2.0, 2.0), ("a", 3.0, 2.0)], "g string, x double, z double")
    assert metrics.spearman(flat, ["g"], "x", "z").first()["rho"] is None


def test_holm_and_verdicts(spark):
    df = spark.createDataFrame([(1, 0.01), (2, 0.04), (3, 0.03), (4, None)], "i int, p double")
    got = {r["i"]: r["p_holm"] for r in inference.holm(df, "p", ["i"]).collect()}
    assert got == {1: pytest.approx(0.03), 3: pytest.approx(0.06), 2: pytest.approx(0.06), 4: None}
    v = lambda a, b: inference.verdict(F.lit(a).cast("double"), F.lit(b).cast("double"))
    assert list(one(spark, v(0.01, 0.2), v(-0.2, -0.01), v(-0.01, 0.01), v(-0.5, 0.01), v(-0.5, 0.5), v(None, 1.0))) == ["better", "worse", "equivalent", "not_better", "inconclusive", "inconclusive"]


def test_paths_on_small_graph(spark, tmp_path):
    spark.sparkContext.setCheckpointDir(str(tmp_path))
    edges = spark.createDataFrame([(1, 2, 10.0), (1, 2, 5.0), (2, 3, 10.0), (1, 3, 20.0), (3, 3, 1.0), (3, 4, 400.0)], "u long, v long, length double")
    got = {(r["source"], r["node"]): r["dist"] for r in graph.bounded_paths(edges, spark.createDataFrame([(1,)], "node long"), 400.0).collect()}
    assert got == {(1, 1): 0.0, (1, 2): 5.0, (1, 3): 15.0}
    assert {r["node"]: r["degree"] for r in graph.degrees(edges).collect()}[3] == 5


def test_joins_without_partners(spark):
    points = spark.createDataFrame([("x", 1, 0.0, 0.0), ("x", 2, None, None), ("y", 1, 0.0, 0.0)], "city string, point_id long, lat double, lon double")
    labels = spark.createDataFrame([("x", 7, 0.0, 0.0005, "bad"), ("x", 8, 0.0, -0.0005, "good")], "city string, id long, lat double, lon double, kind string")
    got = {(r["city"], r["point_id"]): r["label"] for r in near.label_within(points, labels, ["city", "point_id"], 100.0, "kind", ["good"], ["bad"]).collect()}
    assert got == {("x", 1): 1, ("x", 2): None, ("y", 1): None}
    assert {(r["city"], r["point_id"]): r["nearest_id"] for r in near.nearest_within(points, labels, ["city", "point_id"], "id", 100.0).collect()}["x", 1] == 7


def test_text_corner_cases(spark):
    times = one(spark, *(text.gtfs_minutes(F.lit(t)) for t in ("25:10:00", " 6:05:00", "bad", "", None)))
    assert list(times) == [1510, 365, -1, -1, -1]
    assert one(spark, F.array_join(text.pick_multi("barriers", F.lit("river|none|sea")), "|"), F.array_join(text.pick_multi("land_use", F.lit("Commercial|x|residential|commercial")), "|"), text.pick_single("sidewalk", F.lit("BOTH_SIDES")), text.pick_single("sidewalk", F.lit(None).cast("string")))[:4] == ("none", "residential|commercial", "both_sides", "unknown")
    assert one(spark, text.first_json_object(F.lit("```json\n{\"a\": {\"b\": 1}}\n``` ok")))[0] == '{"a": {"b": 1}}'


def test_sources(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"features": [{"geometry": {"type": "Point", "coordinates": [1.5, 2.5]}, "properties": {"id": 1}}]}')
    assert [tuple(r) for r in files.read_geojson(spark, str(tmp_path / "a.json"), "id: bigint").collect()] == [(1.5, 2.5, 1)]
    (tmp_path / "l.jsonl").write_text('{"a": 1}\n\n{"a": \n{"a": 3}\n')
    assert sorted(r["a"] for r in files.read_jsonl(spark, str(tmp_path / "l.jsonl"), "a long").collect()) == [1, 3]
    odd = spark.createDataFrame([(None, "CurbRamp", 1.0)], "label_type string, attribute_type string, Latitude double")
    assert files.unify(odd).columns == ["label_type", "lat"] and files.unify(odd).first()["label_type"] == "CurbRamp"
    (tmp_path / "img").mkdir()
    (tmp_path / "img" / "12_90.jpg").write_bytes(b"x")
    assert [(r["point_id"], r["heading"]) for r in files.read_images(spark, str(tmp_path / "img")).collect()] == [(12, 90)]
    tags = spark.createDataFrame([({"crossing": "zebra"},), ({"crossing:markings": "no"},), ({"crossing:markings": "dots"},), ({},)], "t map<string, string>")
    assert [r[0] for r in tags.select(files.marked_crossing(F.col("t"))).collect()] == [True, False, True, False]


def test_alignment_moments(spark):
    rows = [(i, [math.sin(i * 1.7), math.cos(i * 0.9) * 2, math.sin(i * 0.3) + i % 3]) for i in range(60)]
    target = [(i, [math.cos(i * 2.1) * 3 + 1, math.sin(i * 1.1), math.cos(i * 0.7) * 2]) for i in range(60)]
    a, b = (spark.createDataFrame(r, "vec_id long, e array<double>") for r in (rows, target))
    aligned = models.coral(a, b, "e").select("vec_id", F.col("aligned").alias("e"))
    (m1, c1), (m2, c2) = (models.moments(models.vectors(d, "e")) for d in (aligned, b))
    assert abs(m1 - m2).max() < 1e-3 and abs(c1 - c2).max() < 1e-3
    assert len(models.subspace(a, b, "e", 2)[0].first()["aligned"]) == 2


def test_latest_breaks_ties_by_index(spark):
    log = spark.createDataFrame([("b", "x", "y", "full", "2024-01-01", 1, 0.1), ("b", "x", "y", "full", "2024-01-01", 2, 0.2)], "backbone string, train_city string, test_city string, ablation string, ts string, run_index int, auroc double")
    assert runlog.latest(log).first()["run_index"] == 2


def test_prevalence_threshold_gathers_no_group(spark):
    rnd = np.random.default_rng(2)
    scores = {"a": rnd.integers(0, 12, 501) / 10, "b": rnd.random(40), "c": np.array([0.5])}
    df = spark.createDataFrame([(k, float(v)) for k, s in scores.items() for v in s] + [("a", None)], "city string, score double")
    shares = {"a": 0.3, "b": 0.0, "c": 0.7}
    found = metrics.prevalence_threshold(df, ["city"], "score", spark.createDataFrame(list(shares.items()), "city string, p double"))
    for r in found.groupBy("city").agg(F.min("threshold").alias("t"), F.max("threshold").alias("u")).collect():
        assert r["t"] == r["u"] == pytest.approx(np.quantile(scores[r["city"]], 1 - max(shares[r["city"]], 0.001)))
    assert "collect_list" not in found._jdf.queryExecution().toString()


def test_geojson_collections_are_bounded(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "FEATURES", 100)
    rows = [("dc", i, i / 100, -i / 50) for i in range(2000)] + [(None, 7, 1.0, 2.0), ("msp", 5, 3.0, 4.0)]
    files.write_geojson(spark.createDataFrame(rows, "city string, point_id long, lat double, lon double"), f"{tmp_path}/g")
    sizes = spark.read.option("multiLine", True).json(f"{tmp_path}/g").select(F.size("features").alias("n")).collect()
    assert max(r["n"] for r in sizes) < 200 and len(sizes) == 22
    got = files.read_geojson(spark, f"{tmp_path}/g", "point_id: bigint")
    assert sorted((r["point_id"], r["lat"], r["lon"]) for r in got.collect()) == sorted(r[1:] for r in rows)


def test_tree_baselines_have_the_sizes_asked_for(spark, monkeypatch):
    asked = {}
    for name in ("RandomForestRegressor", "GBTRegressor"):
        def make(name=name, real=getattr(models, name), **k):
            asked[name] = k
            return real(**(k | ({"numTrees": 3} if name[0] == "R" else {"maxIter": 2})))

        monkeypatch.setattr(models, name, make)
    df = spark.createDataFrame([(float(i), float(i * i)) for i in range(200)], "x double, y double")
    assert models.tree_baselines(df, df, "y", ["x"]).count() == 200
    assert (asked["RandomForestRegressor"]["numTrees"], asked["RandomForestRegressor"]["maxDepth"], asked["GBTRegressor"]["maxIter"]) == (300, 30, 100)


def test_tree_baselines_read_training_rows_once(spark, monkeypatch):
    for name in ("RandomForestRegressor", "GBTRegressor"):
        monkeypatch.setattr(models, name, lambda real=getattr(models, name), **k: real(**(k | ({"numTrees": 3} if "numTrees" in k else {"maxIter": 2}))))
    reads = spark.sparkContext.accumulator(0)

    def seen(r):
        reads.add(1)
        return r

    rows = spark.sparkContext.parallelize([(float(i), float(i * i)) for i in range(200)], 2)
    train = spark.createDataFrame(rows.map(seen), "x double, y double")
    assert models.tree_baselines(train, spark.createDataFrame(rows, "x double, y double"), "y", ["x"]).count() == 200
    assert reads.value == 200


def _haversine(a, b):
    p, q = math.radians(a[0]), math.radians(b[0])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * 6371008.8 * math.atan2(math.sqrt(h), math.sqrt(1 - h))


@pytest.mark.parametrize("lat,lon", [(44.9, -93.2), (78.2, 15.6), (-77.8, 166.7), (0.0, 180.0), (65.0, -180.0), (89.9985, 0.0)])
def test_pairs_within_anywhere(spark, lat, lon):
    """Every pair, at high latitudes, across the antimeridian and around a pole."""
    rnd = random.Random(5)
    wide = 180.0 if lat > 89 else 0.006 / math.cos(math.radians(lat))
    spots = [(i, min(90.0, lat + rnd.uniform(-0.004, 0.004)), (lon + rnd.uniform(-wide, wide) + 180) % 360 - 180) for i in range(150)]
    df = spark.createDataFrame([("c", *s) for s in spots], "city string, point_id long, lat double, lon double")
    found = {(r["point_id"], r["r_point_id"]) for r in near.pairs_within(df, df, 200.0).collect()}
    assert found == {(a[0], b[0]) for a in spots for b in spots if _haversine(a[1:], b[1:]) <= 200.0}
    assert len(found) > 200


def test_knn_of_small_and_scattered_groups(spark):
    """Groups with fewer than k others, and others that are a world away, by brute force."""
    rnd = random.Random(2)
    rows = [("far", i, rnd.uniform(-80, 80), rnd.uniform(-180, 180)) for i in range(12)] + [("two", 1, 0.0, 0.0), ("two", 2, 0.0, 179.0), ("one", 1, 5.0, 5.0)]
    rows += [("near", i, 10 + i * 1e-4, 20.0) for i in range(9)]
    df = spark.createDataFrame(rows, "city string, point_id long, lat double, lon double")
    found = {(r["city"], r["point_id"], r["rank"]): r["neighbour"] for r in near.knn(df, 4).collect()}
    want = {}
    for c, i, *at in rows:
        others = sorted((_haversine(at, r[2:]), r[1]) for r in rows if r[0] == c and r[1] != i)[:4]
        want |= {(c, i, k): j for k, (_, j) in enumerate(others, 1)}
    assert found == want


def test_sector_and_clips_without_length(spark):
    """Edges of no length, parallel ones and horizontal ones divide by nothing."""
    rows = [(0.0, 5.0, 0.0, 5.0), (-1.0, 2.0, 1.0, 2.0), (0.0, 1.0, 0.0, 9.0), (3.0, 3.0, 3.0, 3.0), (20.0, 0.0, 20.0, 9.0)]
    df = spark.createDataFrame(rows, "x0 double, y0 double, x1 double, y1 double")
    cs = [F.col(c) for c in ("x0", "y0", "x1", "y1")]
    found = df.select(geometry.segment_in_sector(*cs, F.lit(0.0), 15.0, 30.0).alias("hit"), geometry.length_in_circle(*cs, 4.0).alias("m"), geometry.edge_area(*cs, 4.0).alias("a"), geometry.segment_distance(*cs).alias("d")).collect()
    assert [r["hit"] for r in found] == [True, True, True, False, False]
    assert [round(r["m"], 6) for r in found] == [0.0, 2.0, 3.0, 0.0, 0.0] and found[0]["a"] == found[3]["a"] == 0.0
    assert [round(r["d"], 6) for r in found] == [5.0, 2.0, 1.0, round(math.sqrt(18), 6), 20.0]


def test_canonical_answer_and_agreement_by_hand(spark):
    """Expected values worked out from the written rules, not from the SQL."""
    answer = "traffic=med, sidewalk=one_side, barriers=rail|none, land_use=commercial|residential, transit_stop=present, tree_canopy=dense, crosswalk=absent"
    rows = agreement.validated(spark.createDataFrame([("c", i, answer) for i in range(5)], "city string, point_id long, answer string"))
    assert rows.first()["canonical"] == "sidewalk=one_side, crosswalk=absent, bike_lane=unknown, traffic=med, tree_canopy=dense, land_use=residential|commercial, transit_stop=present, lighting=unknown, maintenance=unknown, barriers=none"
    # Trees 0, .1, .2, .3, .4: cuts at .08, .2 and .32; the third lies on its cut and belongs below.
    masks = [("c", i, s, x, i / 10, n) for i, (s, x, n) in enumerate([(0.0, 0.0, 0), (0.02, 0.02, 2), (0.095, 0.021, 0), (0.5, 0.5, 1), (0.01, 0.0, 1)])]
    coded = agreement.mask_codes(spark.createDataFrame(masks, "city string, point_id long, sidewalk_max double, crosswalk_max double, vegetation_mean double, stops_400m long"))
    found = {r["point_id"]: r for r in agreement.score(rows, coded, ["city", "point_id"]).collect()}
    code = [[found[i][f"b_{f}"] for i in range(5)] for f in ("sidewalk", "crosswalk", "tree_canopy", "transit_stop")]
    assert code == [[0, 1, 2, 2, 0], [0, 0, 1, 1, 0], [0, 1, 1, 2, 3], [0, 1, 0, 1, 1]]
    assert [found[i]["score"] for i in range(5)] == [0.6667, 0.6667, 0.3333, 0.6667, 1.0]
    assert [found[i]["tier"] for i in range(5)] == ["partial", "partial", "disagreement", "partial", "high_confidence"]
    assert [found[i]["ok_transit_stop"] for i in range(5)] == [0, 1, 0, 1, 1]


def test_report_tables_on_few_rows(spark):
    from streetgrid.operators import reports

    said = spark.createDataFrame([("a", "worse"), ("a", "better"), ("b", "worse"), ("b", "inconclusive"), ("c", "equivalent"), ("d", "inconclusive")], "k string, v string")
    assert {r["k"]: r["overall"] for r in reports.overall_verdict(said, ["k"], "v").collect()} == {"a": "mixed", "b": "not_better_with_inconclusive", "c": "not_better", "d": "inconclusive"}
    one = spark.createDataFrame([("x", 1, 0.5, 1.0), ("x", 1, 0.7, None), ("y", 1, 0.2, 1.0), ("y", 2, 0.4, 3.0), ("y", 3, None, 2.0)], "k string, g int, s double, t double")
    assert {r["k"]: (r["n_groups"], r["r2"] is None) for r in reports.group_rollup(one, ["k"], "g", "t", "s").collect()} == {"x": (1, True), "y": (2, False)}
    rows = spark.createDataFrame([("c", i, i * 37 % 50) for i in range(25)] + [("d", i, 0) for i in range(5)], "k string, i int, o int")
    # 0.7 * 5 is 3.5 and rounds to 4; 0.7 * 25 is 17.5 and rounds to 18.
    split = reports.split_share(rows, ["k"], F.col("o"), "i", 0.7, 10).filter("is_train = 1").groupBy("k").count()
    assert {r["k"]: r["count"] for r in split.collect()} == {"c": 18, "d": 4}
    assert reports.split_share(rows.limit(0), ["k"], F.col("o"), "i", 0.7, 10).count() == 0
    top = reports.top_values(spark.createDataFrame([("b",), ("a",), (None,), (None,), ("c",), ("c",)], "v string"), [], "v", 2)
    assert sorted((r["place"], r["v"], r["n"]) for r in top.collect()) == [(1, "c", 2), (2, "a", 1)]
    gone = reports.fallback_rate(spark.createDataFrame([("p", i) for i in range(100)], "k string, i int"), spark.createDataFrame([(i,) for i in range(99)], "i int"), ["k"], "i").first()
    assert (gone["n_in_graph"], gone["fallback_pct"], gone["rebuild"]) == (99, 1.0, 1)


def test_number_step_never_falls(spark):
    values = sorted({0.0, -0.0, 1e-310, -1e-310, float("inf"), float("-inf"), *(s * 2.0**e * m for s in (1, -1) for e in (-1060, -60, -3, -1, 0, 1, 9, 40, 900) for m in (1.0, 1 - 2**-53, 1 + 2**-52, 1.3, 1.99))})
    steps = [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, x double").orderBy("i").select(metrics.number_step(F.col("x"))).collect()]
    assert steps == sorted(steps) and len(set(steps)) > len(steps) / 2


def test_running_sums_and_metrics_over_wide_scores(spark):
    rng = np.random.default_rng(5)
    rows = [(g, int(y), float(x), float(z)) for g in ("a", "b") for y, x, z in zip(rng.integers(0, 2, 300), np.round(rng.normal(0, 3, 300), 1), np.exp(rng.normal(0, 9, 300)) * rng.choice([-1, 1], 300))]
    df = spark.createDataFrame(rows, "g string, y int, s double, z double")
    frame = pd.DataFrame(rows, columns=["g", "y", "s", "z"])
    for score in ("s", "z"):
        found = {r["g"]: r["auroc"] for r in metrics.auroc(df, ["g"], "y", score).collect()}
        hits = {r["g"]: r["ap"] for r in metrics.average_precision(df, ["g"], "y", score).collect()}
        for g, part in frame.groupby("g"):
            pos, neg = part[part.y == 1][score].to_numpy(), part[part.y == 0][score].to_numpy()
            assert found[g] == pytest.approx(np.mean((pos[:, None] > neg) + (pos[:, None] == neg) / 2))
            at = sorted(set(part[score]), reverse=True)
            assert hits[g] == pytest.approx(sum((pos == t).sum() * (pos >= t).sum() / (part[score] >= t).sum() for t in at) / len(pos))
    rho = {r["g"]: r["rho"] for r in metrics.spearman(df, ["g"], "s", "z").collect()}
    for g, part in frame.groupby("g"):
        assert rho[g] == pytest.approx(part["s"].rank().corr(part["z"].rank()))


def test_nearest_looks_beyond_the_inner_ring(spark):
    points = spark.createDataFrame([("c", 1, 45.0, 9.0), ("c", 2, 45.1, 9.0), ("c", 3, 46.0, 9.0), ("c", 4, None, 9.0)], "city string, point_id int, lat double, lon double")
    features = spark.createDataFrame([("c", 7, 45.0002, 9.0), ("c", 8, 45.0002, 9.0), ("c", 9, 45.102, 9.0)], "city string, fid int, lat double, lon double")
    found = {r["point_id"]: (r["nearest_id"], r["dist"]) for r in near.nearest_within(points, features, ["city", "point_id"], "fid", 250.0).collect()}
    assert found[1][0] == 7 and found[2][0] == 9 and 200 < found[2][1] < 250
    assert found[3] == (None, None) and found[4] == (None, None)


def test_ladder_of_few_directions(spark):
    ways = [("seattle", "msp", "loco"), ("msp", "msp", None), ("dc+msp+seattle", "pittsburgh", "pittsburgh"), ("msp", "pittsburgh", None)]
    found = spark.createDataFrame([w[:2] for w in ways], "s string, t string").select(reports.direction_block(F.col("s"), F.col("t"))).collect()
    assert [r[0] for r in found] == [w[2] for w in ways]
    directions = spark.createDataFrame([("loco", "a", 0.6, 0.7), ("loco", "a", 0.8, None), ("loco", "base", 0.5, 0.5)], "block string, rung string, seed_mean double, ensemble double")
    paired = spark.createDataFrame([("loco", "a", 0.1, "better", 0.01), ("loco", "a", -0.1, "worse", 0.01)], "block string, rung string, delta double, verdict string, p_holm double")
    a, base = (r.asDict() for r in reports.ladder(directions, paired, ["block", "rung"]).orderBy("rung").collect())
    assert (a["n_directions"], a["best"], a["mean_ensemble"], a["n_better"], a["n_worse"], a["n_clear"], a["overall"]) == (2, 0.8, 0.7, 1, 1, 1, "mixed")
    assert a["std"] == pytest.approx(0.02**0.5) and (a["delta_min"], a["delta_max"]) == (-0.1, 0.1)
    assert base["std"] == 0.0 and base["delta_mean"] is None and base["n_better"] is None and base["overall"] is None


def test_places_by_steps(spark):
    rows = [("a", i, (i * 37) % 11 - 5) for i in range(60)] + [("b", 1, 0), ("c", 2, None), ("c", 3, None)]
    df = spark.createDataFrame(rows, "g string, i int, x int")
    found = {r["i"]: (r["k"], r["n"]) for r in reports.placed(df, ["g"], metrics.number_step(F.col("x")), ["x", "i"], "k", "n").filter("g = 'a'").collect()}
    expected = sorted((x, i) for g, i, x in rows if g == "a")
    assert found == {i: (k, 60) for k, (_, i) in enumerate(expected, 1)}
    others = reports.placed(df, ["g"], metrics.number_step(F.col("x")), ["x", "i"], "k", "n").filter("g <> 'a'").orderBy("i").collect()
    assert [(r["i"], r["k"], r["n"]) for r in others] == [(1, 1, 1), (2, 1, 2), (3, 2, 2)]
