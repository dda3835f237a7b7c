"""Vector blocks with ids, bundles, pairs of runs, columns of captions, tiles and numbered lines, on small tables worked out by hand."""

import json
import math

import pytest
from pyspark.sql import functions as F

from streetgrid.functions import geo
from streetgrid.operators import agreement, alignment, runlog
from streetgrid.sources import bundles, files

V, IDS = "block string, row long, vector array<float>", "block string, row long, point_id long"


def test_ids_beside_vectors(spark):
    v = spark.createDataFrame([("a", 0, [3.0, 4.0]), ("a", 1, [0.0, 0.0]), ("b", 0, [2.0, 0.0])], V)
    ids = spark.createDataFrame([("a", 1, 70), ("a", 0, 7), ("b", 0, 7)], IDS)
    found = {(r.block, r.point_id): r.vector for r in alignment.with_ids(v, ids, ["block"]).collect()}
    assert found == {("a", 7): [pytest.approx(0.6), pytest.approx(0.8)], ("a", 70): [0.0, 0.0], ("b", 7): [1.0, 0.0]}
    assert alignment.with_ids(v.limit(0), ids.limit(0), ["block"]).count() == 0


@pytest.mark.parametrize("ids", [[("a", 0, 7)], [("a", 0, 7), ("a", 1, 8), ("a", 2, 9)], [("a", 0, 7), ("a", 1, 8), ("a", 1, 8)]])
def test_ids_that_do_not_fit(spark, ids):
    v = spark.createDataFrame([("a", 0, [3.0, 4.0]), ("a", 1, [0.0, 1.0])], V)
    with pytest.raises(ValueError, match="do not fit"):
        alignment.with_ids(v, spark.createDataFrame(ids, IDS), ["block"])


def test_align(spark):
    """The last vector of a repeated id counts; points keep their rows; a gap is an error only where asked."""
    points = spark.createDataFrame([("dc", i) for i in range(12)] + [(None, 3)], "city string, point_id long")
    block = spark.createDataFrame([("dc", 1, 0, [1.0]), ("dc", 1, 5, [2.0]), ("dc", 99, 6, [3.0])], "city string, point_id long, row long, vector array<double>")
    found = alignment.align(points, block).collect()
    assert len(found) == 13 and [(r.point_id, r.vector) for r in found if r.present] == [(1, [2.0])]
    with pytest.raises(ValueError, match=r"\(None, 3\), \('dc', 0\), \('dc', 2\)") as e:
        alignment.align(points, block, missing=False)
    assert "('dc', 11)" not in str(e.value)
    assert alignment.align(points.filter("point_id = 1"), block, missing=False).count() == 1


def test_in_all(spark):
    key = "city string, point_id long"
    frame = lambda *rows: spark.createDataFrame(list(rows), key)
    points = frame(("dc", 1), ("dc", 2), ("msp", 1), ("msp", 2))
    found = alignment.in_all(points, frame(("dc", 1), ("dc", 1), ("msp", 2), ("dc", 2)), frame(("msp", 2), ("dc", 2), ("sea", 9)), frame(("dc", 2), ("dc", 1)))
    assert [tuple(r) for r in found.collect()] == [("dc", 2)]


RUN = "{}__cross_city__msp_to_dc__tier1__full__seed{}"


@pytest.mark.parametrize("few", [bundles.FEW_RUNS, 0])
def test_bundles(spark, tmp_path, few):
    """Runs of different targets in folders and in plain files; what is no run stays out; NaN labels are unknown."""
    rows = spark.createDataFrame([(RUN.format("siglip_lora_loco_v2_dc", 41), 1, 1.0, 0.5), (RUN.format("siglip_lora_loco_v2_dc", 41), 2, math.nan, 0.7), ("notes", 3, 1.0, 0.5)], "run_id string, point_id long, y__ramp double, logit__ramp double")
    bundles.write_bundles(rows, str(tmp_path))
    bundles.write_bundles(spark.createDataFrame([(RUN.format("clip", 7), 1, 5.0, math.nan), (RUN.format("clip", 7), 2, 6.0, 2.5)], "run_id string, point_id long, y__price double, logit__price double"), str(tmp_path))
    spark.createDataFrame([(8, 0.25)], "point_id long, logit__ramp double").coalesce(1).write.parquet(str(tmp_path / "aside"))
    next((tmp_path / "aside").glob("*.parquet")).rename(tmp_path / "siglip__in_city__msp+dc_to_dc__tier2__vision_only__seed9.parquet")
    found = sorted((r.family, r.backbone, r.evaluation, r.src, r.dst, r.tier, r.ablation, r.seed, r.target, r.point_id, r.y, r.logit) for r in bundles.read_bundles(spark, str(tmp_path), few).fillna(-1.0, ["y"]).collect())
    loco = ("siglip_lora_loco_v2", "siglip_lora_loco_v2_dc", "cross_city", "msp", "dc", 1, "full", 41, "ramp")
    assert found == [
        ("clip", "clip", "cross_city", "msp", "dc", 1, "full", 7, "price", 2, 6.0, 2.5),
        ("siglip", "siglip", "in_city", "msp+dc", "dc", 2, "vision_only", 9, "ramp", 8, -1.0, 0.25),
        (*loco, 1, 1.0, 0.5),
        (*loco, 2, -1.0, 0.7),
    ]


def test_names(spark):
    names = {RUN.format("siglip_lora_loco_dc", 1): "siglip_lora_loco", RUN.format("siglip_lora_loco_v2_dc", 1): "siglip_lora_loco_v2", RUN.format("siglip_lora", 1): "siglip_lora", "x": None, RUN.format("clip", 1) + "-bad": None, None: None}
    df = spark.createDataFrame([(n,) for n in names], "name string")
    assert {r.name: r.family for r in df.select("name", bundles.name_parts(F.col("name"))["family"].alias("family")).collect()} == names


def test_paired(spark):
    """First seeds of each backbone differ; the first run of one lacks a target and a point; other backbones do not count."""
    rows = [("a", 42, "t", 1, 1.0, 0.1), ("a", 43, "t", 1, 1.0, 0.9), ("a", 42, "t", 2, None, 0.2), ("a", 42, "t", 4, 0.0, 0.3), ("a", 43, "u", 1, 1.0, 0.4), ("b", 50, "t", 1, 1.0, 0.5), ("b", 50, "t", 2, 0.0, 0.6), ("b", 50, "u", 1, 1.0, 0.8), ("c", 1, "t", 4, 0.0, 0.7)]
    df = spark.createDataFrame([(b, "x", *r) for b, *r in rows], "backbone string, src string, seed int, target string, point_id long, y double, logit double")
    found = sorted((r.target, r.point_id, r.y, r.score_a, r.score_b, r.seed_a, r.seed_b) for r in runlog.paired(df, "a", "b", ["src"]).collect())
    assert found == [("t", 1, 1.0, 0.1, 0.5, 42, 50), ("t", 2, 0.0, 0.2, 0.6, 42, 50)]
    assert runlog.paired(df.limit(0), "a", "b", ["src"]).count() == 0


def test_one_hot(spark):
    """Columns follow the values in the table; another table can be given the same ones."""
    rows = agreement.validated(spark.createDataFrame([(1, "sidewalk=none, land_use=commercial|residential"), (2, "sidewalk=none, land_use=mixed, crosswalk=present"), (3, None)], "id long, answer string"))
    found = {r["id"]: r for r in agreement.one_hot(rows).collect()}
    columns = [c for c in agreement.one_hot(rows).columns if c.startswith("cap_sidewalk")]
    assert columns == ["cap_sidewalk__none", "cap_sidewalk__unknown", "cap_sidewalk_ord", "cap_sidewalk_known"]
    assert [found[1][f"cap_land_use__{v}"] for v in ("commercial", "mixed", "residential", "unknown")] == [1, 0, 1, 0]
    assert [found[i]["cap_sidewalk_ord"] for i in (1, 2, 3)] == [0, 0, -1] and [found[i]["cap_crosswalk_known"] for i in (1, 2, 3)] == [0, 1, 0]
    assert [found[i]["cap_unknown_count"] for i in (1, 2, 3)] == [8, 7, 10] and found[2]["cap_known_fraction"] == pytest.approx(0.3)
    other = agreement.one_hot(rows.filter("id = 3"), agreement.categories(rows))
    assert other.columns == agreement.one_hot(rows).columns and other.first()["cap_sidewalk__none"] == 0
    with pytest.raises(ValueError, match="land_use"):
        agreement.categories(rows, most=3)


def test_tiles(spark):
    """Against a plain loop: boxes of a step, the last ones cut; none of an area without extent."""
    areas = [(0.0, 0.0, 1.0, 0.5), (-80.1, 40.2, -79.95, 40.29), (5.0, 5.0, 5.0, 6.0), (5.0, 6.0, 6.0, 5.0)]
    for step in (0.25, 0.04, 3.0):
        got = spark.createDataFrame(areas, "w double, s double, e double, n double").select("w", "s", geo.tile_boxes(*(F.col(c) for c in "wsen"), step).alias("t")).collect()
        for (w, s, e, n), r in zip(areas, got, strict=True):
            rows = max(0, math.ceil((n - s) / step)) if e > w else 0
            cols = max(0, math.ceil((e - w) / step)) if n > s else 0
            plain = [(w + j * step, s + i * step, min(w + j * step + step, e), min(s + i * step + step, n)) for i in range(rows) for j in range(cols)]
            assert [tuple(t) for t in r.t] == [pytest.approx(p) for p in plain]


def test_line_numbers(spark, tmp_path):
    """Files read in many blocks; blank, broken and other lines are counted but not kept; an object without known fields stays."""
    lines = {f"{name}.jsonl": [json.dumps({"a": i, "file": name, "fill": "é" * (i % 50)}) if i % 5 else ("", "  ", '{"a": 1, "fi', "[1]", "7")[i // 5 % 5] for i in range(n)] for name, n in (("x", 700), ("y", 3), ("z", 0))}
    for name, rows in lines.items():
        (tmp_path / name).write_text("".join(r + "\n" for r in rows))
    (tmp_path / "w.jsonl").write_text("{}\nnull\n" + json.dumps({"a": 2, "file": "w"}))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        df = files.read_jsonl(spark, str(tmp_path), "a long, file string", "line")
        assert df.rdd.getNumPartitions() > 4
        found = sorted((r.file or "", r.a if r.a is not None else -1, r.line) for r in df.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert found == sorted([(n, i, i) for n, size in (("x", 700), ("y", 3)) for i in range(size) if i % 5] + [("", -1, 0), ("w", 2, 2)])
