"""Vector tables, projections and unions of footprints."""

import math
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from streetgrid.functions import utm
from streetgrid.operators import footprints
from streetgrid.sources import files, vector

SQUARE = [(0, 0), (10, 0), (10, 10), (0, 10), (0, 0)]


def moved(ring, dx, dy, k=1.0):
    return [(x * k + dx, y * k + dy) for x, y in ring]


@pytest.mark.parametrize(
    ("polygons", "area"),
    [
        ([[SQUARE]], 100),
        ([[SQUARE], [SQUARE]], 100),
        ([[SQUARE], [moved(SQUARE, 2, 2, 0.5)]], 100),
        ([[SQUARE], [moved(SQUARE, 5, 5)]], 175),
        ([[SQUARE], [moved(SQUARE, 10, 0)]], 200),
        ([[SQUARE], [moved(SQUARE, 10, 10)]], 200),
        ([[SQUARE, moved(SQUARE, 2, 2, 0.5)]], 75),
        ([[SQUARE, moved(SQUARE, 2, 2, 0.5)], [moved(SQUARE, 3, 3, 0.1)]], 76),
        ([[[(0, 0), (10, 10), (10, 0)]], [[(0, 10), (10, 0), (0, 0)]]], 75),
        ([[moved(SQUARE, -500, -500, 100)]], math.pi * 900),
        ([[moved(SQUARE, 0, -500, 100)]], math.pi * 450),
        ([[moved(SQUARE, -500, -500, 100), moved(SQUARE, 0, 0)]], math.pi * 900 - 100),
        ([[moved(SQUARE, 100, 0)]], 0),
        ([], 0),
        ([[[(5, 5)]], [[(1, 1), (2, 2)]]], 0),
    ],
)
def test_union_in_circle(polygons, area):
    assert footprints.union_in_circle(polygons, 30.0) == pytest.approx(area, abs=1e-9)


def test_union_of_many(spark):
    """Turned triangles and boxes that overlap at random, against a fine grid."""
    rnd = np.random.default_rng(2)
    shapes = []
    for _ in range(25):
        n = rnd.integers(3, 6)
        angle = np.sort(rnd.random(n)) * 2 * math.pi
        c, r = rnd.uniform(-35, 35, 2), rnd.uniform(3, 15)
        shapes.append([list(zip((c[0] + r * np.cos(angle)).tolist(), (c[1] + r * np.sin(angle)).tolist(), strict=True))])
    found = footprints.union_in_circle(shapes, 30.0)
    k = 1500
    at = (np.arange(k) + 0.5) / k * 60 - 30
    gx, gy = np.meshgrid(at, at)
    covered = np.zeros(gx.shape, bool)
    for (ring,) in shapes:
        odd = np.zeros(gx.shape, bool)
        for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1], strict=True):
            if ay != by:
                odd ^= ((ay > gy) != (by > gy)) & (gx < ax + (gy - ay) / (by - ay) * (bx - ax))
        covered |= odd
    want = (covered & (gx**2 + gy**2 <= 900)).sum() * (60 / k) ** 2
    assert found == pytest.approx(want, rel=2e-3)
    rows = [(1, [[{"x": x, "y": y} for x, y in s[0]]]) for s in shapes] + [(None, [[{"x": x * 1.0, "y": y * 1.0} for x, y in SQUARE]])]
    df = spark.createDataFrame(rows, "k int, rings array<array<struct<x: double, y: double>>>")
    got = {r["k"]: r["area_m2"] for r in footprints.union_areas(df, ["k"], "rings", 30.0).collect()}
    assert got[1] == pytest.approx(found) and got[None] == pytest.approx(100)


def test_utm(spark):
    """Known places: the arc to 45°, the edge of a zone on the equator, and the way back."""
    rows = [(45.0, 3.0, 3.0), (0.0, 6.0, 3.0), (43.642567, -79.387139, -81.0), (70.0, 25.0, 27.0)]
    df = spark.createDataFrame(rows, "lat double, lon double, lon0 double")
    x, y = utm.utm_xy(F.col("lat"), F.col("lon"), F.col("lon0"))
    df = df.withColumns({"x": x, "y": y})
    lat, lon = utm.utm_latlon(F.col("x"), F.col("y"), F.col("lon0"))
    a, b, tower, d = df.withColumns({"lat2": lat, "lon2": lon, "zone": utm.zone(F.col("lon"))}).collect()
    assert (a["x"], a["y"]) == pytest.approx((500_000.0, 4_982_950.4002), abs=1e-3)
    assert (b["x"], b["y"]) == pytest.approx((833_978.5569, 0.0), abs=1e-3)
    assert (round(tower["x"]), round(tower["y"])) == (630084, 4833439) and (tower["zone"], d["zone"]) == (17, 35)
    for r in (a, b, tower, d):
        assert (r["lat2"], r["lon2"]) == pytest.approx((r["lat"], r["lon"]), abs=1e-9)


def big(kind, *numbers):
    return struct.pack(">BI", 0, kind) + b"".join(struct.pack(">I" if isinstance(n, int) else ">d", n) for n in numbers)


def test_parse_wkb():
    line = struct.pack("<BII", 1, 2, 2) + struct.pack("<4d", 1, 2, 3, 4)
    kind, parts = vector.parse_wkb(line)
    assert kind == "LineString" and parts[0][0].tolist() == [[1, 2], [3, 4]]
    assert vector.parse_wkb(big(1, 5.0, 6.0))[1][0][0].tolist() == [[5, 6]]
    assert vector.parse_wkb(big(1003, 1, 3, *[1.0, 2.0, 9.0] * 3))[1][0][0].tolist() == [[1, 2]] * 3
    tagged = struct.pack("<BII", 1, 0x20000001, 4326) + struct.pack("<2d", 7, 8)
    assert vector.parse_wkb(tagged)[1][0][0].tolist() == [[7, 8]]
    several = struct.pack("<BII", 1, 5, 2) + line + line
    assert len(vector.parse_wkb(several)[1]) == 2
    assert vector.parse_wkb(struct.pack("<BII", 1, 3, 0)) == ("Polygon", [])
    assert vector.parse_wkb(struct.pack("<BI2d", 1, 1, math.nan, math.nan)) == ("Point", [])
    for broken in (None, b"", b"\x01", line[:-3], b"\x01\xff\x00\x00\x00" + line):
        assert vector.parse_wkb(broken) is None


@pytest.fixture
def shapes(spark):
    ring = lambda *p: [{"x": float(x), "y": float(y)} for x, y in p]
    rows = [(i, "27" if i % 2 else "53", [[ring(*moved(SQUARE, i * 20, 0)), ring(*moved(SQUARE, i * 20 + 2, 2, 0.5))]]) for i in range(50)]
    rows += [(90, "27", []), (91, "27", None)]
    return spark.createDataFrame(rows, "id int, state string, parts array<array<array<struct<x: double, y: double>>>>")


@pytest.mark.parametrize("stored", [True, False])
def test_filters_reach_the_scan(spark, shapes, tmp_path, stored):
    path = f"{tmp_path}/polygons"
    if stored:
        vector.write_vectors(shapes, "Polygon", path)
    else:
        vector.encode_wkb(shapes, "Polygon").write.parquet(path)
    found = vector.scan_vectors(spark, path, box=(105.0, -5.0, 225.0, 5.0), where=F.col("state") == "27", columns=["id"])
    assert sorted(r["id"] for r in found.collect()) == [5, 7, 9, 11]
    assert found.columns == ["id", "kind", "parts"]
    spark.conf.set("spark.sql.maxMetadataStringLength", 10_000)
    found = found.filter(F.lit(True))
    plan = found._jdf.queryExecution().executedPlan().toString()
    pushed = plan[plan.index("PushedFilters") :].split("]")[0]
    assert "EqualTo(state,27)" in pushed and ("LessThanOrEqual(xmin,225.0)" in pushed) == stored
    holes = found.filter("id = 7").first()["parts"]
    assert len(holes) == 1 and [len(r) for r in holes[0]] == [5, 5] and holes[0][1][0].asDict() == {"x": 142.0, "y": 2.0}
    whole = vector.scan_vectors(spark, path)
    assert whole.count() == 50


def test_unknown_system(spark, shapes):
    with pytest.raises(ValueError):
        vector.to_wgs84(shapes, 2154)


def test_feed_elements_and_log(spark, tmp_path):
    (tmp_path / "feed").mkdir()
    (tmp_path / "feed" / "stops.txt").write_text("stop_id, stop_name\n7,a\n08,b\n")
    read = files.read_gtfs(spark, f"{tmp_path}/feed", {"stops": "stop_id string, stop_name string"})
    assert [r["stop_id"] for r in read["stops"].collect()] == ["7", "08"]
    with pytest.raises(Exception, match="(?i)path"):
        files.read_gtfs(spark, f"{tmp_path}/feed", {"stops": "stop_id string", "trips": "trip_id string"})
    elements = spark.createDataFrame([(1, 4.0, 5.0, None), (2, None, None, (6.0, 7.0)), (3, None, None, None)], "id int, lat double, lon double, center struct<lat: double, lon: double>")
    assert [tuple(r) for r in files.element_points(elements).orderBy("id").collect()] == [(1, 4.0, 5.0), (2, 6.0, 7.0)]
    for ts in ("2024-01-02", "2024-01-01"):
        files.append_log(spark.createDataFrame([("run", ts)], "run string, ts string"), f"{tmp_path}/log")
    assert spark.read.json(f"{tmp_path}/log").count() == 2
