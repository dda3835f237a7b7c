"""Unions of squares around many points: shared pieces, no row for a pair."""

import numpy as np
import pytest

from streetgrid.operators import footprints, squares, tiles
from streetgrid.plans import catalogue


def _one_by_one(p, f, r):
    """Each point's union of its own."""
    x, y = tiles.flat_xy(p, f)
    h, out = f["half"], []
    for i, ok in enumerate(~np.isnan(p["lat"])):
        k = np.flatnonzero((np.abs(x[i]) < r + h) & (np.abs(y[i]) < r + h))
        corners = lambda u, v, h: [(u - h, v - h), (u + h, v - h), (u + h, v + h), (u - h, v + h)]
        out.append(footprints.union_in_circle([[corners(*s)] for s in zip(x[i][k], y[i][k], h[k], strict=True)], r) if ok else 0.0)
    return np.array(out)


def _tile(lat, lon, n, m, step=0.0, seed=1):
    """Points of a tile of 130 m and squares in it and around it; with a ``step`` their sides meet in a grid."""
    rnd = np.random.default_rng(seed)
    snap = (lambda v: np.round(v / step) * step) if step else (lambda v: v)
    at = lambda x, y: {"lat": lat + y / 110540, "lon": (lon + x / 111320 / np.cos(np.radians(lat)) + 180) % 360 - 180}
    p, f = at(*rnd.uniform(0, 130, (2, n))), at(*snap(rnd.uniform(-130, 260, (2, m))))
    return p, f | {"half": snap(rnd.integers(5, 30, m).astype(float))}


@pytest.mark.parametrize(
    ("lat", "lon", "m", "step"),
    [(44.95, -93.2, 3, 0), (44.95, -93.2, 40, 0), (-38.9, -77.02, 300, 0), (44.95, -93.2, 200, 4.0), (78.0, 10.0, 120, 0), (60.0, 179.999, 60, 0), (89.9, 0.0, 40, 0), (0.0, 0.0, 0, 0)],
)
def test_as_each_union_of_its_own(lat, lon, m, step):
    p, f = _tile(lat, lon, 25, m, step)
    p["lat"][3] = np.nan
    if m > 4:
        f["half"][2], f["lat"][4] = np.nan, np.nan
    known = ~(np.isnan(f["half"]) | np.isnan(f["lat"]))
    want = _one_by_one(p, {c: v[known] for c, v in f.items()}, 100.0)
    # The unions one by one leave stripes of less than 1e-10 m out.
    assert squares.areas_in_circles(p, f, 100.0) == pytest.approx(want, abs=1e-7)


def test_known_areas():
    p = {"lat": np.array([45.0, 45.0, 46.0]), "lon": np.array([7.0, 7.0, 7.0])}
    alone = lambda *half: {"lat": np.full(len(half), 45.0), "lon": np.full(len(half), 7.0), "half": np.array(half, float)}
    assert squares.areas_in_circles(p, alone(10, 10, 3), 100.0).tolist() == [400.0, 400.0, 0.0]
    assert squares.areas_in_circles(p, alone(0, -5), 100.0).tolist() == [0.0, 0.0, 0.0]
    assert squares.areas_in_circles(p, alone(500), 100.0)[:2] == pytest.approx(np.pi * 10_000)


def test_around_the_pole():
    """Where a degree east has next to no metres, points do not share cells with those further away."""
    rnd = np.random.default_rng(4)
    p = {"lat": np.array([90.0, 89.99999, 89.9999, 89.9995, 89.999]), "lon": np.array([0.0, 5.0, 90.0, 170.0, -60.0])}
    f = {"lat": 89.999 + rnd.random(30) * 1e-3, "lon": rnd.uniform(-180, 180, 30), "half": np.full(30, 9.0)}
    # Slivers that the unions one by one leave out are many here.
    assert squares.areas_in_circles(p, f, 100.0) == pytest.approx(_one_by_one(p, f, 100.0), abs=1e-6)


def test_sides_that_change_with_latitude(monkeypatch):
    """Two squares that touch for the points of the north only, so that these have other pieces than those of the south."""
    lat = 45.0 + np.arange(9) * 10 / 110540
    p = {"lat": lat, "lon": np.full(9, 7.0)}
    apart = 30.0 / 111320 / np.cos(np.radians(lat[4]))
    f = {"lat": np.array([lat[4]] * 2), "lon": np.array([7.0, 7.0 + apart]), "half": np.array([14.0, 16.0])}
    calls, real = [], squares._stripes
    monkeypatch.setattr(squares, "_stripes", lambda *a: calls.append(real(*a)) or calls[-1])
    found = squares.areas_in_circles(p, f, 100.0)
    assert len(calls) > 1 and len(calls[0][1]) and not len(calls[-1][1])
    overlap = np.maximum(30.0 - apart * 111320 * np.cos(np.radians(lat)), 0.0) * 28
    assert overlap[0] == 0 < overlap[-1]
    assert found == pytest.approx(28.0**2 + 32.0**2 - overlap, abs=1e-9)


@pytest.mark.parametrize(("name", "value"), [("ROWS_AT_ONCE", 50), ("PAIRS_AT_ONCE", 8), ("FEW", 1), ("FEW", 10_000)])
def test_sizes_do_not_matter(monkeypatch, name, value):
    p, f = _tile(44.95, -93.2, 30, 150)
    want = squares.areas_in_circles(p, f, 100.0)
    monkeypatch.setattr(squares, name, value)
    assert squares.areas_in_circles(p, f, 100.0) == pytest.approx(want, abs=1e-9)


def test_pieces_do_not_grow_with_crowding(monkeypatch):
    """Where squares cover a place many times over, the points of a tile share few pieces."""
    pieces, real = [], squares._inside
    monkeypatch.setattr(squares, "_inside", lambda p, piece, *a: pieces.append(len(piece["cell"])) or real(p, piece, *a))
    p, f = _tile(44.95, -93.2, 200, 4000)
    assert squares.areas_in_circles(p, f, 100.0) == pytest.approx(np.pi * 10_000)
    assert sum(pieces) < 2000
    # Squares beside each other with one side in common.
    column = {"lat": np.repeat(44.95, 3000) + np.arange(3000) * 1e-7, "lon": np.full(3000, -93.2), "half": np.full(3000, 20.0)}
    pieces.clear()
    squares.areas_in_circles(p, column, 100.0)
    assert sum(pieces) < 2000


def test_no_row_for_a_pair(spark, sf_dir):
    plan = catalogue.QUERIES["area_union_frac"](spark, sf_dir)._jdf.queryExecution().toString()
    assert "Join" not in plan and "collect_list" not in plan


def test_points_without_a_place(spark):
    points = spark.createDataFrame([("a", 1, 45.0, 7.0), ("a", 2, None, 7.0), ("b", 1, 45.0, 7.0)], "city string, point_id long, lat double, lon double")
    found = squares.union_areas(points, spark.createDataFrame([("a", 45.0, 7.0, 10), ("a", 45.0, 7.0, 4), ("a", None, 7.0, 9)], "city string, lat double, lon double, half int"), ["city", "point_id"], "half", 100.0, 30.0)
    assert sorted(tuple(r) for r in found.collect()) == [("a", 1, 400.0), ("a", 2, 0.0), ("b", 1, 0.0)]
