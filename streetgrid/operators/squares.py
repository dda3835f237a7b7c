"""Exact area that axis-parallel squares cover together inside the circle of each of many points, overlaps once.

A tile's plane is cut into cells until each is covered by one square or meets few. Cells of few squares are cut into stripes
at the squares' north and south sides; inside a stripe what is covered are stretches from one square's west side to another's
east side. Points share these pieces: no row, and no union of its own, is made for a pair of a point and a square.

Squares are flat in each point's own metres, so in degrees they are the wider the smaller the cosine of its latitude. A piece
therefore names the squares whose sides bound it, and it serves points for which the same squares bound it. A side's place is
linear in the degrees that a metre has, so two ends of a range tell for all points between. Cells that need other pieces for
some points are worked out again for each half of the points.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geo import METRES_LAT, METRES_LON
from . import tiles

#: Squares that a cell may meet without being cut again, and metres below which no cell is cut.
FEW, FINEST = 12, 0.5
#: Cosines of latitude whose points share cells differ by this factor at most.
ALIKE = 1.01
#: Rows (stripe, square), and pairs (point, piece), that are worked on at once.
ROWS_AT_ONCE, PAIRS_AT_ONCE = 1 << 18, 1 << 14

Arrays = tiles.Arrays


def _sides(q: Arrays, span: tuple[float, float]) -> Arrays:
    """West and east sides in degrees where a metre has the fewest (``w0``, ``e0``) and the most (``w1``, ``e1``), south and north ones in metres."""
    x, y, h = q["x"], q["y"] * METRES_LAT, q["half"]
    return {"w0": x - h * span[0], "e0": x + h * span[0], "w1": x - h * span[1], "e1": x + h * span[1], "s": y - h, "n": y + h}


def _new(*columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before it."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return new


def _largest(group: np.ndarray, *score: np.ndarray) -> np.ndarray:
    """Place of the row with the largest score in its group (later scores decide between equals), for each row; rows of a group lie together."""
    order = np.lexsort((*score[::-1], group))
    new = _new(group)
    last = np.append(np.flatnonzero(new)[1:], len(group)) - 1
    return order[last][np.cumsum(new) - 1]


def _cells(side: Arrays, box: np.ndarray, per_degree: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Cells (west, east, south, north) covered by one square for all points, cells of few squares, and rows (cell, square) of these."""
    whole, few, rows, n = [], [], [], 0
    cells, cell, sq = box[None, :], np.zeros(len(side["s"]), int), np.arange(len(side["s"]))
    while len(cells):
        w, e, s, n_ = cells[cell].T
        hit = (side["w1"][sq] < e) & (side["e1"][sq] > w) & (side["s"][sq] < n_) & (side["n"][sq] > s)
        cell, sq, w, e, s, n_ = (v[hit] for v in (cell, sq, w, e, s, n_))
        west, east, south, north = side["w0"][sq] <= w, side["e0"][sq] >= e, side["s"][sq] <= s, side["n"][sq] >= n_
        covered = np.bincount(cell[west & east & south & north], minlength=len(cells)) > 0
        whole.append(cells[covered])
        small = np.maximum((cells[:, 1] - cells[:, 0]) * per_degree, cells[:, 3] - cells[:, 2]) < FINEST
        many = ~covered & ~small & (np.bincount(cell, minlength=len(cells)) > FEW)
        # The square with the most of a cell hides those that have no more of it on any side for any point.
        keep = ~covered[cell]
        k = np.flatnonzero(many[cell])
        if len(k):
            of = sq[k]
            sides = [-np.maximum(side["w0"][of], w[k]), -np.maximum(side["w1"][of], w[k]), np.minimum(side["e0"][of], e[k]), np.minimum(side["e1"][of], e[k]), -np.maximum(side["s"][of], s[k]), np.minimum(side["n"][of], n_[k])]
            best = _largest(cell[k], (sides[2] + sides[0]) * (sides[4] + sides[5]))
            keep[k[np.logical_and.reduce([v <= v[best] for v in sides]) & (best != np.arange(len(k)))]] = False
        cell, sq = cell[keep], sq[keep]
        met = np.bincount(cell, minlength=len(cells))
        many &= met > FEW
        done = ~many & ~covered & (met > 0)
        number = np.cumsum(done) - 1 + n
        few.append(cells[done])
        mine = done[cell]
        rows.append(np.column_stack([number[cell[mine]], sq[mine]]))
        n += int(done.sum())
        mine, number = many[cell], np.cumsum(many) - 1
        w, e, s, n_ = cells[many].T
        x, y, k = (w + e) / 2, (s + n_) / 2, len(w)
        cells = np.concatenate([np.column_stack(c) for c in ((w, x, s, y), (x, e, s, y), (w, x, y, n_), (x, e, y, n_))])
        cell, sq = np.concatenate([number[cell[mine]] + i * k for i in range(4)]), np.tile(sq[mine], 4)
    rows = np.concatenate(rows)
    return np.concatenate(whole), np.concatenate(few), rows[:, 0], rows[:, 1]


#: What a piece is: west and east sides (degrees, metres beside these) inside its cell (degrees), south and north ones (degrees, metres), and its cell.
PIECE = ("wd", "wm", "ed", "em", "cw", "ce", "sd", "sm", "nd", "nm", "cell")


def _whole(cells: np.ndarray) -> Arrays:
    """Pieces of covered cells."""
    zero, w, e, s, n = np.zeros(len(cells)), *cells.T
    return dict(zip(PIECE, (zero, zero - np.inf, zero, zero + np.inf, w, e, zero, s, zero, n, zero - 1), strict=True))


def _stripes(q: Arrays, side: Arrays, cells: np.ndarray, cell: np.ndarray, sq: np.ndarray) -> tuple[Arrays, np.ndarray]:
    """Pieces of the cells, and the cells where the points do not all have the same pieces (these have none here)."""
    # Sides in metres north; those of cells have no degrees.
    s, n, every = cells[cell, 2], cells[cell, 3], np.arange(len(cells))
    low, high, h, y = side["s"][sq], side["n"][sq], q["half"][sq], q["y"][sq]
    at = np.concatenate([np.maximum(low, s), np.minimum(high, n), cells[:, 2], cells[:, 3]])
    of = np.concatenate([cell, cell, every, every])
    none = np.zeros(2 * len(cells))
    degrees = np.concatenate([np.where(low > s, y, 0.0), np.where(high < n, y, 0.0), none])
    metres = np.concatenate([np.where(low > s, -h, s), np.where(high < n, h, n), cells[:, 2], cells[:, 3]])
    order = np.lexsort((at, of))
    new = _new(of[order], at[order])
    place = np.empty(len(at), int)
    place[order] = np.cumsum(new) - 1
    of, degrees, metres = (v[order][new] for v in (of, degrees, metres))
    first, last = place[: len(sq)], place[len(sq) : 2 * len(sq)]
    # Squares by their east sides: a running maximum of places tells which reaches farthest.
    by_east = np.lexsort((side["e0"], side["e1"]))
    east_place = np.empty(len(by_east), int)
    east_place[by_east] = np.arange(len(by_east))
    active = np.cumsum(np.bincount(first, minlength=len(of)) - np.bincount(last, minlength=len(of)))
    ends = np.searchsorted(np.cumsum(active), np.arange(ROWS_AT_ONCE, active.sum(), ROWS_AT_ONCE))
    bounds = np.unique(np.concatenate([[0], ends, [len(of)]]))
    found, bad = [], np.zeros(len(cells), bool)
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        some = np.flatnonzero((first < b) & (last > a))
        start = np.maximum(first[some], a)
        count = np.minimum(last[some], b) - start
        if not count.sum():
            continue
        stripe = np.repeat(start - np.cumsum(count) + count, count) + np.arange(count.sum())
        j = np.repeat(sq[some], count)
        order = np.lexsort((side["w0"][j], side["w1"][j], stripe))
        stripe, j = stripe[order], j[order]
        best = by_east[np.maximum.accumulate(stripe * len(by_east) + east_place[j]) - stripe * len(by_east)]
        new = _new(stripe)
        new[1:] |= side["w1"][j[1:]] > side["e1"][best[:-1]]
        begin = np.flatnonzero(new)
        end = np.append(begin[1:], len(j)) - 1
        one, two = q["like"][j[begin]], q["like"][best[end]]
        joined = new.copy()
        joined[1:] |= side["w0"][j[1:]] <= side["e0"][best[:-1]]
        same = np.logical_and.reduceat(joined, begin) & (np.minimum.reduceat(side["w0"][j], begin) >= side["w0"][one]) & (np.maximum.reduceat(side["e0"][j], begin) <= side["e0"][two])
        bad[of[stripe[begin[~same]]]] = True
        found.append(np.column_stack([of[stripe[begin]], one, two, stripe[begin]]))
    found = np.concatenate(found) if found else np.zeros((0, 4), int)
    found = found[~bad[found[:, 0]]]
    # Stripes on top of each other with the same sides are one piece.
    found = found[np.lexsort(found.T[[3, 2, 1, 0]])]
    begin = np.flatnonzero(_new(*found.T[:3], found[:, 3] - np.arange(len(found))))
    top = found[np.append(begin[1:], len(found))[: len(begin)] - 1, 3] + 1
    c, one, two, stripe = found[begin].T
    values = (q["x"][one], -q["half"][one], q["x"][two], q["half"][two], cells[c, 0], cells[c, 1], degrees[stripe], metres[stripe], degrees[top], metres[top], c)
    return dict(zip(PIECE, values, strict=True)), np.flatnonzero(bad)


def _inside(p: Arrays, piece: Arrays, lat0: float, r: float, most: float) -> np.ndarray:
    """Sum over the pieces of their areas inside the circle of each point; a metre has at most ``most`` degrees east."""
    west = np.maximum(piece["wd"] + piece["wm"] * most, piece["cw"])
    east = np.minimum(piece["ed"] + piece["em"] * most, piece["ce"])
    south, north = piece["sd"] * METRES_LAT + piece["sm"], piece["nd"] * METRES_LAT + piece["nm"]
    middle = {"lon": (west + east) / 2, "lat": (south + north) / 2 / METRES_LAT + lat0}
    reach = r + np.maximum((east - west) / 2 * METRES_LON, (north - south) / 2)
    out = np.zeros(len(p["x"]))
    for i, j in tiles.blocks({"lat": p["lat"], "lon": p["x"]}, middle, reach, PAIRS_AT_ONCE):
        x, y, cos = p["x"][i, None], p["y"][i, None], p["cos"][i, None]
        east_of = lambda d: (piece[d][j] - x) * METRES_LON * cos  # noqa: B023, E731
        x0 = np.maximum(east_of("wd") + piece["wm"][j], east_of("cw"))
        x1 = np.minimum(east_of("ed") + piece["em"][j], east_of("ce"))
        y0, y1 = ((piece[d][j] - y) * METRES_LAT + piece[m][j] for d, m in (("sd", "sm"), ("nd", "nm")))
        out[i] = tiles.boxes_in_circle(x0, y0, x1, y1, r)
    return out


def _halves(p: Arrays) -> list[Arrays]:
    """The first and the last half of points, which lie in order of the cosine."""
    k = len(p["lat"]) // 2
    return [{c: v[:k] for c, v in p.items()}, {c: v[k:] for c, v in p.items()}]


def _alike(p: Arrays, q: Arrays, r: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of points and parts of their areas; all parts of a point's area add up."""
    lat0, lon0 = p["lat"][0], p["lon"][0]
    p, q = ({**a, "x": tiles.degrees_east(a["lon"], lon0), "y": a["lat"] - lat0} for a in (p, q))
    # Squares with the same west and east sides count as one there.
    order, q["like"] = np.lexsort((q["half"], q["x"])), np.empty(len(q["x"]), int)
    new = _new(q["x"][order], q["half"][order])
    q["like"][order] = order[new][np.cumsum(new) - 1]
    span = lambda p: (1 / (METRES_LON * p["cos"][-1]), 1 / (METRES_LON * p["cos"][0]))
    least, most = span(p)
    y = p["y"] * METRES_LAT
    box = np.array([p["x"].min() - r * most, p["x"].max() + r * most, y.min() - r, y.max() + r])
    whole, cells, cell, sq = _cells(_sides(q, (least, most)), box, 1 / most)
    yield p["at"], _inside(p, _whole(whole), lat0, r, most)
    todo = [(p, cells, cell, sq)]
    while todo:
        p, cells, cell, sq = todo.pop()
        least, most = span(p)
        piece, bad = _stripes(q, _sides(q, (least, most)), cells, cell, sq)
        yield p["at"], _inside(p, piece, lat0, r, most)
        if len(bad):
            number = np.full(len(cells), -1)
            number[bad] = np.arange(len(bad))
            mine = number[cell] >= 0
            todo += [(half, cells[bad], number[cell[mine]], sq[mine]) for half in _halves(p)]


def areas_in_circles(points: Arrays, squares: Arrays, r: float) -> np.ndarray:
    """Area that ``squares`` (lat, lon, half in metres) cover together within ``r`` metres of each of the ``points``; 0 for points without a place."""
    area = np.zeros(len(points["lat"]))
    known = np.flatnonzero(~(np.isnan(points["lat"]) | np.isnan(points["lon"])))
    there = (squares["half"] > 0) & ~(np.isnan(squares["lat"]) | np.isnan(squares["lon"]))
    if not len(known) or not there.any():
        return area
    lat, lon, half = (squares[c][there] for c in ("lat", "lon", "half"))
    # Of squares around one place the largest holds the others.
    order = np.lexsort((half, lon, lat))
    order = order[np.append(_new(lat[order], lon[order])[1:], True)]
    q = {"lat": lat[order], "lon": lon[order], "half": half[order]}
    cos = np.abs(np.cos(np.radians(points["lat"])))
    known = known[np.argsort(cos[known], kind="stable")]
    todo = [{"lat": points["lat"][known], "lon": points["lon"][known], "cos": cos[known], "at": known}]
    while todo:
        p = todo.pop()
        around = np.abs(tiles.degrees_east(p["lon"], p["lon"][0])).max() + (r + half.max()) / (METRES_LON * p["cos"][0])
        if len(p["at"]) > 1 and (around > 180 or p["cos"][-1] > ALIKE * p["cos"][0]):
            todo += _halves(p)
            continue
        for at, part in _alike(p, q, r):
            area[at] += part
    return area


def union_areas(points: DataFrame, squares: DataFrame, key: list[str], half: str, r: float, most: float, name: str = "area_m2") -> DataFrame:
    """(*key, area) for every point: what the squares of its ``key[0]`` cover together within ``r`` metres, 0 where there is none.

    ``half``: half a side in metres, at most ``most``; squares are axis-parallel and flat in the point's metres.
    """
    some = squares.select(key[0], "lat", "lon", F.col(half).cast("double").alias("half"))
    return tiles.over_tiles(points, some, key, r + most, lambda p, f: {name: areas_in_circles(p, f, r)}, f"{name} double", by=key[0])
