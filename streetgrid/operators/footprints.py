"""Exact area of a union of polygons inside a circle.

The plane is cut into vertical slabs at every corner, every crossing of two edges and every crossing of an edge with the
circle. Inside a slab nothing crosses: what is covered are stripes between edges, and each stripe, clipped by the circle,
is a trapezoid or has arcs for sides, so its area is a closed form. Overlaps, holes and touching sides count once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Edges whose crossings are worked out at once.
EDGES_AT_ONCE = 512


def _edges(polygons: list) -> np.ndarray:
    """(polygon, x0, y0, x1, y1) of all edges of rings, left end first; vertical ones bound no stripe."""
    out = []
    for i, rings in enumerate(polygons):
        for ring in rings:
            p = np.asarray(ring, float).reshape(-1, 2)
            q = np.roll(p, -1, axis=0)
            turn = p[:, 0] > q[:, 0]
            a, b = np.where(turn[:, None], q, p), np.where(turn[:, None], p, q)
            keep = a[:, 0] < b[:, 0]
            out.append(np.column_stack([np.full(keep.sum(), i), a[keep], b[keep]]))
    return np.concatenate(out) if out else np.zeros((0, 5))


def _crossings(e: np.ndarray, r: float) -> np.ndarray:
    """x of the crossings of edges with each other and with the circle."""
    x0, y0, dx, dy = e[:, 1], e[:, 2], e[:, 3] - e[:, 1], e[:, 4] - e[:, 2]
    found = []
    with np.errstate(divide="ignore", invalid="ignore"):
        for k in range(0, len(e), EDGES_AT_ONCE):
            i = slice(k, k + EDGES_AT_ONCE)
            cross = dx[i, None] * dy - dy[i, None] * dx
            gx, gy = x0 - x0[i, None], y0 - y0[i, None]
            t, u = (gx * dy - gy * dx) / cross, (gx * dy[i, None] - gy * dx[i, None]) / cross
            meet = (cross != 0) & (t > 0) & (t < 1) & (u >= 0) & (u <= 1)
            found.append((x0[i, None] + t * dx[i, None])[meet])
        a, b, c = dx * dx + dy * dy, x0 * dx + y0 * dy, x0 * x0 + y0 * y0 - r * r
        root = np.sqrt(b * b - a * c)
        for t in ((-b - root) / a, (-b + root) / a):
            on = (t > 0) & (t < 1)
            found.append((x0 + t * dx)[on])
    return np.concatenate(found)


def union_in_circle(polygons: list, r: float) -> float:
    """Area that ``polygons`` (each a list of rings of (x, y), holes by even and odd) cover together inside the circle of radius ``r`` around the origin."""
    e = _edges(polygons)
    e = e[(e[:, 1] < r) & (e[:, 3] > -r)]
    if not len(e):
        return 0.0
    xs = np.concatenate([e[:, 1], e[:, 3], _crossings(e, r), [-r, r]])
    xs = np.unique(np.clip(xs, -r, r))
    slope = (e[:, 4] - e[:, 2]) / (e[:, 3] - e[:, 1])
    arc = lambda x: 0.5 * (x * np.sqrt(max(r * r - x * x, 0.0)) + r * r * np.arcsin(np.clip(x / r, -1, 1)))
    total = 0.0
    for xa, xb in zip(xs[:-1].tolist(), xs[1:].tolist(), strict=True):
        width, mid = xb - xa, (xa + xb) / 2
        active = np.flatnonzero((e[:, 1] < mid) & (e[:, 3] > mid))
        if width <= 1e-12 * r or not len(active):
            continue
        heights = e[active, 2] + slope[active] * (mid - e[active, 1])
        order = np.argsort(heights, kind="stable")
        edge = np.sqrt(r * r - mid * mid)
        side = arc(xb) - arc(xa)
        inside: set[int] = set()
        low = None
        for k, y in zip(e[active[order], 0].astype(int).tolist(), heights[order].tolist(), strict=True):
            inside ^= {k}
            if low is None:
                low = y
            elif not inside:
                if min(y, edge) > max(low, -edge):
                    # A line's mean height in the slab is that in its middle.
                    total += (side if y > edge else y * width) - (-side if low < -edge else low * width)
                low = None
    return total


def union_areas(pairs: DataFrame, key: list[str], rings: str, r: float, name: str = "area_m2") -> DataFrame:
    """(*key, area): what the polygons of each key cover together within ``r`` of its origin.

    ``rings``: array of rings, each an array of (x, y) structs in metres around the key's point. A group is what lies around
    one point; groups are dealt out by key, so points of a crowded place are in many tasks.
    """
    shape = F.transform(rings, lambda ring: F.transform(ring, lambda p: F.array(p["x"].cast("double"), p["y"].cast("double"))))
    lists = pairs.groupBy(*key).agg(F.collect_list(shape).alias("_all"))
    fields = [lists.schema[c] for c in key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            areas = [union_in_circle(p, r) for p in batch.column("_all").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in key), pa.array(areas, pa.float64())], names=[*key, name])

    return lists.mapInArrow(run, T.StructType([*fields, T.StructField(name, T.DoubleType())]))
