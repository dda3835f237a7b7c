"""Folds of points that lie together, against a plain k-means with the same start."""

import math

import numpy as np
import pytest

from streetgrid.operators import models


def plain(points, k, rounds=50):
    """Fold by id of one group's (id, x, y)."""
    points = sorted(points)
    place = np.array([(x, y) for _, x, y in points], dtype=float)
    apart = lambda c: ((place - c) ** 2).sum(axis=1)
    centres = [place[np.argmin(apart(place.mean(axis=0)))]]
    for _ in range(k - 1):
        d = np.min([apart(c) for c in centres], axis=0)
        if d.max() > 0:
            centres.append(place[np.argmax(d)])
    centres = np.array(centres)
    for _ in range(rounds):
        fold = np.argmin([apart(c) for c in centres], axis=0)
        after = np.array([place[fold == i].mean(axis=0) if (fold == i).any() else c for i, c in enumerate(centres)])
        step, centres = np.abs(after - centres).max(), after
        if step < 1e-6:
            break
    fold = np.argmin([apart(c) for c in centres], axis=0)
    return {p[0]: int(f) for p, f in zip(points, fold, strict=True)}


@pytest.mark.parametrize("few", [models.FEW_GROUPS, 0])
def test_spatial_folds(spark, few):
    """Five cities, one of them with most points, one with fewer places than folds; broadcast and joined centres."""
    rng = np.random.default_rng(5)
    cities = {"a": 400, "b": 60, "c": 60, "d": 40, "somewhere new": 50}
    rows = [(c, i, float(x), float(y)) for c, n in cities.items() for i, (x, y) in enumerate(rng.normal(0, 1000, (n, 2)))]
    rows += [("two", i, float(i % 2), 0.0) for i in range(7)]
    odd = [("a", 9001, None, 1.0), ("a", 9002, math.nan, 1.0), ("a", 9003, math.inf, 1.0), (None, 9004, 1.0, 1.0), ("empty", 9005, None, None)]
    df = spark.createDataFrame(rows + odd, "city string, point_id long, x double, y double").repartition(5)
    found = models.spatial_folds(df, 5, few=few).collect()
    assert len(found) == len(rows) + len(odd)
    got = {(r.city, r.point_id): r.fold for r in found}
    for city in [*cities, "two"]:
        assert {p: got[city, p] for c, p, _, _ in rows if c == city} == plain([r[1:] for r in rows if r[0] == city], 5)
    assert len({got["two", i] for i in range(7)}) == 2
    assert all(got[c, p] is None for c, p, _, _ in odd)


def test_no_points(spark):
    empty = spark.createDataFrame([], "city string, point_id long, x double, y double")
    assert models.spatial_folds(empty, 5).count() == 0
