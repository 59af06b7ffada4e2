"""Delaunay meshes: exact, whole up to the hull, and quick."""

import time
from fractions import Fraction

import numpy as np

from seqloom.operators import mesh, spatial


def _twice(x, y, a, b, c):
    return (x[a] - x[c]) * (y[b] - y[c]) - (y[a] - y[c]) * (x[b] - x[c])


def _check(x, y):
    """Turning left, nothing within a circle, and together as large as the hull."""
    got = mesh.triangulate(np.array(x, dtype=float), np.array(y, dtype=float))
    x, y = [Fraction(float(v)) for v in x], [Fraction(float(v)) for v in y]
    for a, b, c in got:
        assert _twice(x, y, a, b, c) > 0
        for p in range(len(x)):
            (ax, ay), (bx, by), (cx, cy) = ((x[k] - x[p], y[k] - y[p]) for k in (a, b, c))
            assert (ax * ax + ay * ay) * (bx * cy - cx * by) + (bx * bx + by * by) * (cx * ay - ax * cy) + (cx * cx + cy * cy) * (ax * by - bx * ay) <= 0
    order, hull = sorted(range(len(x)), key=lambda i: (x[i], y[i])), []
    for side in (order, order[::-1]):
        own = []
        for i in side:
            while len(own) > 1 and _twice(x, y, own[-2], own[-1], i) <= 0:
                own.pop()
            own.append(i)
        hull += own[:-1]
    assert sum(_twice(x, y, a, b, c) for a, b, c in got) == sum(x[hull[k - 1]] * y[hull[k]] - x[hull[k]] * y[hull[k - 1]] for k in range(len(hull)))
    return len(got)


def test_meshes_are_whole():
    """With a large triangle around all points, flat triangles of the hull were missing."""
    rng = np.random.default_rng(0)
    for n in (3, 4, 30):
        _check(rng.random(n), rng.random(n))
    grid = rng.permutation([(i, j) for i in range(6) for j in range(6)])
    assert _check(grid[:, 0], grid[:, 1]) == 50
    assert _check([0, 1, 2, 3, 4, 2], [0, 0, 0, 0, 0, 1]) == 4
    assert _check(np.arange(20), np.arange(20) ** 2 * 1e-7) == 18
    assert len(mesh.triangulate(np.arange(5.0), np.arange(5.0))) == len(mesh.triangulate(np.arange(2.0), np.arange(2.0))) == 0


def test_delaunay_of_many_points(spark):
    """Every point was tried in every triangle."""
    x, y = np.random.default_rng(1).normal(size=(2, 20_000))
    rows = [(i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))]
    df = spark.createDataFrame([*rows, (90_000, rows[5][1], rows[5][2]), (90_001, None, 1.0), (90_002, float("nan"), 1.0)], "id long, x double, y double")
    began = time.time()
    got = np.array([tuple(r) for r in spatial.delaunay(df).collect()])
    assert time.time() - began < 60
    assert (got[:, 0] < got[:, 1]).all() and (got[:, 1] < got[:, 2]).all() and got.max() < 20_000 and len(np.unique(got)) == 20_000
    edges = np.unique(np.concatenate([got[:, [0, 1]], got[:, [1, 2]], got[:, [0, 2]]]), axis=0)
    assert 20_000 - len(edges) + len(got) == 1  # Euler's formula, without the face outside
