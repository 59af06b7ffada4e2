"""The z-order index against all pairs, on clustered points, hot places and none."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.operators import spatial, zindex


def clustered(n, seed=1):
    """Most points in a few tight clusters, the rest far apart: a grid has most of them in one cell."""
    rng = np.random.default_rng(seed)
    middle = rng.uniform(-1000, 1000, (5, 3))
    tight = middle[rng.integers(0, 5, n)] + rng.normal(0, 0.5, (n, 3))
    wide = rng.uniform(-1000, 1000, (n, 3))
    return np.where(rng.random((n, 1)) < 0.9, tight, wide)


def frame(spark, xyz, **more):
    columns = ["id", "x", "y", "z", *more]
    return spark.createDataFrame([(i, *map(float, p), *(float(v[i]) for v in more.values())) for i, p in enumerate(xyz)], f"id long, {', '.join(f'{c} double' for c in columns[1:])}").repartition(5)


def all_pairs(xyz, k):
    d2 = ((xyz[:, None, :] - xyz[None, :, :]) ** 2).sum(axis=2)
    out = set()
    for i in range(len(xyz)):
        order = sorted((d2[i, j], j) for j in range(len(xyz)) if j != i)[:k]
        out |= {(i, r + 1, j) for r, (_, j) in enumerate(order)}
    return out


def test_leaves_are_small_and_nodes_hold_them(spark):
    index = zindex.build(frame(spark, clustered(1500)), leaf=20, sums={"sx": F.col("x")})
    sizes = [r["count"] for r in index.points.groupBy("leaf").count().collect()]
    assert max(sizes) == 20 and sum(sizes) == 1500
    assert index.levels[-1].count() <= zindex.FAN
    totals = [tuple(x.agg(F.sum("n"), F.min("lox"), F.max("hiz"), F.round(F.sum("sx"), 6)).first()) for x in index.levels]
    assert len(set(totals)) == 1 and totals[0][0] == 1500


def test_nearest_of_clustered_points(spark):
    xyz = clustered(2500)
    df = frame(spark, xyz)
    got = zindex.nearest(df, 4)
    rows = got.found.collect()
    assert {(r["id"], r["rank"], r["other"]) for r in rows} == all_pairs(xyz, 4)
    grid = spatial.nearest_neighbours(df, 4)
    assert {(r["id"], r["rank"], r["other"]) for r in grid.collect()} == {(r["id"], r["rank"], r["other"]) for r in rows}
    assert got.compared < 0.15 * got.places**2  # nearly all points share a few cells of a grid


def test_nearest_with_hot_places_and_few_points(spark):
    rng = np.random.default_rng(3)
    xyz = np.concatenate([np.ones((400, 3)), rng.integers(0, 4, (200, 3)).astype(float), np.full((30, 3), 2.0)])
    df = frame(spark, xyz)
    got = zindex.nearest(df, 6, leaf=8)
    assert {(r["id"], r["rank"], r["other"]) for r in got.found.collect()} == all_pairs(xyz, 6)
    assert got.places <= 64 and got.compared < 64 * 64 * 2  # a place is one row, however many points it has
    small = frame(spark, xyz[398:402])
    assert {(r["id"], r["rank"], r["other"]) for r in zindex.nearest(small, 6).found.collect()} == all_pairs(xyz[398:402], 6)
    assert zindex.nearest(df.limit(0), 3).found.count() == 0
    nulls = small.unionByName(spark.createDataFrame([(9, None, 1.0, 1.0)], small.schema))
    assert zindex.nearest(nulls, 1).found.where("id = 9 or other = 9").count() == 0


def exact(xyz, mass):
    d = xyz[None, :, :] - xyz[:, None, :]
    r2 = (d**2).sum(axis=2)
    w = np.divide(mass[None, :], np.maximum(r2, 1e-300) ** 1.5, out=np.zeros_like(r2), where=r2 > 0)
    return (d * w[:, :, None]).sum(axis=1)


@pytest.mark.parametrize("theta", [0.4, 0.0])
def test_approximate_forces(spark, theta):
    rng = np.random.default_rng(5)
    n = 4000 if theta else 300
    xyz = np.concatenate([clustered(n - 20, seed=7), np.full((20, 3), 3.0)])
    mass = rng.uniform(0, 2, n)
    mass[:5] = 0
    got = zindex.approximate_forces(frame(spark, xyz, mass=mass), theta)
    rows = {r["id"]: (r["fx"], r["fy"], r["fz"]) for r in got.found.collect()}
    want = exact(xyz, mass)
    have = np.array([rows[i] for i in range(n)])
    off = np.linalg.norm(have - want, axis=1) / np.maximum(np.linalg.norm(want, axis=1), np.linalg.norm(want, axis=1).mean())
    if theta:
        assert off.max() < 1e-3 and np.median(off) < 1e-4
        assert got.far and got.direct + got.far < 0.5 * n * n
    else:
        assert off.max() < 1e-9 and not got.far
