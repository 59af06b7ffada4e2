"""Points, boxes, rays and hulls: grid joins with an exact predicate."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import cut
from .mesh import triangulate

AXES = ("x", "y", "z")
#: Cells along each axis, at most, in which `ray_cast` gathers triangles, and how many of these, and of rays, a task pairs; of
#: which so many at once.
CELLS, BLOCK, PAIRS = 8, 8_192, (64, 1_024)
#: Bodies, and others, between which `total_forces` takes all steps at once.
TILE = 64, 1_024


def radius_pairs(points: DataFrame, r: float, axes: tuple[str, ...] = AXES) -> DataFrame:
    """(id, other, d2) of all ordered pairs of different points nearer than ``r`` (strictly).

    One side is spread over the neighbouring cells of side ``r``, the other stands in its own.
    """
    own = points.select("id", *(F.col(a).cast("double").alias(a) for a in axes))
    left = own.withColumnsRenamed({a: f"l{a}" for a in axes})
    for a in axes:
        left = left.withColumn(f"c{a}", F.explode(F.array(*(F.floor(F.col(f"l{a}") / r) + d for d in (-1, 0, 1)))))
    right = own.withColumnRenamed("id", "other").withColumns({f"c{a}": F.floor(F.col(a) / r) for a in axes})
    d2 = sum((F.pow(F.col(f"l{a}") - F.col(a), 2) for a in axes), F.lit(0.0))
    return left.join(right, [f"c{a}" for a in axes]).where("id <> other").withColumn("d2", d2).where(F.col("d2") < r * r).select("id", "other", "d2")


def nearest_neighbours(points: DataFrame, k: int, axes: tuple[str, ...] = AXES) -> DataFrame:
    """(id, rank, other, d2): the ``k`` nearest other points, nearest first, ties by id.

    The radius begins where a point has about 2 k neighbours at even density; points
    that find fewer than ``k`` are searched again with twice the radius.
    """
    own = cut(points.select("id", *(F.col(a).cast("double").alias(a) for a in axes)), "points")
    row = own.agg(F.count(F.lit(1)).alias("n"), *(F.min(a).alias(f"lo{a}") for a in axes), *(F.max(a).alias(f"hi{a}") for a in axes)).first()
    n, spans = row["n"], [max(row[f"hi{a}"] - row[f"lo{a}"], 1e-9) for a in axes] if row["n"] else [1.0]
    k = min(k, max(n - 1, 0))
    r = float(np.prod(spans) * 2 * max(k, 1) / max(n, 1)) ** (1 / len(axes))
    order, found, todo = Window.partitionBy("id").orderBy("d2", "other"), None, own
    while k and not todo.isEmpty():
        if r > 2 * max(spans) * len(axes) ** 0.5:
            r = 4 * max(spans) * len(axes) ** 0.5
        left = todo.withColumnsRenamed({a: f"l{a}" for a in axes})
        for a in axes:
            left = left.withColumn(f"c{a}", F.explode(F.array(*(F.floor(F.col(f"l{a}") / r) + d for d in (-1, 0, 1)))))
        right = own.withColumnRenamed("id", "other").withColumns({f"c{a}": F.floor(F.col(a) / r) for a in axes})
        d2 = sum((F.pow(F.col(f"l{a}") - F.col(a), 2) for a in axes), F.lit(0.0))
        near = left.join(right, [f"c{a}" for a in axes]).where("id <> other").withColumn("d2", d2).where(F.col("d2") <= r * r)
        top = near.select("id", "other", "d2").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        top = cut(top.join(top.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == k), "id").select("id", "rank", "other", "d2"), "near")
        found = top if found is None else found.unionByName(top)
        todo = cut(todo.join(top.select("id").distinct(), "id", "left_anti"), "todo")
        r *= 2
    if found is None:
        return own.limit(0).select("id", F.lit(0).alias("rank"), F.col("id").alias("other"), F.lit(0.0).alias("d2"))
    return found


def z_order(points: DataFrame, bits: int = 10, axes: tuple[str, ...] = AXES) -> DataFrame:
    """points with ``z``: the bits of their cells along the axes, interleaved."""
    row = points.agg(*(F.min(a).alias(f"lo{a}") for a in axes), *(F.max(a).alias(f"hi{a}") for a in axes)).first()
    z = F.lit(0).cast("long")
    for j, a in enumerate(axes):
        span = (row[f"hi{a}"] or 0) - (row[f"lo{a}"] or 0) or 1
        c = F.least(F.floor((F.col(a) - F.lit(row[f"lo{a}"] or 0)) / span * (1 << bits)), F.lit((1 << bits) - 1)).cast("long")
        for b in range(bits):
            z = z.bitwiseOR(F.shiftleft(F.shiftright(c, b).bitwiseAND(F.lit(1).cast("long")), len(axes) * b + j))
    return points.withColumn("z", z)


def box_overlaps(boxes: DataFrame, cell: float, axes: tuple[str, ...] = AXES) -> DataFrame:
    """(i, j), i < j, of boxes (id, <axis>lo, <axis>hi) that overlap strictly along every axis.

    Boxes are spread over the cells they touch; a pair counts in the cell of the lower
    corner of its overlap only, so that no pair is made twice.
    """
    own = boxes
    for a in axes:
        own = own.withColumn(f"c{a}", F.explode(F.sequence(F.floor(F.col(f"{a}lo") / cell), F.floor(F.col(f"{a}hi") / cell))))
    cells = [f"c{a}" for a in axes]
    left, right = own.withColumnsRenamed({c: f"l{c}" for c in own.columns if c not in cells}), own
    both = left.join(right, cells).where("lid < id")
    for a in axes:
        both = both.where((F.col(f"l{a}lo") < F.col(f"{a}hi")) & (F.col(f"{a}lo") < F.col(f"l{a}hi")) & (F.floor(F.greatest(f"l{a}lo", f"{a}lo") / cell) == F.col(f"c{a}")))
    return both.select(F.col("lid").alias("i"), F.col("id").alias("j"))


def _first_hits(rays: pd.DataFrame, tris: pd.DataFrame) -> pd.DataFrame:
    """(ray, tri, t) of the nearest of ``tris``, for the rays that hit any.

    Products of matrices give all pairs' determinants up to rounding; by bounds on that, pairs are left out which
    surely miss or lie behind a sure hit, and the others are computed one by one."""
    corner = lambda pdf, c: np.stack([np.asarray(x, dtype=float) for x in pdf[c]])
    o, d, a, b, c = corner(rays, "o"), corner(rays, "d"), corner(tris, "a"), corner(tris, "b"), corner(tris, "c")
    e1, e2, ids, names = b - a, c - a, tris["tri"].to_numpy(), rays["ray"].to_numpy()
    normal = np.cross(e1, e2)
    left = np.concatenate([np.cross(o, d), d], axis=1), np.concatenate([o, np.ones((len(o), 1))], axis=1)
    right = np.concatenate([e2, -np.cross(e2, a)], axis=1).T, np.concatenate([-e1, -np.cross(a, e1)], axis=1).T, np.concatenate([normal, -(a * normal).sum(axis=1, keepdims=True)], axis=1).T
    far, long_, wide = (float(np.abs(x).max(initial=0.0)) for x in (np.concatenate([o, a]), d, np.concatenate([e1, e2])))
    # what rounding can do to u and w, to det and to t (each times det)
    eu, ed, et = 1e-13 * far * long_ * wide, 1e-13 * long_ * wide**2, 1e-13 * far * wide**2
    out = [pd.DataFrame({"ray": names[:0], "tri": ids[:0], "t": np.empty(0)})]
    for at in range(0, len(o), PAIRS[0]):
        own, found = slice(at, at + PAIRS[0]), []
        bound = np.full(len(o[own]), np.inf)  # no ray's first hit is behind it
        for to in range(0, len(a), PAIRS[1]):
            other = slice(to, to + PAIRS[1])
            with np.errstate(invalid="ignore", over="ignore"):
                det, t = d[own] @ -normal[other].T, left[1][own] @ right[2][:, other]
                u, w = (left[0][own] @ x[:, other] for x in right[:2])
                side = np.sign(det)
                np.abs(det, out=det)
                side[det <= ed] = 0.0  # too flat to tell: 0 * u passes
                u *= side
                w *= side
                t *= side
                miss = u < -eu
                miss |= w < -eu
                u += w
                u -= det
                miss |= u > 2 * eu + ed
                miss &= side != 0
                miss |= t < -et
                miss |= t > bound[:, None] * (det + ed) + et
            r, k = np.nonzero(~miss)
            x, w0, t0 = det[r, k], w[r, k], t[r, k]
            u0 = u[r, k] + x - w0
            sure = (x > 10 * ed + 2e-12) & (u0 > 4 * eu + 1e-15 * x) & (w0 > 4 * eu) & (x - u0 - w0 > 4 * eu + 4 * ed) & (t0 > 4 * et + 2e-12 * x)
            with np.errstate(divide="ignore", invalid="ignore"):
                near = np.where(x > 10 * ed, t0 / x, 0.0)
                off = np.where(x > 10 * ed, 2 * (et + near * ed) / x + 1e-14 * near, np.inf)
            found.append((r, k + to, near - off))
            np.minimum.at(bound, r[sure], (near + off)[sure])
        r, k, least = (np.concatenate(x) for x in zip(*found))
        kept = ~(least > bound[r])
        r, k = r[kept] + at, k[kept]
        with np.errstate(divide="ignore", invalid="ignore"):
            p = np.cross(d[r], e2[k])
            det = (e1[k] * p).sum(axis=1)
            s = o[r] - a[k]
            q = np.cross(s, e1[k])
            u, w, t = (s * p).sum(axis=1) / det, (d[r] * q).sum(axis=1) / det, (e2[k] * q).sum(axis=1) / det
            ok = (np.abs(det) > 1e-12) & (u >= 0) & (w >= 0) & (u + w <= 1) & (t > 1e-12)
        out.append(pd.DataFrame({"ray": names[r[ok]], "tri": ids[k[ok]], "t": t[ok]}).sort_values(["t", "tri"]).drop_duplicates("ray"))
    return pd.concat(out)


def ray_cast(rays: DataFrame, triangles: DataFrame) -> DataFrame:
    """(ray, tri, t): the first triangle each ray hits, null for none.

    rays (ray, o: array of 3, d: array of 3) meet triangles (tri, a, b, c: arrays of 3).
    Triangles stand in the cells of their centroids, along each axis CELLS or as few as
    make cells of BLOCK, and full cells are split into blocks of about BLOCK. A ray goes to the blocks whose bounding
    box it crosses and meets all of their triangles; the nearest hits of all blocks are
    reduced by ray.
    """
    own = triangles.select("tri", "a", "b", "c", *(((F.col("a")[i] + F.col("b")[i] + F.col("c")[i]) / 3).alias(f"m{i}") for i in range(3)))
    row = own.agg(F.count(F.lit(1)).alias("n"), *(f(f"m{i}").alias(f"{n}{i}") for i in range(3) for n, f in (("lo", F.min), ("hi", F.max)))).first()
    cell, cells = F.lit(0), min(CELLS, math.ceil((max(row["n"], 1) / BLOCK) ** (1 / 3)))  # a ray is copied for each cell it crosses
    for i in range(3):
        lo, span = row[f"lo{i}"] or 0.0, (row[f"hi{i}"] or 0.0) - (row[f"lo{i}"] or 0.0) or 1.0
        cell = cell * cells + F.least(F.floor((F.col(f"m{i}") - lo) / span * cells), F.lit(cells - 1)).cast("int")
    own = own.select("tri", "a", "b", "c", cell.alias("cell")).where("cell is not null")
    parts = own.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("parts"))  # CELLS ** 3 rows at most
    own = own.join(F.broadcast(parts), "cell").withColumn("part", F.pmod(F.xxhash64("tri"), F.col("parts")))
    own = cut(own.drop("parts"), "triangles")
    corner = lambda f, i: f(F.col("a")[i], F.col("b")[i], F.col("c")[i])
    boxes = own.groupBy("cell", "part").agg(*(g(corner(f, i)).alias(f"{n}{i}") for i in range(3) for n, f, g in (("lo", F.least, F.min), ("hi", F.greatest, F.max))))
    near, far, meets = F.lit(0.0), F.lit(float("inf")), F.lit(True)
    for i in range(3):
        o, d = F.col("o")[i], F.col("d")[i]
        wide = 1e-6 * (1 + F.abs(f"lo{i}") + F.abs(f"hi{i}") + F.abs(o))  # more than rounding, so that no hit is lost
        lo, hi = F.col(f"lo{i}") - wide - o, F.col(f"hi{i}") + wide - o
        step = F.when(d != 0, d)
        near = F.greatest(near, F.least(lo / step, hi / step))
        far = F.least(far, F.greatest(lo / step, hi / step))
        meets = meets & ((d != 0) | ((lo <= 0) & (hi >= 0)))
    crossed = rays.select("ray", "o", "d").join(boxes, meets & (near <= far)).select("ray", "o", "d", "cell", "part")
    # rays in as many groups as keep one small; each group meets a copy of the block
    crossed = cut(crossed, "crossed")
    groups = crossed.groupBy("cell", "part").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("groups"))
    crossed = crossed.join(groups, ["cell", "part"]).withColumn("group", F.pmod(F.xxhash64("ray"), F.col("groups"))).drop("groups")
    copies = own.join(groups, ["cell", "part"]).withColumn("group", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1))).drop("groups")
    key = ["cell", "part", "group"]
    tasks = max(int(rays.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(1_000, crossed.count() // BLOCK))  # given, as the rows are few for the work they are
    kinds = rays.schema["ray"].dataType.simpleString(), triangles.schema["tri"].dataType.simpleString()

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        return _first_hits(left, right) if len(left) and len(right) else pd.DataFrame({"ray": [], "tri": [], "t": []})

    hit = crossed.repartition(tasks, *key).groupBy(key).cogroup(copies.repartition(tasks, *key).groupBy(key)).applyInPandas(run, f"ray {kinds[0]}, tri {kinds[1]}, t double")
    first = hit.groupBy("ray").agg(F.min(F.struct("t", "tri")).alias("h"))
    return rays.select("ray").join(first, "ray", "left").select("ray", "h.tri", "h.t")


def _upper(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["x", "y", "id"], ascending=[True, False, True]).drop_duplicates("x")
    kept: list[int] = []
    x, y = pdf["x"].to_numpy(), pdf["y"].to_numpy()
    for i in range(len(pdf)):
        while len(kept) > 1 and (x[kept[-1]] - x[kept[-2]]) * (y[i] - y[kept[-2]]) - (y[kept[-1]] - y[kept[-2]]) * (x[i] - x[kept[-2]]) >= 0:
            kept.pop()
        kept.append(i)
    return pdf.iloc[kept]


def upper_hull(points: DataFrame) -> DataFrame:
    """(id, x, y) of the upper hull, left to right; of points above each other the highest counts.

    Hulls of slices along x come first; the hull of their points is the hull of all.
    """
    own = points.select("id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for pdf in batches:
            held = _upper(pdf if held is None else pd.concat([held, pdf]))
        if held is not None:
            yield held

    schema = own.schema
    few = own.repartitionByRange("x").mapInPandas(run, schema)
    return few.coalesce(1).mapInPandas(run, schema).orderBy("x")


def _forces(a: np.ndarray, b: np.ndarray, mass: np.ndarray, unit: float | None) -> np.ndarray:
    """Sums of what the bodies ``b`` (a row for each axis) do to each of ``a``, tile by tile, so that all steps stay in the cache."""
    out = np.zeros((3, a.shape[1]), dtype=float if unit is None else np.int64)
    with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
        for v in range(0, b.shape[1], TILE[1]):
            own, m = b[:, None, v : v + TILE[1]], mass[None, v : v + TILE[1]]
            heaviest = np.abs(m).max()
            for u in range(0, a.shape[1], TILE[0]):
                at = slice(u, u + TILE[0])
                d = [own[i] - a[i, at, None] for i in range(3)]
                r2 = d[0] * d[0]
                r2 += d[1] * d[1]
                r2 += d[2] * d[2]
                nearest, cube = r2.min(), np.sqrt(r2)
                cube *= r2
                for i in range(3):
                    f = d[i]
                    f *= m
                    f /= cube
                    if not nearest > 0:  # one place, or no number
                        f[~(r2 > 0)] = 0.0
                    if unit is None:
                        out[i, at] += f.sum(axis=1)
                        continue
                    f /= unit
                    f += 0.5
                    np.floor(f, out=f)
                    # whole numbers: their sums are exact as doubles up to 2 ** 53
                    small = nearest > 0 and (heaviest / nearest / unit + 1) * f.shape[1] < 2.0**53
                    out[i, at] += f.sum(axis=1).astype(np.int64) if small else f.astype(np.int64).sum(axis=1)
    return out


def total_forces(bodies: DataFrame, block: int | None = None, unit: float | None = None) -> DataFrame:
    """(id, fx, fy, fz): the exact sum over all other bodies (id, x, y, z, mass) of
    mass * d / |d|^3. Bodies meet block by block, and sums, not pairs, leave a block. Without ``block``
    there are at least 16 blocks, of at most 32,768 bodies, so each body is copied twice for each 32,768.

    With ``unit`` every pair's force is rounded to whole units and sums are longs of these,
    which no order of adding changes."""
    own = cut(bodies.select("id", *(F.col(c).cast("double").alias(c) for c in (*AXES, "mass"))), "bodies")
    n = own.count()
    blocks = max(1, -(-n // (block or min(32_768, max(512, n // 16)))))
    spot = F.pmod(F.xxhash64("id"), F.lit(blocks).cast("long"))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))  # of the type of spot: sides meet by the hash of (b, p)
    tasks = max(int(own.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(1_000, n * n // 50_000_000))  # given, as the rows are few for the work they are
    side = own.withColumn("b", spot)
    left = side.withColumn("p", every).repartition(tasks, "b", "p")
    right = side.withColumnRenamed("b", "p").withColumn("b", every).repartition(tasks, "b", "p")
    kind = "double" if unit is None else "long"

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        at = lambda t, c: t[c].fill_null(float("nan")).to_numpy()
        out = _forces(np.stack([at(a, c) for c in AXES]), np.stack([at(b, c) for c in AXES]), at(b, "mass"), unit)
        return pa.table({"id": a["id"], **{f"f{c}": pa.array(x) for c, x in zip(AXES, out)}})

    parts = left.groupBy("b", "p").cogroup(right.groupBy("b", "p")).applyInArrow(run, f"id long, fx {kind}, fy {kind}, fz {kind}")
    return parts.groupBy("id").agg(*(F.sum(c).alias(c) for c in ("fx", "fy", "fz")))


def linear_program(constraints: DataFrame, cx: float, cy: float) -> tuple[float, float]:
    """(x, y) that maximises cx * x + cy * y under a * x + b * y <= c for all rows (a, b, c).

    Constraints are reduced to the envelope near the optimum in rounds: the optimum
    of those kept is tested against all, and the most violated joins them. Unbounded
    gives (inf, inf), no solution (nan, nan).
    """
    kept: list[tuple[float, float, float]] = []
    box = 1e9
    while True:
        best = _small_lp(kept, cx, cy, box)
        if best is None:
            return float("nan"), float("nan")
        over = F.col("a") * best[0] + F.col("b") * best[1] - F.col("c")
        size = F.sqrt(F.col("a") ** 2 + F.col("b") ** 2)
        row = constraints.select("a", "b", "c", (over / F.when(size > 0, size).otherwise(1.0)).alias("o")).orderBy(F.desc("o"), "a", "b", "c").first()
        if row is None or row["o"] <= 1e-7 * max(1.0, abs(best[0]), abs(best[1])) or (row["a"], row["b"], row["c"]) in kept:
            return (float("inf"), float("inf")) if max(abs(best[0]), abs(best[1])) >= box * 0.999 else best
        kept.append((row["a"], row["b"], row["c"]))


def _small_lp(rows: list[tuple[float, float, float]], cx: float, cy: float, box: float) -> tuple[float, float] | None:
    lines = [*rows, (1.0, 0.0, box), (-1.0, 0.0, box), (0.0, 1.0, box), (0.0, -1.0, box)]
    best = None
    for i, (a, b, c) in enumerate(lines):
        for d, e, f in lines[i + 1 :]:
            det = a * e - b * d
            if abs(det) < 1e-12:
                continue
            x, y = (c * e - b * f) / det, (a * f - c * d) / det
            if all(p * x + q * y <= r + 1e-9 * max(1.0, abs(r), abs(p * x), abs(q * y)) for p, q, r in lines):
                key = (round(cx * x + cy * y, 9), -x, -y)
                best = max(best, (key, x, y)) if best else (key, x, y)
    return best and (best[1], best[2])


def delaunay(points: DataFrame) -> DataFrame:
    """(a, b, c): the triangles of the Delaunay triangulation, ids rising, those on the hull included.

    Points are inserted one by one in one task (a mesh has no parts to give away), each beside the one
    before, so it is for point sets that one executor holds: about 200 bytes a point. Of points of one
    place the smallest id counts; those without finite coordinates are left out.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(batches) or [pd.DataFrame({"id": [], "x": [], "y": []})])
        pdf = pdf[np.isfinite(pdf["x"]) & np.isfinite(pdf["y"])].sort_values("id").drop_duplicates(["x", "y"])
        ids = pdf["id"].to_numpy().astype(np.int64)
        mesh = np.sort(ids[triangulate(pdf["x"].to_numpy(), pdf["y"].to_numpy())], axis=1)
        yield pd.DataFrame(mesh[np.lexsort(mesh.T[::-1])], columns=["a", "b", "c"])

    own = points.select("id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    return own.repartition(1).mapInPandas(run, "a long, b long, c long")
