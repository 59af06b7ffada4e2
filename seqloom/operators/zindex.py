"""An index of points that follows their density, and searches that descend it.

Points are put in z-order and packed into leaves of equal counts; a node is a run of FAN
nodes below it. Every node has the box of its points, so where points are dense boxes are
small, and no cell ever holds more than a leaf's points. A search pairs target leaves with
nodes level by level and drops, takes or opens each pair; the nodes of a level are a
table that pairs join by number.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import cut, shared_path
from .ordered import positions
from .spatial import AXES, z_order

FAN = 8
#: Second moments, by pairs of axes.
PAIRS = [(i, j) for i in range(3) for j in range(i, 3)]


@dataclass(frozen=True)
class ZIndex:
    """points: the rows with ``leaf``. levels: from the leaves up, (node, n, lo<axis>, hi<axis>,
    sums of what was asked for); the last has at most FAN nodes."""

    points: DataFrame
    levels: list[DataFrame]


def build(points: DataFrame, leaf: int = 32, sums: dict[str, Column] | None = None) -> ZIndex:
    """The index of (id, x, y, z, ...); ``sums`` are added up for every node. No coordinate may be null."""
    sums = sums or {}
    placed = cut(positions(_coded(points), "_code", *AXES, "id").withColumn("leaf", F.floor(F.col("pos") / leaf)).drop("_code", "pos"), "points")
    box = lambda lo, hi: [f(F.col(c)).alias(n) for a in AXES for f, c, n in ((F.min, lo(a), f"lo{a}"), (F.max, hi(a), f"hi{a}"))]
    first = placed.groupBy(F.col("leaf").alias("node")).agg(F.count(F.lit(1)).alias("n"), *box(lambda a: a, lambda a: a), *(F.sum(c).alias(k) for k, c in sums.items()))
    levels = [cut(first, "level0")]
    while levels[-1].count() > FAN:
        up = levels[-1].groupBy(F.floor(F.col("node") / FAN).alias("node")).agg(F.sum("n").alias("n"), *box(lambda a: f"lo{a}", lambda a: f"hi{a}"), *(F.sum(k).alias(k) for k in sums))
        levels.append(cut(up, f"level{len(levels)}"))
    return ZIndex(placed, levels)


def _coded(points: DataFrame) -> DataFrame:
    """points with ``_code``, their place on the z-curve of 2**20 cells along each axis."""
    own = points.withColumnsRenamed({a: f"c{a}" for a in AXES})  # the code itself is called z
    coded = z_order(own, bits=20, axes=tuple(f"c{a}" for a in AXES)).withColumnRenamed("z", "_code")
    return coded.withColumnsRenamed({f"c{a}": a for a in AXES})


def gap2(lo: Callable[[str], Column], hi: Callable[[str], Column]) -> Column:
    """The squared distance between the target's box (t_lo<axis>, t_hi<axis>) and another."""
    return sum((F.pow(F.greatest(F.lit(0.0), F.col(f"t_lo{a}") - hi(a), lo(a) - F.col(f"t_hi{a}")), 2) for a in AXES), F.lit(0.0))


def descend(index: ZIndex, targets: DataFrame, opens: Column, takes: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(pairs with leaves, pairs with nodes taken whole): of every target (leaf, t_lo<axis>, t_hi<axis>, ...)
    with nodes, from the top down. ``takes`` settles a pair; of the others those that
    ``opens`` go on to the node's children, and the rest are dropped.

    Both are of the columns of targets and of levels. A level's pairs are written, so plans
    do not grow; the few nodes of high levels are sent to the pairs, as their size allows.
    """
    spark = targets.sparkSession
    taken_path, front = shared_path(spark, "taken"), None
    takes = takes if takes is not None else F.lit(False)
    schema = None
    for level in reversed(index.levels):
        nodes = level.select(*(F.col(c).alias(f"s_{c}") for c in level.columns))
        if front is None:
            pairs = targets.crossJoin(F.broadcast(nodes))  # the top has at most FAN nodes
        else:
            below = front.select(*targets.columns, F.explode(F.sequence(F.col("s_node") * FAN, F.col("s_node") * FAN + FAN - 1)).alias("s_node"))
            pairs = below.join(nodes, "s_node")
        pairs = cut(pairs.withColumns({"_take": takes, "_open": opens}).where("_take or _open"), "pairs")
        schema = pairs.drop("_take", "_open").schema
        pairs.where("_take").drop("_take", "_open").write.mode("append").parquet(taken_path)
        front = pairs.where("not _take").drop("_take", "_open")
    return front, spark.read.schema(schema).parquet(taken_path)


def _boxes(index: ZIndex, *more: str) -> DataFrame:
    return index.levels[0].select(F.col("node").alias("leaf"), *(F.col(f"{e}{a}").alias(f"t_{e}{a}") for a in AXES for e in ("lo", "hi")), *more)


@dataclass(frozen=True)
class Neighbours:
    """found: (id, rank, other, d2). compared: pairs of places whose distance was computed."""

    found: DataFrame
    places: int
    compared: int


def nearest(points: DataFrame, k: int, leaf: int = 32) -> Neighbours:
    """The ``k`` nearest other points of every point (id, x, y, z), nearest first, ties by id.

    Points of one place are one row of the index, with their k + 1 smallest ids: others of that
    place are nobody's neighbours. A place's distance to its (k + 1)th id in its leaf and the two
    beside it bounds its search. Leaves of places look for leaves nearer than the largest bound in
    them, and each place meets those within its own. A place that finds too few looks everywhere.
    """
    own = points.select("id", *(F.col(a).cast("double").alias(a) for a in AXES)).dropna(subset=list(AXES))
    salted = Window.partitionBy(*AXES, F.pmod(F.xxhash64("id"), F.lit(64))).orderBy("id")
    few = own.withColumn("_r", F.row_number().over(salted)).where(F.col("_r") <= k + 1)
    few = few.withColumn("_r", F.row_number().over(Window.partitionBy(*AXES).orderBy("id"))).where(F.col("_r") <= k + 1)
    places = few.groupBy(*AXES).agg(F.array_sort(F.collect_list("id")).alias("ids")).withColumn("id", F.get("ids", F.lit(0)))
    index = build(places, max(leaf, k + 1))
    p = index.points
    d2 = sum((F.pow(F.col(a) - F.col(f"o{a}"), 2) for a in AXES), F.lit(0.0))
    other = p.select(F.col("leaf").alias("m"), F.col("ids").alias("oids"), *(F.col(a).alias(f"o{a}") for a in AXES))
    order, by_place = ["d2", "other"], Window.partitionBy("id")
    near = p.withColumn("m", F.explode(F.array(*(F.col("leaf") + d for d in (-1, 0, 1))))).join(other, "m").withColumn("d2", d2).select("id", "leaf", "d2", F.size("oids").alias("n"))
    upto = near.withColumn("upto", F.sum("n").over(by_place.orderBy("d2").rowsBetween(Window.unboundedPreceding, 0))).where(F.col("upto") > k)
    bounds = cut(p.join(upto.groupBy("id").agg(F.min("d2").alias("bound")), "id", "left").fillna(float("inf"), ["bound"]), "bounds")
    reach = bounds.groupBy("leaf").agg(F.max("bound").alias("reach"))
    targets = cut(_boxes(index).join(reach, "leaf"), "targets")
    pairs, _ = descend(index, targets, gap2(lambda a: F.col(f"s_lo{a}"), lambda a: F.col(f"s_hi{a}")) <= F.col("reach"))
    # a leaf reaches as far as the farthest of its points; each point meets only the leaves in its own bound
    apart = sum((F.pow(F.greatest(F.lit(0.0), F.col(a) - F.col(f"s_hi{a}"), F.col(f"s_lo{a}") - F.col(a)), 2) for a in AXES), F.lit(0.0))
    meets = bounds.join(pairs.drop("reach"), "leaf").where(apart <= F.col("bound")).select("id", *AXES, "bound", F.col("s_node").alias("m"), "s_n")
    meets = cut(meets, "meets")
    compared = meets.agg(F.coalesce(F.sum("s_n"), F.lit(0))).first()[0]
    found = meets.join(other, "m").withColumn("d2", d2).where(F.col("d2") <= F.col("bound"))
    listed = found.select("id", *AXES, "d2", F.explode("oids").alias("other")).withColumn("r", F.row_number().over(by_place.orderBy(*order))).where(F.col("r") <= k + 1)
    listed = cut(listed.select(*AXES, "other", "d2"), "listed")
    ranked = own.join(listed, list(AXES)).where(F.col("other") != F.col("id")).withColumn("rank", F.row_number().over(by_place.orderBy(*order))).where(F.col("rank") <= k)
    return Neighbours(ranked.select("id", "rank", "other", "d2"), index.points.count(), compared)


@dataclass(frozen=True)
class Forces:
    """found: (id, fx, fy, fz). direct: pairs of bodies met singly; far: pairs of a body and a node."""

    found: DataFrame
    direct: int
    far: int


def approximate_forces(bodies: DataFrame, theta: float = 0.4, leaf: int = 16) -> Forces:
    """For every body (id, x, y, z, mass) about the sum over the others of mass * d / |d|**3.

    Nodes hold their mass and its first and second moments, from the middle of all
    bodies. A node is taken whole by a leaf of bodies if its radius is less than ``theta``
    of its centre's distance to the leaf's box, with mass and quadrupole; leaves that no node took
    meet body by body. Masses are 0 or more. With theta 0 all meet singly.
    """
    own = bodies.select("id", *(F.col(c).cast("double").alias(c) for c in (*AXES, "mass"))).dropna()
    mid = own.agg(*(F.avg(a).alias(a) for a in AXES)).first()
    own = own.select("id", "mass", *((F.col(a) - F.lit(mid[a] or 0.0)).alias(a) for a in AXES))
    first = {f"m{a}": F.col("mass") * F.col(a) for a in AXES}
    second = {f"m{AXES[i]}{AXES[j]}": F.col("mass") * F.col(AXES[i]) * F.col(AXES[j]) for i, j in PAIRS}
    index = build(own, leaf, {"mass": F.col("mass"), **first, **second})
    c = {a: F.when(F.col("s_mass") > 0, F.col(f"s_m{a}") / F.col("s_mass")).otherwise(F.col(f"s_lo{a}")) for a in AXES}
    radius = F.sqrt(sum((F.pow(F.greatest(F.col(f"s_hi{a}") - c[a], c[a] - F.col(f"s_lo{a}")), 2) for a in AXES), F.lit(0.0)))
    away = F.sqrt(gap2(lambda a: c[a], lambda a: c[a]))
    takes = (away > 0) & (radius < theta * away)
    one_place = sum((F.abs(F.col(f"t_hi{a}") - F.col(f"t_lo{a}")) + F.abs(F.col(f"s_hi{a}") - F.col(f"s_lo{a}")) + F.abs(F.col(f"t_lo{a}") - F.col(f"s_lo{a}")) for a in AXES), F.lit(0.0)) == 0
    near, taken = descend(index, cut(_boxes(index, F.col("n").alias("t_n")), "targets"), (F.col("s_mass") > 0) & ~one_place, takes)
    direct = near.agg(F.coalesce(F.sum(F.col("t_n") * F.col("s_n")), F.lit(0))).first()[0]
    far = taken.agg(F.coalesce(F.sum("t_n"), F.lit(0))).first()[0]
    body = index.points.select("leaf", "id", *AXES)
    r = {a: F.col(a) - F.col(f"c{a}") for a in AXES}
    # far: mass and quadrupole about the node's centre
    q = {}
    moment = {(i, j): F.col(f"s_m{AXES[i]}{AXES[j]}") - F.col("s_mass") * c[AXES[i]] * c[AXES[j]] for i, j in PAIRS}
    trace = moment[0, 0] + moment[1, 1] + moment[2, 2]
    for i, j in PAIRS:
        q[i, j] = q[j, i] = 3 * moment[i, j] - (trace if i == j else F.lit(0.0))
    nodes = taken.select("leaf", F.col("s_mass").alias("m"), *(c[a].alias(f"c{a}") for a in AXES), *(q[i, j].alias(f"q{i}{j}") for i, j in PAIRS))
    seen = body.join(nodes, "leaf").withColumns({f"r{i}": r[a] for i, a in enumerate(AXES)}).withColumn("rr", sum((F.pow(F.col(f"r{i}"), 2) for i in range(3)), F.lit(0.0)))
    qr = [sum((F.col(f"q{min(i, j)}{max(i, j)}") * F.col(f"r{j}") for j in range(3)), F.lit(0.0)) for i in range(3)]
    seen = seen.withColumns({f"qr{i}": qr[i] for i in range(3)}).withColumn("rqr", sum((F.col(f"r{i}") * F.col(f"qr{i}") for i in range(3)), F.lit(0.0)))
    force = [-F.col("m") * F.col(f"r{i}") * F.pow("rr", F.lit(-1.5)) + F.col(f"qr{i}") * F.pow("rr", F.lit(-2.5)) - 2.5 * F.col("rqr") * F.col(f"r{i}") * F.pow("rr", F.lit(-3.5)) for i in range(3)]
    names = ["fx", "fy", "fz"]
    by_far = seen.groupBy("id").agg(*(F.sum(f).alias(n) for f, n in zip(force, names)))
    # near: body by body
    other = index.points.select(F.col("leaf").alias("s_node"), F.col("mass").alias("m"), *(F.col(a).alias(f"c{a}") for a in AXES))
    met = body.join(near.select("leaf", "s_node"), "leaf").join(other, "s_node").withColumn("rr", sum((F.pow(r[a], 2) for a in AXES), F.lit(0.0))).where("rr > 0")
    by_near = met.groupBy("id").agg(*(F.sum(-F.col("m") * r[a] * F.pow("rr", F.lit(-1.5))).alias(n) for a, n in zip(AXES, names)))
    zero = body.select("id", *(F.lit(0.0).alias(n) for n in names))
    total = by_far.unionByName(by_near).unionByName(zero).groupBy("id").agg(*(F.sum(n).alias(n) for n in names))
    return Forces(total, direct, far)
