"""Paths: breadth-first search, shortest paths, centrality, decompositions by distance."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..iterate import fixpoint
from ..storage import cut
from .graphs import edge_map


def bfs(edges: DataFrame, sources: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(id, dist, parent) of every vertex reached from ``sources`` (id).

    The parent is the smallest neighbour one level nearer; a source is its own. A
    round joins the last level only.
    """
    level = cut(sources.select("id", F.lit(0).alias("dist"), F.col("id").alias("parent")).distinct(), "level")
    visited, depth = level, 0
    while max_depth is None or depth < max_depth:
        depth += 1
        level = cut(edge_map(edges, level, visited=visited).select("id", F.lit(depth).alias("dist"), "parent"), "level")
        if level.isEmpty():
            break
        visited = visited.unionByName(level)
    return visited


def shortest_paths(edges: DataFrame, sources: DataFrame, start: str | None = None, max_rounds: int | None = None) -> DataFrame:
    """(id, dist, root) of every vertex reached: the smallest dist of any walk from a
    source, and the source (ties to the smaller). Only vertices that changed relax
    their edges. ``start`` is a column of sources with their distances (0 else).
    A negative cycle raises ValueError after as many rounds as there are vertices.
    """
    first = F.col(start) if start else F.lit(0)
    kind = "double" if start or dict(edges.dtypes)["w"] in ("double", "float") else "long"
    state = sources.select("id", first.cast(kind).alias("dist"), F.col("id").alias("root"), F.lit(True).alias("changed"))
    limit = max_rounds or edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id"))).unionByName(sources.select("id")).distinct().count() + 1

    def step(now: DataFrame, _: int) -> DataFrame:
        moved = edges.join(now.where("changed").select(F.col("id").alias("src"), "dist", "root"), "src")
        found = moved.select(F.col("dst").alias("id"), (F.col("dist") + F.col("w")).cast(kind).alias("dist"), "root", F.lit(True).alias("new"))
        all_ = now.select("id", "dist", "root", F.lit(False).alias("new")).unionByName(found)
        best = all_.groupBy("id").agg(F.min(F.struct("dist", "root", "new")).alias("b"))
        return best.select("id", "b.dist", "b.root", F.col("b.new").alias("changed"))

    state, rounds = fixpoint(state, step, "changed", limit)
    if rounds >= limit and not state.where("changed").isEmpty():
        raise ValueError("a negative cycle is within reach")
    return state.drop("changed")


def by_distance(paths: DataFrame) -> DataFrame:
    """(dist, n): how many vertices each distance has."""
    return paths.groupBy("dist").agg(F.count(F.lit(1)).alias("n"))


def betweenness(edges: DataFrame, source: int) -> DataFrame:
    """(id, dist, paths, dependency): shortest paths from ``source`` (unit weights) and
    the share of them that vertices carry; the source's own dependency is 0."""
    spark = edges.sparkSession
    reached = cut(bfs(edges, spark.createDataFrame([(source,)], "id long")).select("id", "dist"), "reached")
    deepest = reached.agg(F.max("dist")).first()[0]
    a, b = reached.select(F.col("id").alias("src"), F.col("dist").alias("ds")), reached.select(F.col("id").alias("dst"), F.col("dist").alias("dd"))
    down = cut(edges.select("src", "dst").distinct().join(a, "src").join(b, "dst").where("dd = ds + 1"), "down")
    sigma = [reached.where("dist = 0").select("id", F.lit(1.0).alias("paths"))]
    for d in range(deepest):
        here = sigma[-1].withColumnRenamed("id", "src")
        sigma.append(cut(down.where(F.col("ds") == d).join(here, "src").groupBy(F.col("dst").alias("id")).agg(F.sum("paths").alias("paths")), "sigma"))
    delta = sigma[deepest].select("id", "paths", F.lit(0.0).alias("dependency"))
    out = [delta]
    for d in range(deepest - 1, -1, -1):
        below = delta.select(F.col("id").alias("dst"), F.col("paths").alias("p"), F.col("dependency").alias("q"))
        got = down.where(F.col("ds") == d).join(below, "dst").groupBy(F.col("src").alias("id")).agg(F.sum((1 + F.col("q")) / F.col("p")).alias("g"))
        delta = cut(sigma[d].join(got, "id", "left").select("id", "paths", F.coalesce(F.col("paths") * F.col("g"), F.lit(0.0)).alias("dependency")), "delta")
        out.append(delta)
    all_ = out[0]
    for x in out[1:]:
        all_ = all_.unionByName(x)
    return reached.join(all_, "id").select("id", "dist", "paths", F.when(F.col("dist") == 0, 0.0).otherwise(F.col("dependency")).alias("dependency"))


def low_diameter(edges: DataFrame, vertices: DataFrame, beta: float = 0.2, seed: int = 1) -> DataFrame:
    """(id, center): clusters grown from all vertices at once, each delayed by an
    exponential shift of mean 1 / beta that follows from its hash."""
    u = (F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(1 << 30)) + 1) / float((1 << 30) + 1)
    shifted = vertices.select("id", (F.log(u) / beta).alias("shift"))
    least = shifted.agg(F.min("shift").alias("m"))
    starts = shifted.crossJoin(F.broadcast(least)).select("id", (F.lit(math.ceil(math.log(1 << 31) / beta)) + F.col("shift")).alias("start"))  # one row
    return shortest_paths(edges.select("src", "dst", F.lit(1.0).alias("w")), starts, "start").select("id", F.col("root").alias("center"))


def le_lists(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """(id, u, dist): the vertices u, in order of id, that are strictly nearer to id than
    all vertices before them (unit weights)."""
    state = vertices.select("id", F.col("id").alias("u"), F.lit(0).alias("dist"), F.lit(True).alias("changed"))
    before = Window.partitionBy("id").orderBy("u").rowsBetween(Window.unboundedPreceding, -1)  # lists have about log n entries

    def step(now: DataFrame, _: int) -> DataFrame:
        moved = edges.select("src", "dst").join(now.where("changed").withColumnRenamed("id", "src"), "src").select(F.col("dst").alias("id"), "u", (F.col("dist") + 1).alias("dist"), F.lit(True).alias("changed"))
        all_ = now.withColumn("changed", F.lit(False)).unionByName(moved).groupBy("id", "u").agg(F.min(F.struct("dist", "changed")).alias("b")).select("id", "u", "b.dist", "b.changed")
        return all_.withColumn("m", F.min("dist").over(before)).where("m is null or dist < m").drop("m")

    return fixpoint(state, step, "changed")[0].drop("changed")
