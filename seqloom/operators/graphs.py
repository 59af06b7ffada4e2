"""Graphs as edges (src, dst[, w]) with vertices (id): construction and one-pass measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import positions


def transpose(edges: DataFrame) -> DataFrame:
    return edges.withColumnsRenamed({"src": "_s", "dst": "src"}).withColumnRenamed("_s", "dst").select(*edges.columns)


def symmetrize(edges: DataFrame) -> DataFrame:
    """Both directions of every edge, without self-loops and duplicates."""
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return both.where("src <> dst").distinct()


def undirected(edges: DataFrame) -> DataFrame:
    """Each pair of neighbours once, src < dst."""
    return edges.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()


def vertices_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id"))).distinct()


def num_vertices(edges: DataFrame) -> DataFrame:
    """One row: the largest id and one."""
    return edges.agg((F.coalesce(F.max(F.greatest("src", "dst")), F.lit(-1)) + 1).alias("n"))


def degrees(edges: DataFrame) -> DataFrame:
    """(id, degree, weight, loop) by source: half-edges, their weight, and that of self-loops."""
    w = F.col("w") if "w" in edges.columns else F.lit(1.0)
    return edges.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("degree"), F.sum(w).alias("weight"), F.sum(F.when(F.col("src") == F.col("dst"), w).otherwise(0.0)).alias("loop"))


def stats(edges: DataFrame) -> DataFrame:
    """One row: n (vertices with an edge), m, max_degree."""
    d = degrees(edges)
    return vertices_of(edges).join(d, "id", "left").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("degree"), F.lit(0)).alias("m"), F.coalesce(F.max("degree"), F.lit(0)).alias("max_degree"))


def normalized_matrix(edges: DataFrame) -> DataFrame:
    """(row, col, val): row u holds 1 / indegree(c) for each out-neighbour c."""
    indegree = edges.groupBy(F.col("dst").alias("col")).agg(F.count(F.lit(1)).alias("d"))
    return edges.select(F.col("src").alias("row"), F.col("dst").alias("col")).join(indegree, "col").select("row", "col", (1.0 / F.col("d")).alias("val"))


def clean(edges: DataFrame) -> DataFrame:
    """Parallel edges merged: weights are summed; without weights one is kept."""
    return edges.groupBy("src", "dst").agg(F.sum("w").alias("w")) if "w" in edges.columns else edges.distinct()


def renumber(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges with ids 0..k-1 in the order of the old ones, and the mapping (id, old)."""
    ids = positions(vertices_of(edges).withColumnRenamed("id", "old"), "old").select(F.col("pos").alias("id"), "old")
    left, right = ids.select(F.col("id").alias("_s"), F.col("old").alias("src")), ids.select(F.col("id").alias("_d"), F.col("old").alias("dst"))
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    return edges.join(left, "src").join(right, "dst").select(F.col("_s").alias("src"), F.col("_d").alias("dst"), *rest), ids


def check_symmetry(edges: DataFrame) -> DataFrame:
    """The edges whose reverse (with the same weight) is missing."""
    back = transpose(edges).withColumnsRenamed({c: f"_{c}" for c in edges.columns})
    on = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in edges.columns]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    return edges.join(back, cond, "left_anti")


def adjacency(edges: DataFrame) -> DataFrame:
    """(id, neighbours sorted)."""
    return edges.groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_list("dst")).alias("neighbours"))


def edge_map(edges: DataFrame, frontier: DataFrame, allowed: Column | None = None, visited: DataFrame | None = None) -> DataFrame:
    """(id, parent): the vertices that the frontier (id) reaches by an edge that is
    allowed, without those visited; the parent is the smallest source. Whether the
    frontier is broadcast or shuffled follows from its size at run time."""
    reached = edges.join(frontier.select(F.col("id").alias("src")), "src")
    if allowed is not None:
        reached = reached.where(allowed)
    out = reached.groupBy(F.col("dst").alias("id")).agg(F.min("src").alias("parent"))
    return out if visited is None else out.join(visited.select("id"), "id", "left_anti")


def triangles(edges: DataFrame) -> DataFrame:
    """(a, b, c): every triangle once.

    Edges point from the vertex of smaller degree (ties by id), so that no vertex has
    more than about sqrt(2 m) out-neighbours and hubs do not multiply pairs.
    """
    e = undirected(edges)
    both = symmetrize(edges)
    d = both.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("d"))
    ranked = e.join(d.select(F.col("id").alias("src"), F.col("d").alias("ds")), "src").join(d.select(F.col("id").alias("dst"), F.col("d").alias("dd")), "dst")
    forward = F.struct("ds", "src") < F.struct(F.col("dd").alias("ds"), F.col("dst").alias("src"))
    out = ranked.select(F.when(forward, F.col("src")).otherwise(F.col("dst")).alias("u"), F.when(forward, F.col("dst")).otherwise(F.col("src")).alias("v"))
    wedges = out.join(out.withColumnRenamed("v", "w"), "u").where("v < w")
    closed = e.select(F.col("src").alias("v"), F.col("dst").alias("w"))
    found = wedges.join(closed, ["v", "w"])
    sorted_ = F.array_sort(F.array("u", "v", "w"))
    return found.select(sorted_[0].alias("a"), sorted_[1].alias("b"), sorted_[2].alias("c"))
