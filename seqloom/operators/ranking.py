"""PageRank, and vectors that matrices are applied to again and again."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import cut
from .graphs import normalized_matrix

#: Bits of an id within its block.
LOW = 16
#: Pieces (an Arrow batch of entries each) that meet one copy of a block of a vector.
PIECES = 512


def tiles(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A matrix of ones at (row, col), integers, packed for `apply_tiles`: pieces of entries of one block of
    rows and one of columns, with 2 bytes for each row and column, and the number of groups that the
    pieces of a block of columns are dealt into. Entries that repeat add up; nulls are left out."""
    block = lambda c: F.shiftright(F.col(c).cast("long"), LOW)
    low = lambda c: F.col(c).cast("long").bitwiseAND(F.lit((1 << LOW) - 1)).cast("int").alias(c)
    own = entries.where("row is not null and col is not null").select(block("row").alias("rb"), block("col").alias("cb"), low("row"), low("col"))
    own = own.repartition("rb", "cb", F.shiftright("row", LOW - 4)).sortWithinPartitions("rb", "cb", "row")

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            made = [(rb, cb, *(part[c].to_numpy().astype(np.uint16).tobytes() for c in ("row", "col"))) for (rb, cb), part in pdf.groupby(["rb", "cb"])]
            yield pd.DataFrame(made, columns=["rb", "cb", "rows", "cols"])

    pieces = cut(own.mapInPandas(pack, "rb long, cb long, rows binary, cols binary"), "pieces")
    groups = cut(pieces.groupBy("cb").agg(F.ceil(F.count(F.lit(1)) / PIECES).alias("groups")), "groups")
    return cut(pieces.join(groups, "cb").withColumn("group", F.pmod(F.xxhash64("rb", "rows"), F.col("groups"))).drop("groups"), "tiles"), groups


def _block_of(pdf: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"cb": [pdf["cb"].iloc[0]], "at": [pdf["at"].to_numpy().astype(np.uint16).tobytes()], "x": [pdf["val"].to_numpy().tobytes()]})


def _products(pieces: pd.DataFrame, vector: pd.DataFrame) -> pd.DataFrame:
    made = []
    if len(pieces) and len(vector):
        x, has = np.zeros(1 << LOW), np.zeros(1 << LOW, dtype=bool)
        at = np.frombuffer(vector["at"].iloc[0], dtype=np.uint16)
        x[at], has[at] = np.frombuffer(vector["x"].iloc[0]), True
        for rb, part in pieces.groupby("rb"):
            row, col = (np.frombuffer(b"".join(part[c]), dtype=np.uint16) for c in ("rows", "cols"))
            row, col = row[has[col]], col[has[col]]
            got = np.flatnonzero(np.bincount(row, minlength=1 << LOW))
            made.append((rb, got.astype(np.uint16).tobytes(), np.bincount(row, x[col], 1 << LOW)[got].tobytes()))
    return pd.DataFrame(made, columns=["rb", "at", "y"])


def _sums(pdf: pd.DataFrame) -> pd.DataFrame:
    y, has = np.zeros(1 << LOW), np.zeros(1 << LOW, dtype=bool)
    for at, part in zip(pdf["at"], pdf["y"], strict=True):
        at = np.frombuffer(at, dtype=np.uint16)
        y[at] += np.frombuffer(part)
        has[at] = True
    return pd.DataFrame({"pos": (int(pdf["rb"].iloc[0]) << LOW) + np.flatnonzero(has), "val": y[has]})


def apply_tiles(matrix: tuple[DataFrame, DataFrame], vector: DataFrame) -> DataFrame:
    """(pos, val): a matrix of `tiles` times a vector (pos, val); rows without entries are missing.

    A block of the vector goes to the pieces of its columns; what is exchanged is the pieces and one sum for
    each row and group, not a row for each entry."""
    pieces, groups = matrix
    own = vector.select(F.shiftright(F.col("pos").cast("long"), LOW).alias("cb"), F.col("pos").cast("long").bitwiseAND(F.lit((1 << LOW) - 1)).cast("int").alias("at"), F.col("val").cast("double").alias("val"))
    blocks = own.dropna().groupBy("cb").applyInPandas(_block_of, "cb long, at binary, x binary")
    copies = blocks.join(groups, "cb").withColumn("group", F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1))).drop("groups")
    parts = pieces.groupBy("cb", "group").cogroup(copies.groupBy("cb", "group")).applyInPandas(_products, "rb long, at binary, y binary")
    return parts.groupBy("rb").applyInPandas(_sums, "pos long, val double")


def pagerank(vertices: DataFrame, edges: DataFrame, damping: float = 0.85, eps: float = 1e-6, max_iterations: int = 100) -> tuple[DataFrame, int]:
    """(id, rank) on the directed graph, and the iterations taken.

    The mass of vertices without out-edges is spread over all. It stops when the sum
    of changes is below ``eps``; iterations is max_iterations + 1 if it never is. Ids are integers.
    """
    n = vertices.count()
    out = edges.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("out"))
    links = tiles(edges.select(F.col("dst").alias("row"), F.col("src").alias("col")))
    state = cut(vertices.select("id").join(out, "id", "left").withColumn("rank", F.lit(1.0 / max(n, 1))).withColumn("diff", F.lit(0.0)), "ranks")
    for i in range(1, max_iterations + 1):
        dangling = state.agg(F.coalesce(F.sum(F.when(F.col("out").isNull(), F.col("rank"))), F.lit(0.0))).first()[0]
        sent = apply_tiles(links, state.where("out is not null").select(F.col("id").alias("pos"), (F.col("rank") / F.col("out")).alias("val"))).select(F.col("pos").alias("id"), F.col("val").alias("got"))
        base = (1 - damping) / n + damping * dangling / n
        new = base + damping * F.coalesce("got", F.lit(0.0))
        state = cut(state.join(sent, "id", "left").select("id", "out", new.alias("rank"), F.abs(new - F.col("rank")).alias("diff")), "ranks")
        if state.agg(F.sum("diff")).first()[0] < eps:
            return state.select("id", "rank"), i
    return state.select("id", "rank"), max_iterations + 1


def average_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: the mean over vertices of how far two rankings (id, rank) differ, and the
    largest difference. A vertex that one of them lacks has rank 0 there; null for no vertices."""
    both = a.select("id", F.col("rank").alias("x")).join(b.select("id", F.col("rank").alias("y")), "id", "full")
    apart = F.abs(F.coalesce("x", F.lit(0.0)) - F.coalesce("y", F.lit(0.0)))
    return both.agg(F.avg(apart).alias("average_difference"), F.max(apart).alias("largest_difference"))


def apply_matrix(matrix: DataFrame, vector: DataFrame) -> DataFrame:
    """(pos, val): a sparse matrix (row, col, val) times a vector (pos, val); rows without entries are missing."""
    x = vector.select(F.col("pos").alias("col"), F.col("val").alias("x"))
    return matrix.join(x, "col").groupBy(F.col("row").alias("pos")).agg(F.sum(F.col("val") * F.col("x")).alias("val"))


def pagerank_fixed(vertices: DataFrame, edges: DataFrame, iterations: int = 10, damping: float = 0.85, reverse: bool = True) -> DataFrame:
    """(id, rank) after a fixed number of iterations, without regard to vertices that
    send nothing. ``reverse``: a vertex gathers from its out-neighbours, each divided
    by its indegree; else from its in-neighbours, divided by their outdegree."""
    n = vertices.count()
    m = cut(normalized_matrix(edges if reverse else edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))), "matrix")
    v = vertices.select(F.col("id").alias("pos"), F.lit(1.0 / max(n, 1)).alias("val"))
    for _ in range(iterations):
        got = apply_matrix(m, v).withColumnRenamed("val", "g")
        v = cut(vertices.select(F.col("id").alias("pos")).join(got, "pos", "left").select("pos", ((1 - damping) / n + damping * F.coalesce("g", F.lit(0.0))).alias("val")), "ranks")
    return v.select(F.col("pos").alias("id"), F.col("val").alias("rank"))


def dot(a: DataFrame, b: DataFrame) -> float:
    got = a.join(b.select("pos", F.col("val").alias("_y")), "pos").agg(F.sum(F.col("val") * F.col("_y"))).first()[0]
    return got or 0.0


def axpy(k: float, a: DataFrame, b: DataFrame) -> DataFrame:
    """k * a + b."""
    return a.join(b.select("pos", F.col("val").alias("_y")), "pos", "full").select("pos", (k * F.coalesce("val", F.lit(0.0)) + F.coalesce("_y", F.lit(0.0))).alias("val"))


def normalise(v: DataFrame) -> DataFrame:
    length = dot(v, v) ** 0.5
    return v.select("pos", (F.col("val") / (length or 1.0)).alias("val"))


def separator(vertices: DataFrame, edges: DataFrame, iterations: int = 30, seed: int = 3) -> DataFrame:
    """(id, side): the graph split at the median of the second eigenvector of its
    Laplacian, found by powers of (max degree + 1) I - L from a hashed start. ``edges``
    are symmetric; ids are integers."""
    d = cut(vertices.select("id").join(edges.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("d")), "id", "left").select(F.col("id").alias("pos"), F.coalesce("d", F.lit(0)).alias("d")), "degrees")
    top = (d.agg(F.max("d")).first()[0] or 0) + 1
    ones = tiles(edges.select(F.col("src").alias("row"), F.col("dst").alias("col")))
    v = d.select("pos", (F.pmod(F.xxhash64(F.lit(seed), "pos"), F.lit(2001)) / 1000.0 - 1.0).alias("val"))
    for _ in range(iterations):
        mean = v.agg(F.avg("val")).first()[0] or 0.0
        v = v.select("pos", (F.col("val") - mean).alias("val"))
        got = apply_tiles(ones, v).withColumnRenamed("val", "g")
        v = v.join(d, "pos").join(got, "pos", "left").select("pos", ((top - F.col("d")) * F.col("val") + F.coalesce("g", F.lit(0.0))).alias("val"))
        v = normalise(cut(v, "vector"))
    v = cut(v, "vector")
    half = v.agg(F.percentile("val", 0.5)).first()[0]
    return v.select(F.col("pos").alias("id"), (F.col("val") > half).alias("side"))
