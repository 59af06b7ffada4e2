"""Random and regular graphs. The same seed gives the same graph, whatever the partitioning."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..storage import cut


def _unit(seed: int, *cols: Column | str) -> Column:
    """A hash of seed and columns in [0, 1)."""
    return F.pmod(F.xxhash64(F.lit(seed), *cols), F.lit(1 << 40)) / float(1 << 40)


def grid(spark: SparkSession, side: int) -> DataFrame:
    """Half-edges of a side x side grid with eight neighbours."""
    at = spark.range(side * side).select("id", F.floor(F.col("id") / side).alias("r"), (F.col("id") % side).alias("c"))
    steps = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b))
    out = at.select("id", "r", "c", F.explode(steps).alias("s")).select("id", (F.col("r") + F.col("s.a")).alias("r"), (F.col("c") + F.col("s.b")).alias("c"))
    return out.where(F.col("r").between(0, side - 1) & F.col("c").between(0, side - 1)).select(F.col("id").alias("src"), (F.col("r") * side + F.col("c")).alias("dst"))


def rmat(spark: SparkSession, n: int, m: int, a: float = 0.5, b: float = 0.15, c: float = 0.15, seed: int = 1) -> DataFrame:
    """Distinct edges of ``m`` draws in a recursively quartered matrix of side ``n`` (a power of two)."""
    bits = int(math.log2(n))
    src, dst = F.lit(0).cast("long"), F.lit(0).cast("long")
    for k in range(bits):
        u = _unit(seed, "id", F.lit(k))
        src = src * 2 + (u >= a + b).cast("long")
        dst = dst * 2 + ((u >= a) & (u < a + b) | (u >= a + b + c)).cast("long")
    return spark.range(m).select(src.alias("src"), dst.alias("dst")).where("src <> dst").distinct()


def uniform_digraph(spark: SparkSession, n: int, degree: float, seed: int = 1) -> DataFrame:
    """Directed edges: every ordered pair, a vertex with itself too, with probability degree / n.

    Gaps between the pairs drawn are geometric, so only drawn pairs are made: each
    source draws its targets by skipping.
    """
    return _skips(spark, n, min(1.0, degree / max(n, 1)), seed)


def _skips(spark: SparkSession, n: int, p: float, seed: int) -> DataFrame:
    """(src, dst) below ``n``, each pair drawn with probability ``p``. Gaps are added up by batches."""
    ids = spark.range(n).select("id")
    if p >= 1:
        return ids.select(F.col("id").alias("src"), F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<bigint>")).alias("dst"))
    if p <= 0:
        return ids.select(F.col("id").alias("src"), F.col("id").alias("dst")).limit(0)
    most = int(n * p + 12 * math.sqrt(n * p) + 24)
    gap = lambda i: F.floor(F.log(1 - _unit(seed, "id", i)) / math.log(1 - p)).cast("bigint") + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            at = np.cumsum(rows["gaps"].flatten().to_numpy().reshape(rows.num_rows, -1), axis=1) - 1
            drawn = at < n
            src = np.repeat(rows["id"].to_numpy(), drawn.sum(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(src), pa.array(at[drawn])], names=["src", "dst"])

    gaps = ids.select("id", F.transform(F.sequence(F.lit(0), F.lit(most)), gap).alias("gaps"))
    return gaps.mapInArrow(run, "src long, dst long")


def block_model(spark: SparkSession, n: int, k: int, p_in: float, p_out: float, seed: int = 1) -> DataFrame:
    """Edges (src < dst, w in [0.1, 1)) of ``n`` vertices in ``k`` blocks (id mod k), with
    probability p_in within a block and p_out between."""
    top = max(p_in, p_out)
    drawn = _skips(spark, n, top, seed).where("src < dst")
    p = F.when(F.col("src") % k == F.col("dst") % k, p_in).otherwise(p_out)
    return drawn.where(_unit(seed + 1, "src", "dst") < p / top).select("src", "dst", edge_weight(seed + 2).alias("w"))


def edge_weight(seed: int, low: float = 0.1, high: float = 1.0) -> Column:
    """A weight that both directions of an edge share."""
    return F.lit(low) + (high - low) * _unit(seed, F.least("src", "dst"), F.greatest("src", "dst"))


def barabasi_albert(spark: SparkSession, n: int, m0: int, m: int, seed: int = 1) -> DataFrame:
    """Edges of a graph grown from a complete one of ``m0``: each new vertex takes ``m``
    different vertices in proportion to degree (all there are, while these are no more).

    To draw in proportion to degree is to draw an end of the edges before. Which end follows
    from a hash, so a task finds the ends of its vertices alone: an end that was drawn itself is
    drawn again, over about log n vertices before it.
    """
    base = m0 if n <= m0 or m < 1 else min(n, max(m0, m + 1))
    first = [(i, j) for i in range(base) for j in range(i)]
    whole = spark.createDataFrame(first, "src long, dst long")
    if m < 1 or n <= base:
        return whole

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        drawn: dict[int, list[int]] = {}
        for pdf in batches:
            ids = pdf["id"].tolist()
            out = [sorted(_drawn_ends(v, m, m, base, first, seed, drawn)) for v in ids]
            yield pd.DataFrame({"src": np.repeat(np.array(ids, dtype=np.int64), m), "dst": np.array(out, dtype=np.int64).reshape(-1)})
            if len(drawn) > 200_000:
                drawn.clear()

    return whole.unionByName(spark.range(base, n).mapInPandas(run, "src long, dst long"))


def _drawn_ends(v: int, k: int, m: int, base: int, first: list[tuple[int, int]], seed: int, drawn: dict[int, list[int]]) -> list[int]:
    """The first ``k`` different vertices that ``v`` draws; ``drawn`` remembers them."""
    got = drawn.get(v, [])
    if len(got) >= k:
        return got[:k]
    got, t, inner = [], 0, 2 * len(first)
    key, ends = _mix(v + seed * 0x9E3779B97F4A7C15), inner + 2 * (v - base) * m
    while len(got) < k:
        r, t = _mix(key + t) % ends, t + 1
        if r < inner:
            u = first[r // 2][r % 2]
        else:
            e = (r - inner) // 2
            u = base + e // m  # who made the edge, or whom it drew
            if r % 2:
                u = _drawn_ends(u, e % m + 1, m, base, first, seed, drawn)[e % m]
        if u not in got:
            got.append(u)
    drawn[v] = got
    return got


def _mix(x: int) -> int:
    """64 mixed bits of an integer."""
    x = (x + 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & 0xFFFFFFFFFFFFFFFF
    x = (x ^ x >> 27) * 0x94D049BB133111EB & 0xFFFFFFFFFFFFFFFF
    return x ^ x >> 31


def watts_strogatz(spark: SparkSession, n: int, k: int, beta: float, closed: bool = False, seed: int = 1) -> DataFrame:
    """Edges of a lattice in which each vertex has k / 2 neighbours on each side, each
    edge's far end moved with probability ``beta`` to another vertex.

    ``closed`` joins the ends of the lattice. An end that makes a loop or a duplicate is
    drawn again, 100 times at most, and stays where it was after that. All edges draw at
    once, and of equal ones the first keeps its place: a round is one exchange by pair.
    """
    out = spark.range(n).select(F.col("id").alias("src"), F.explode(F.sequence(F.lit(1), F.lit(k // 2))).alias("d")).select("src", "d", (F.col("src") + F.col("d")).alias("dst"))
    out = out.withColumn("dst", F.col("dst") % n) if closed else out.where(F.col("dst") < n)
    if beta <= 0:
        return out.select("src", "dst")
    drawn = out.withColumns({"e": F.col("src") * k + F.col("d"), "moves": _unit(seed, "src", "d") < beta, "tries": F.lit(0)})
    state = cut(drawn.select("e", "src", "dst", "moves", "tries", F.col("dst").alias("old")), "lattice")
    while True:
        # of edges that join the same two vertices the first that does not move stays, else the first that moves
        pair = Window.partitionBy(F.least("src", "dst"), F.greatest("src", "dst")).orderBy("moves", "e")
        far = F.floor(_unit(seed + 1, "e", "tries") * n).cast("long")
        placed = state.withColumn("dst", F.when(F.col("moves"), far).otherwise(F.col("dst")))
        judged = placed.withColumn("bad", F.col("moves") & ((F.col("src") == F.col("dst")) | (F.row_number().over(pair) > 1)))
        judged = cut(judged, "rewired")
        if judged.where("bad").isEmpty():
            return judged.select("src", "dst")
        again = F.col("bad") & (F.col("tries") < 100)
        stays = F.col("bad") & ~again
        state = judged.select("e", "src", F.when(stays, F.col("old")).otherwise(F.col("dst")).alias("dst"), (F.col("moves") & ~stays).alias("moves"), (F.col("tries") + again.cast("int")).alias("tries"), "old")
