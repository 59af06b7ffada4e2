"""Clustering, decision trees and sparse regression."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import cut


def assign(points: DataFrame, centers: np.ndarray) -> DataFrame:
    """(id, center, d2): the nearest center of each point (id, vec), ties to the first."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = np.stack(pdf["vec"].to_numpy()) if len(pdf) else np.empty((0, centers.shape[1]))
            d2 = np.stack([((x - c) ** 2).sum(axis=1) for c in centers], axis=1)
            best = d2.argmin(axis=1)
            yield pd.DataFrame({"id": pdf["id"], "center": best.astype("int32"), "d2": d2[np.arange(len(x)), best]})

    return points.select("id", F.col("vec").cast("array<double>").alias("vec")).mapInPandas(run, "id long, center int, d2 double")


def _sums(points: DataFrame, centers: np.ndarray) -> DataFrame:
    """(center, n, s): how many points (vec) of a batch are nearest to each center, and their sum, added up where they are."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            x = np.stack(pdf["vec"].to_numpy())
            best = np.stack([((x - c) ** 2).sum(axis=1) for c in centers], axis=1).argmin(axis=1)
            found = np.unique(best)
            yield pd.DataFrame({"center": found.astype("int32"), "n": [int((best == c).sum()) for c in found], "s": [x[best == c].sum(axis=0) for c in found]})

    return points.select("vec").mapInPandas(run, "center int, n long, s array<double>")


def kmeans(points: DataFrame, k: int, eps: float = 0.005, max_rounds: int | None = 50, seed: int = 1) -> tuple[np.ndarray, int]:
    """Centers, and the rounds taken: seeded in proportion to squared distance, then
    moved until they move less than ``eps`` together (``max_rounds`` None: however long that takes).

    Seeds are drawn from all points by a hash, so reruns agree. A center without
    points stays. Only centers and their sums reach the driver.
    """
    own = cut(points.select("id", F.col("vec").cast("array<double>").alias("vec")), "points")
    first = own.orderBy(F.xxhash64(F.lit(seed), "id"), "id").first()
    if first is None:
        return np.empty((0, 0)), 0
    centers = np.array([first["vec"]])
    while len(centers) < k:
        near = assign(own, centers).where("d2 > 0")
        # of exponential waiting times the first point is drawn in proportion to d2
        u = (F.pmod(F.xxhash64(F.lit(seed), F.lit(len(centers)), "id"), F.lit(1 << 30)) + 1) / float((1 << 30) + 1)
        wait = near.select("id", (-F.log(u) / F.col("d2")).alias("t"))
        new = wait.orderBy("t", "id").limit(1).join(own, "id").first()
        if new is None:
            break
        centers = np.vstack([centers, new["vec"]])
    dims = centers.shape[1]
    for r in itertools.count(1) if max_rounds is None else range(1, max_rounds + 1):
        got = _sums(own, centers).groupBy("center").agg(F.sum("n").alias("n"), *(F.sum(F.col("s")[i]).alias(f"s{i}") for i in range(dims))).collect()  # a row for each center
        moved = centers.copy()
        for row in got:
            moved[row["center"]] = np.array([row[f"s{i}"] for i in range(dims)]) / row["n"]
        shift = math.sqrt(float(((moved - centers) ** 2).sum()))
        centers = moved
        if not shift >= eps:  # a NaN ends it too
            return centers, r
    return centers, max_rounds


def decision_tree(rows: DataFrame, kinds: dict[str, str], label: str, max_depth: int = 12) -> list[dict]:
    """Nodes of a decision tree on integer features: ``kinds`` says of each whether it is
    discrete (`d`, a branch for each value) or continuous (`i`, a cut).

    Level by level: one aggregation by (node, feature, value, label) serves all nodes
    of a level. The split with the least conditional entropy wins (ties: order of the
    features); a node stays a leaf if that gains less than log2 of the number of
    features bits in all.
    """
    nodes: list[dict] = [{"id": 0, "depth": 0}]
    state = cut(rows.withColumn("_node", F.lit(0)), "tree")
    least = math.log2(max(len(kinds), 1))
    open_ = [0]
    while open_:
        longer = state.select("_node", F.col(label).alias("y"), F.explode(F.array(*(F.struct(F.lit(c).alias("f"), F.col(c).cast("long").alias("v")) for c in kinds))).alias("x"))
        counts = longer.groupBy("_node", "x.f", "x.v", "y").agg(F.count(F.lit(1)).alias("n"))
        # entropies of all cuts, in Spark: a discrete value by itself, a continuous one against the rest below it
        xlog = lambda c: F.when(c > 0, c * F.log2(c)).otherwise(0.0)
        best, sizes = {}, {}
        by_value = counts.groupBy("_node", "f", "v").agg(F.sum("n").alias("n"), F.sum(xlog(F.col("n"))).alias("s"))
        whole = counts.where(F.col("f") == next(iter(kinds))).groupBy("_node", "y").agg(F.sum("n").alias("n")).groupBy("_node").agg(F.sum("n").alias("n"), F.sum(xlog(F.col("n"))).alias("s"), F.max_by("y", F.struct("n", -F.col("y"))).alias("y"))
        for r in whole.collect():  # a row for each open node
            sizes[r["_node"]] = (r["n"], (r["n"] * math.log2(r["n"])) - r["s"], r["y"])
        discrete = [c for c, k in kinds.items() if k == "d"]
        for r in by_value.where(F.col("f").isin(discrete)).groupBy("_node", "f").agg(F.sum(xlog(F.col("n")) - F.col("s")).alias("h"), F.count(F.lit(1)).alias("k")).collect():
            if r["k"] > 1:
                best.setdefault(r["_node"], []).append((r["h"], list(kinds).index(r["f"]), r["f"], None))
        cont = [c for c, k in kinds.items() if k == "i"]
        if cont:
            w = Window.partitionBy("_node", "f", "y").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
            grid = counts.where(F.col("f").isin(cont))
            labels = grid.select("_node", "f", "y").distinct()
            full = grid.select("_node", "f", "v").distinct().join(labels, ["_node", "f"]).join(grid, ["_node", "f", "v", "y"], "left").fillna(0, ["n"])  # values (256 at most) by labels
            total = Window.partitionBy("_node", "f", "y")
            full = full.withColumns({"lo": F.coalesce(F.sum("n").over(w), F.lit(0)), "all": F.sum("n").over(total)}).withColumn("hi", F.col("all") - F.col("lo"))
            cuts_ = full.groupBy("_node", "f", "v").agg(F.sum("lo").alias("a"), F.sum("hi").alias("b"), F.sum(xlog(F.col("lo")) + xlog(F.col("hi"))).alias("s")).where("a > 0 and b > 0")
            for r in cuts_.groupBy("_node", "f").agg(F.min(F.struct((xlog(F.col("a")) + xlog(F.col("b")) - F.col("s")).alias("h"), "v")).alias("c")).collect():
                best.setdefault(r["_node"], []).append((r["c"]["h"], list(kinds).index(r["f"]), r["f"], r["c"]["v"]))
        splits = []
        for node in open_:
            n, h, y = sizes[node]
            nodes[node] |= {"n": n, "label": y}
            found = min(best.get(node, []), default=None)
            if found and h > 0 and h - found[0] >= least and nodes[node]["depth"] < max_depth:
                nodes[node] |= {"feature": found[2], "cut": found[3]}
                splits.append(node)
        if not splits:
            break
        open_ = []
        values: dict[tuple[int, str], list[int]] = {}
        for r in by_value.where(F.col("_node").isin(splits) & F.col("f").isin(discrete)).select("_node", "f", "v").collect() if discrete else []:
            values.setdefault((r["_node"], r["f"]), []).append(r["v"])
        for node in splits:
            f, c = nodes[node]["feature"], nodes[node]["cut"]
            nodes[node]["children"] = {}
            for v in sorted(values[node, f], key=lambda v: (v is not None, v)) if c is None else (0, 1):
                new = len(nodes)
                nodes.append({"id": new, "depth": nodes[node]["depth"] + 1})
                nodes[node]["children"][v] = new
                open_.append(new)
        state = cut(_step(state, "_node", [nodes[i] for i in splits], list(kinds), F.lit(None)).where(F.col("_node").isNotNull()), "tree")
    return nodes


def _step(rows: DataFrame, at: str, inner: list[dict], features: list[str], stay: Column) -> DataFrame:
    """rows with ``at`` moved from an inner node to the child that their feature's value leads to; else ``stay``."""
    spark = rows.sparkSession
    branches = [(n["id"], features.index(n["feature"]), n["cut"], None if v is None else int(v), c) for n in inner for v, c in n["children"].items()]
    table = spark.createDataFrame(branches, "_n int, _f int, _cut long, _v long, _child int")  # a row for each branch of a level
    of = table.groupBy("_n").agg(F.first("_f").alias("_f"), F.first("_cut").alias("_cut"))
    value = F.get(F.array(*(F.col(c).cast("long") for c in features)), F.col("_f"))  # null at leaves; [] reads place -1 there if no feature can be null
    own = rows.join(F.broadcast(of), F.col(at) == F.col("_n"), "left").withColumn("_x", value)
    own = own.withColumn("_x", F.when(F.col("_cut").isNull(), F.col("_x")).otherwise((F.col("_x") >= F.col("_cut")).cast("long"))).drop("_n", "_f", "_cut")
    to = F.broadcast(table.select(F.col("_n"), "_v", "_child"))
    moved = own.join(to, (F.col(at) == F.col("_n")) & F.col("_x").eqNullSafe(F.col("_v")), "left")
    return moved.withColumn(at, F.coalesce(F.col("_child"), stay).cast("int")).drop("_x", "_n", "_v", "_child")


def classify(rows: DataFrame, nodes: list[dict], out: str = "predicted") -> DataFrame:
    """rows with the label of the leaf they reach; a value no branch has stops at its node.

    A level is a join with its branches, so the plan grows with the depth and not with the nodes."""
    inner = [n for n in nodes if "children" in n]
    features = sorted({n["feature"] for n in inner})
    got = rows.withColumn("_at", F.lit(0))
    for depth in sorted({n["depth"] for n in inner}):
        got = _step(got, "_at", [n for n in inner if n["depth"] == depth], features, F.col("_at"))
    labels = rows.sparkSession.createDataFrame([(n["id"], None if n.get("label") is None else int(n["label"])) for n in nodes], f"_n int, {out} long")  # a row for each node
    return got.drop(out).join(F.broadcast(labels), F.col("_at") == F.col("_n"), "left").drop("_at", "_n")


def lasso(rows: DataFrame, features: list[str], target: str, penalty: float, rounds: int = 500) -> np.ndarray:
    """The weights w that minimise sum((x w - y)^2) + penalty * sum |w|.

    One pass gathers the products of features (their square in number); coordinates are
    then moved in turn on these.
    """
    pairs = [(i, j) for i in range(len(features)) for j in range(i, len(features))]
    col = lambda i: F.col(features[i]).cast("double")
    sums = rows.agg(*(F.sum(col(i) * col(j)).alias(f"p{i}_{j}") for i, j in pairs), *(F.sum(col(i) * F.col(target)).alias(f"y{i}") for i in range(len(features)))).first()
    n = len(features)
    a = np.zeros((n, n))
    for i, j in pairs:
        a[i, j] = a[j, i] = sums[f"p{i}_{j}"] or 0.0
    b, w = np.array([sums[f"y{i}"] or 0.0 for i in range(n)]), np.zeros(n)
    for _ in range(rounds):
        old = w.copy()
        for i in range(n):
            if a[i, i] > 0:
                r = b[i] - a[i] @ w + a[i, i] * w[i]
                w[i] = math.copysign(max(abs(r) - penalty / 2, 0.0), r) / a[i, i]
        if np.abs(w - old).max(initial=0.0) < 1e-12:
            break
    return w
