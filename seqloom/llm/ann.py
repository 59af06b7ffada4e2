"""Approximate nearest neighbours by a forest of random-projection trees.

Inner products become distances on a sphere: vectors are scaled by the largest norm and
given one more component that brings each to norm 1, queries are scaled to norm 1. The
trees are fitted on a bounded sample and index every vector. A query searches all trees
through one priority queue of cells, nearest first, up to the distance at which a
neighbour is unlikely to lie beyond; candidates are ranked by exact inner products.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Rows that the trees are fitted on, trees, and vectors that a leaf aims at.
FIT_ROWS, TREES, LEAF = 16_384, 4, 256
#: How far a query looks. Along a random direction, a neighbour at distance r lies off by
#: r / sqrt(dimensions) in the mean square; cells REACH times as far off are searched.
REACH = 1.2
#: Subtrees of a tree, at least, that are searched in a task each; vectors, and queries, that meet in one at most.
BINS, BLOCK, QUERIES = 8, 8_192, 16_384


class Forest:
    """Random-projection trees: at each node a random direction and the median along it."""

    def __init__(self, sample: np.ndarray, trees: int, depth: int, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.depth, self.planes, self.cuts = depth, [], []
        for _ in range(trees):
            planes = rng.normal(size=((1 << depth) - 1, sample.shape[1]))
            planes /= np.linalg.norm(planes, axis=1)[:, None]
            cuts, node = np.zeros(len(planes)), np.zeros(len(sample), dtype=np.int64)
            for level in range(depth):
                first = (1 << level) - 1
                along = np.einsum("ij,ij->i", sample, planes[first + node]) if len(sample) else np.empty(0)
                order = np.argsort(node, kind="stable")
                bounds = np.searchsorted(node[order], np.arange((1 << level) + 1))
                for k in range(1 << level):
                    own = along[order[bounds[k] : bounds[k + 1]]]
                    cuts[first + k] = np.median(own) if len(own) else 0.0
                node = 2 * node + (along > cuts[first + node])
            self.planes.append(planes.astype(np.float32))
            self.cuts.append(cuts)

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each vector in each tree."""
        out = np.zeros((len(x), len(self.planes)), dtype=np.int64)
        for t, (planes, cuts) in enumerate(zip(self.planes, self.cuts, strict=True)):
            for level in range(self.depth):
                at = (1 << level) - 1 + out[:, t]
                out[:, t] = 2 * out[:, t] + (np.einsum("ij,ij->i", x, planes[at].astype(np.float64)) > cuts[at])
        return out

    def search(self, x: np.ndarray, reach: float) -> list[tuple[int, int]]:
        """Leaves (tree, leaf) across all trees by the squared distance to their cells (the
        sum over the planes in between), up to ``reach``; one leaf of each tree at least."""
        margins = [(p @ x - c).tolist() for p, c in zip(self.planes, self.cuts, strict=True)]
        queue = [(0.0, t, 0, 0) for t in range(len(self.planes))]
        found = []
        while queue and queue[0][0] <= reach:
            far, t, level, node = heapq.heappop(queue)
            while level < self.depth:
                m = margins[t][(1 << level) - 1 + node]
                near = m > 0
                heapq.heappush(queue, (far + m * m, t, level + 1, 2 * node + (not near)))
                node, level = 2 * node + near, level + 1
            found.append((t, node))
        return found


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 1))


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, vec as doubles) of the vectors that take part: not null, without null or
    non-finite components, not zero; shorter ones are filled with zeros."""
    v = F.col("vec")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    own = vectors.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("vec"))
    own = own.where(F.col("id").isNotNull() & v.isNotNull() & (F.size(v) > 0)).where(~bad & F.exists(v, lambda x: x != 0))
    longest = own.agg(F.max(F.size(v))).first()[0] or 0
    return own.select("id", F.when(F.size(v) < longest, F.concat(v, F.array_repeat(F.lit(0.0), F.lit(longest) - F.size(v)))).otherwise(v).alias("vec"))


def _on_sphere(x: np.ndarray, scale: float, largest: float) -> np.ndarray:
    """Vectors scaled by the largest norm, with the component that brings each to norm 1."""
    x = x / scale / largest
    return np.concatenate([x, np.sqrt(np.maximum(0.0, 1.0 - (x * x).sum(axis=1)))[:, None]], axis=1)


def _asked(x: np.ndarray, scale: float) -> np.ndarray:
    """Queries scaled to norm 1, with a component of 0."""
    x = x / scale
    x = x / np.abs(x).max(axis=1)[:, None]
    return np.concatenate([x / np.linalg.norm(x, axis=1)[:, None], np.zeros((len(x), 1))], axis=1)


def _spans(first: np.ndarray, leaves: list[int]) -> list[tuple[int, int]]:
    """The ranges of rows of ``leaves``, of which each begins where ``first`` says; those that touch are one."""
    out: list[tuple[int, int]] = []
    for leaf in sorted(set(leaves)):
        a, b = int(first[leaf]), int(first[leaf + 1])
        if out and out[-1][1] == a:
            out[-1] = (out[-1][0], b)
        elif a < b:
            out.append((a, b))
    return out


def _best(ids: np.ndarray, x: np.ndarray, q: np.ndarray, spans: list[tuple[int, int]], own, k: int, largest: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows (of ids, x) and scores of the ``k`` ids nearest to ``q`` among the rows in ``spans``
    whose id is not ``own``; of an id the nearest row. Other rows are not looked at. No
    component is beyond ``largest``."""
    if not spans:
        return np.empty(0, dtype=np.int64), np.empty(0)
    rows = np.concatenate([np.arange(a, b) for a, b in spans])
    rough = np.concatenate([x[a:b] @ q for a, b in spans])
    may = ids[rows] != own
    rows, rough = rows[may], rough[may]
    room, n = k, len(rows)
    while True:  # more than k rows are looked at only where ids repeat
        if room < n:
            edge = np.partition(rough, n - room)[n - room]
            slack = 1e-9 * largest * float(np.abs(q).sum())  # rough scores are off by less
            at = rows[rough >= edge - slack]
        else:
            at = rows
        score = (x[at] * q).sum(axis=1)
        order = np.lexsort((ids[at], -score))
        first = np.sort(np.unique(ids[at][order], return_index=True)[1])[:k]
        if len(first) == k or room >= n:
            return at[order[first]], score[order[first]]
        room *= 8


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, key: str = "vec_id", vector: str = "embedding", reach: float = REACH) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the ``k`` found for each query with the
    largest inner products (in double precision, on the vectors as given), nearest
    first, ties to the smaller id.

    Vectors that are null or zero, or hold null or non-finite components, take no part,
    nor do rows with a null id; shorter vectors count as followed by zeros. A query's
    own id is no candidate. Of repeated ids the nearest vector counts, and an id asked
    with several vectors has the best of all. With fewer than ``k`` candidates all are
    returned; an empty table gives an empty result. Only ``key`` and
    ``vector`` are read.
    """
    spark = vectors.sparkSession
    own = cut(usable(vectors, key, vector), "vectors")
    scale = own.agg(F.max(F.array_max(F.transform("vec", F.abs)))).first()[0]
    kind = own.schema["id"].dataType.simpleString()
    if scale is None:
        return spark.createDataFrame([], f"query_id {kind}, rank int, vec_id {kind}, score double")
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + (x / scale) * (x / scale)))
    total, largest = own.agg(F.count(F.lit(1)), F.max(norm)).first()
    asked = queries.select(F.col(key).alias("id")).distinct().join(own, "id")
    share = FIT_ROWS / total
    spot = F.pmod(F.xxhash64("id", "vec"), F.lit(1 << 30))
    fitted = own.where(spot < int(min(1.0, share) * (1 << 30))).orderBy(spot, "id").limit(FIT_ROWS).toPandas()
    fitted = fitted if len(fitted) else own.limit(1).toPandas()
    sample = _on_sphere(np.stack([np.asarray(x, dtype=np.float64) for x in fitted["vec"]]), scale, largest)
    depth = int(max(1, min(np.ceil(np.log2(max(2, total / LEAF))), np.log2(max(4, len(sample))) - 1)))
    # the sample's neighbour that is as far as the k-th of all, or farther; an id is one neighbour
    single = sample[~fitted["id"].duplicated().to_numpy()]
    beyond = max(1, int(np.ceil(k * len(single) / own.select("id").distinct().count())))
    # bounded by FIT_ROWS: TREES * FIT_ROWS / 2 directions, and the sample
    fit = spark.sparkContext.broadcast((Forest(sample, TREES, depth), single.astype(np.float32)))
    bins = min(1 << depth, max(BINS, 1 << max(0, int(np.ceil(np.log2(total / BLOCK))))))
    wide = (1 << depth) // bins  # leaves of a bin
    fields = f"tree int, leaf int, bin int, id {kind}, vec array<double>"

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaves = fit.value[0].leaves(_on_sphere(_matrix(batch.column(1)), scale, largest)) if batch.num_rows else np.empty((0, TREES), dtype=np.int64)
            for t in range(TREES):
                columns = [np.full(len(leaves), t, dtype=np.int32), leaves[:, t].astype(np.int32), (leaves[:, t] // wide).astype(np.int32)]
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), *batch.columns], names=["tree", "leaf", "bin", "id", "vec"])

    indexed = cut(own.mapInArrow(index, fields), "index")
    sizes = np.zeros((TREES, bins), dtype=np.int64)
    for r in indexed.groupBy("tree", "bin").count().collect():  # a row for each bin, bounded as the trees are
        sizes[r["tree"], r["bin"]] = r["count"]
    blocks = F.pmod(F.xxhash64("id", "vec"), F.ceil(_lookup(sizes) / BLOCK))

    def search(asked: DataFrame, reach: float) -> DataFrame:
        """(query_id, vec_id, score): the best of every task that a query meets candidates in."""
        parts = max(1, -(-asked.count() // QUERIES))
        left = indexed.withColumn("block", blocks).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        right = asked.mapInArrow(visit(reach), f"tree int, bin int, block long, leaves array<int>, id {kind}, vec array<double>").withColumn("part", F.pmod(F.hash("id"), F.lit(parts)))
        by = ["tree", "bin", "block", "part"]
        return left.select(*by, "leaf", "id", "vec").groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(rank, f"query_id {kind}, vec_id {kind}, score double")

    def best(found: DataFrame) -> DataFrame:
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    def visit(reach: float):
        return lambda batches: _visit(batches, reach)

    def _visit(batches: Iterator[pa.RecordBatch], reach: float) -> Iterator[pa.RecordBatch]:
        forest, known = fit.value
        for batch in batches:
            if not batch.num_rows:
                continue
            z = _asked(_matrix(batch.column(1)), scale)
            for a in range(0, len(z), 256):
                near = z[a : a + 256].astype(np.float32) @ known.T
                near = np.partition(near, -min(beyond + 1, near.shape[1]), axis=1)[:, -min(beyond + 1, near.shape[1])]  # a query is in the sample itself, maybe
                bounds = reach * reach * np.maximum(0.0, 2 - 2 * near.astype(np.float64)) / z.shape[1]
                at, rows = {}, []
                for i, bound in enumerate(bounds.tolist(), a):
                    for t, leaf in forest.search(z[i], bound):
                        at.setdefault((i, t, leaf // wide), []).append(leaf)
                for (i, t, b), leaves in at.items():
                    rows += [(t, b, x, i, leaves) for x in range(-(-int(sizes[t, b]) // BLOCK))]
                t, b, x, i, leaves = zip(*rows, strict=True) if rows else ((), (), (), (), ())
                own_rows = pa.array(i, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(t, pa.int32()), pa.array(b, pa.int32()), pa.array(x, pa.int64()), pa.array(leaves, pa.list_(pa.int32())), batch.column(0).take(own_rows), batch.column(1).take(own_rows)], names=["tree", "bin", "block", "leaves", "id", "vec"])

    def rank(candidates: pa.Table, visits: pa.Table) -> pa.Table:
        asked_ids, out = visits.column("id").to_numpy(), ([], [], [])
        if candidates.num_rows and visits.num_rows:
            # rows in order of leaf: a query's products are those of the leaves it visits, and no others
            leaf = candidates.column("leaf").to_numpy() % wide
            candidates = candidates.take(pa.array(np.argsort(leaf, kind="stable")))
            first = np.searchsorted(np.sort(leaf), np.arange(wide + 1))
            ids, x, q = candidates.column("id").to_numpy(), _matrix(candidates.column("vec")), _matrix(visits.column("vec"))
            largest = float(np.abs(x).max())
            for i, leaves in enumerate(visits.column("leaves").to_pylist()):
                rows, score = _best(ids, x, q[i], _spans(first, [v % wide for v in leaves]), asked_ids[i], k, largest)
                out[0].append(np.full(len(rows), i))
                out[1].append(rows)
                out[2].append(score)
        i, rows, score = (np.concatenate(v) if v else np.empty(0, dtype=np.int64) for v in out)
        columns = [visits.column("id").take(pa.array(i, pa.int64())), candidates.column("id").take(pa.array(rows, pa.int64())), pa.array(score, pa.float64())]
        return pa.table(columns, names=["query_id", "vec_id", "score"])

    got = cut(best(search(asked, reach)), "nearest")
    # few neighbours in reach (of ids that repeat, say): such queries search every leaf
    full = got.groupBy(F.col("query_id").alias("id")).count().where(F.col("count") == k)
    short = cut(asked.join(full, "id", "left_anti"), "short")
    if short.isEmpty():
        return got
    return got.join(short.select(F.col("id").alias("query_id")).distinct(), "query_id", "left_anti").unionByName(best(search(short, float("inf"))))


def _lookup(sizes: np.ndarray):
    """The size of the row's bin, from a literal map of the bins that need several blocks."""
    large = [(int(t), int(b)) for t, b in zip(*np.nonzero(sizes > BLOCK), strict=True)]
    if not large:
        return F.lit(1)
    table = F.create_map(*(x for t, b in large for x in (F.lit(t * sizes.shape[1] + b), F.lit(int(sizes[t, b])))))
    return F.coalesce(F.try_element_at(table, (F.col("tree") * sizes.shape[1] + F.col("bin")).cast("int")), F.lit(1))
