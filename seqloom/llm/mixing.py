"""Mixing sources to target weights by balanced sampling (the cube method).

A source that is to give f times its words gives every document floor(f) times, and
the fraction f - floor(f) is sampled: inclusion probabilities move through the null
space of the constraints (words and documents of the sample) until each is 0 or 1,
but for a small landing problem; what a large document misses there others make up. Sources are cut into blocks; what a block leaves
open is gathered and moved on, until a source has one last block to land.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import as_bytes, cut, groups, mix_int, pieces, word_hashes

#: Documents that one task balances at a time.
BLOCK = 32_768
#: The weights, dealt to the sources in order of their names.
WEIGHTS = (5, 2, 1)
MOST = 3


def sizes(docs: DataFrame, carry: list[str]) -> DataFrame:
    """``carry`` and size: the words of every whole text (null: 0)."""
    fields = docs.select(*carry).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            texts = as_bytes(batch.column(len(carry)))
            n = [np.empty(0, dtype=np.int64), *(word_hashes(texts[a:b])[1] for a, b in groups(texts))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(carry)], pa.array(np.concatenate(n))], names=[*carry, "size"])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    return docs.select(*carry, F.col("text").alias("_text")).mapInArrow(run, f"{kept}, size long")


def targets(measured: DataFrame, source: str, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """By source: source_size and target. All sizes are shared by weight; a target
    stops at ``most`` times its source's size and the excess is shared again.

    The level L with sum(min(L * weight, most * size)) = all sizes is found by
    ordering the sources by most * size / weight, the level at which each is full.
    Its windows run over one row for each source.
    """
    own = measured.groupBy(source).agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col(source).isNull(), source)  # Spark orders strings by code point
    weight = F.array(*map(F.lit, weights))[(F.row_number().over(by_name) - 1) % len(weights)]
    own = own.withColumn("w", weight.cast("double")).withColumn("full", most * F.col("source_size") / F.col("w"))
    everything = Window.partitionBy(F.lit(0))
    before = Window.orderBy("full", F.col(source).isNull(), source).rowsBetween(Window.unboundedPreceding, -1)
    own = own.withColumns(
        {
            "total": F.sum("source_size").over(everything).cast("double"),
            "taken": F.coalesce(F.sum(most * F.col("source_size")).over(before), F.lit(0)).cast("double"),
            "rest_w": F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0)),
        }
    )
    level = (F.col("total") - F.col("taken")) / F.col("rest_w")
    # the first source that is not full at the level of those from it on gives the level; if all are full, none does
    level = F.min(F.when(level <= F.col("full"), F.struct("full", level.alias("level")))).over(everything)["level"]
    own = own.withColumn("level", level)
    target = F.least(F.coalesce(F.col("level") * F.col("w"), F.lit(float("inf"))), (most * F.col("source_size")).cast("double"))
    return own.select(source, "source_size", target.alias("target"))


def fly(p: list[float], size: list[float], rng: np.random.Generator) -> list[float]:
    """The flight: moves the probabilities so that sum(p * size) and sum(p) stay, until
    at most two of them are neither 0 nor 1.

    Three open documents at a time have a null space of one dimension (the cross
    product of their sizes and of ones). The step up or down that first closes one is
    drawn so that no probability changes in expectation.
    """
    p, draws, now = list(p), iter(rng.random(len(p) + 1).tolist()), []
    for i in range(len(p)):
        if not 0 < p[i] < 1:
            continue
        now.append(i)
        if len(now) < 3:
            continue
        a, b, c = (size[k] for k in now)
        u = (b - c, c - a, a - b) if not a == b == c else (1.0, -1.0, 0.0)
        up = down = float("inf")
        for k, v in zip(now, u, strict=True):
            if v > 0:
                up, down = min(up, (1 - p[k]) / v), min(down, p[k] / v)
            elif v < 0:
                up, down = min(up, -p[k] / v), min(down, (p[k] - 1) / v)
        step = up if next(draws) * (up + down) < down else -down
        still = []
        for k, v in zip(now, u, strict=True):
            q = p[k] + step * v
            p[k] = 0.0 if q < 1e-9 else 1.0 if q > 1 - 1e-9 else q
            if 0 < p[k] < 1:
                still.append(k)
        now = still
    return p


def land(p: list[float], size: list[float]) -> list[float]:
    """The landing: of all choices for the few open probabilities, the one that misses
    the words least, then the documents; ties go to the fewest documents."""
    p = list(p)
    at = [i for i, v in enumerate(p) if 0 < v < 1]
    best = None
    for choice in range(1 << len(at)):
        bits = [choice >> k & 1 for k in range(len(at))]
        words = abs(sum((b - p[i]) * size[i] for b, i in zip(bits, at, strict=True)))
        seen = (round(words, 6), abs(sum(bits) - sum(p[i] for i in at)), sum(bits), bits)
        best = seen if best is None else min(best, seen)
    for i, b in zip(at, best[3], strict=True):
        p[i] = float(b)
    return p


def settle(p: list[float], first: list[float], size: list[float], most: int = 64) -> list[float]:
    """After the landing: what a large document misses is made up by others of its block.

    Documents change sides, alone or one against another, each time those that leave
    the least miss of words, while it gets less; ``most`` changes at most.
    """
    q, z = np.array(p), np.array(size)
    free = (np.array(first) > 0) & (np.array(first) < 1)
    miss = float(np.dot(q - np.array(first), z))
    for _ in range(most):
        ins, outs = np.flatnonzero(free & (q == 1)), np.flatnonzero(free & (q == 0))
        outs = outs[np.argsort(z[outs], kind="stable")]
        options = [(abs(miss - z[i]), i, -1) for i in ins] + [(abs(miss + z[j]), -1, j) for j in outs]
        if len(ins) and len(outs):
            near = np.searchsorted(z[outs], z[ins] - miss)
            for k in (near - 1, near):
                j = outs[np.clip(k, 0, len(outs) - 1)]
                left = np.abs(miss - z[ins] + z[j])
                b = int(left.argmin())
                options.append((float(left[b]), int(ins[b]), int(j[b])))
        best = min(options, default=(abs(miss), -1, -1))
        if not best[0] < abs(miss) - 1e-6:
            break
        for k, v in ((best[1], 0.0), (best[2], 1.0)):
            if k >= 0:
                miss += (v - q[k]) * z[k]
                q[k] = v
    return q.tolist()


def _move(last: bool):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        # large documents first: what is left to land is small
        pdf = pdf.sort_values(["size", "spot", "key", "copy"], ascending=[False, True, True, True], kind="stable").reset_index(drop=True)
        size = pdf["size"].astype(float).tolist()
        p = fly(pdf["p"].tolist(), size, np.random.default_rng(mix_int(int(pdf["spot"].iloc[0]) ^ len(pdf))))
        return pdf.assign(p=settle(land(p, size), pdf["p"].tolist(), size) if last else p)

    return run


def take(measured: DataFrame, source: str, key: str, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``measured`` (with ``source``, ``key`` and size) with source_size, target and taken:
    the words that the mix takes of each document, repeats counted.

    A document is taken floor(target / source_size) times or once more. A null source
    is a source like any other, the last in order; a null key sorts first. Documents
    without words take no part and give 0. Repeated rows are sampled each on their
    own. Reruns give the same rows, whatever the partitioning: blocks follow from
    hashes of the key, their order from key, size and the number of the copy. An empty
    table gives an empty result. Other columns are carried, whatever their names; one that
    is called source_size, target or taken gives way to the result of that name.
    """
    spark, schema = measured.sparkSession, measured.schema
    carried = [c for c in schema.names if c not in (source, key, "size", "source_size", "target", "taken")]
    aside = [F.struct(*(F.col(f"`{c}`") for c in carried)).alias("_row")] if carried else []
    measured = measured.select(F.col(f"`{source}`").alias("source"), F.col(f"`{key}`").alias("key"), "size", *aside)
    shares = targets(measured, "source", weights, most).withColumnRenamed("source", "_s")
    f = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    copies = Window.partitionBy("_g", "key", "size", "source").orderBy(F.lit(0))
    own = measured.withColumn("_g", F.xxhash64("key", "size"))
    own = own.withColumn("_copy", F.row_number().over(copies)).drop("_g")
    own = own.join(shares, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s").withColumn("_f", f)
    own = cut(own.withColumn("_times", F.floor(F.col("_f") + 1e-9)).withColumn("_p", F.greatest(F.col("_f") - F.col("_times"), F.lit(0.0))), "mix")
    open_ = own.where((F.col("size") > 0) & (F.col("_p") > 1e-9)).select(
        "source", "key", "size", F.col("_copy").alias("copy"), F.col("_p").alias("p"), F.xxhash64("key", "size", "_copy").alias("spot"),
    )
    counts = open_.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    blocks = F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(F.col("n") / BLOCK, F.lit(1.0))))).cast("long")
    counts = counts.select(F.col("source").alias("_s"), blocks.alias("blocks"))
    open_ = open_.join(counts, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
    fields = "source {0}, key {1}, size long, copy int, p double, spot long, blocks long".format(schema[source].dataType.simpleString(), schema[key].dataType.simpleString())
    done = []
    while True:
        most_blocks = open_.agg(F.max("blocks")).first()[0]
        if most_blocks is None:
            break
        last = most_blocks == 1
        moved = open_.groupBy("source", F.expr("pmod(shiftrightunsigned(spot, 20), blocks)").alias("block")).applyInPandas(_move(last), fields)
        moved = cut(moved, "flight")
        done.append(moved.where("p <= 0 or p >= 1"))
        if last:
            break
        # a block leaves two documents open at most: the next blocks hold what BLOCK / 4 of these left
        open_ = moved.where("p > 0 and p < 1").withColumn("blocks", F.greatest(F.expr(f"shiftright(blocks, {int(np.log2(BLOCK // 4))})"), F.lit(1)))
    if done:
        chosen = done[0]
        for more in done[1:]:
            chosen = chosen.unionByName(more)
        chosen = chosen.where("p >= 1").select(F.col("key").alias("_k"), F.col("size").alias("_z"), F.col("copy").alias("_n"), F.col("source").alias("_s"), F.lit(1).alias("_once"))
    else:
        chosen = spark.createDataFrame([], f"_k {schema[key].dataType.simpleString()}, _z long, _n int, _s {schema[source].dataType.simpleString()}, _once int")
    match = F.col("key").eqNullSafe(F.col("_k")) & (F.col("size") == F.col("_z")) & (F.col("_copy") == F.col("_n")) & F.col("source").eqNullSafe(F.col("_s"))
    out = own.join(chosen, match, "left")
    taken = (F.col("size") * (F.col("_times") + F.coalesce(F.col("_once"), F.lit(0)))).cast("long")
    back = {source: F.col("source"), key: F.col("key"), "size": F.col("size")} | {c: F.col(f"_row.`{c}`") for c in carried}
    return out.select(*(back[c].alias(c) for c in schema.names if c in back), "source_size", "target", taken.alias("taken"))
