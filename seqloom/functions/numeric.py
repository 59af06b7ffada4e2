"""Big integers, transforms, fits, primes and range queries."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import cut


def _big(op):
    @F.pandas_udf(T.StringType())
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else str(op(int(x), int(y))) for x, y in zip(a, b, strict=True)], dtype=object)

    return run


def big_add(a: Column, b: Column) -> Column:
    """The sum of two integers of any length, as decimal texts."""
    return _big(lambda x, y: x + y)(a, b)


def big_subtract(a: Column, b: Column) -> Column:
    return _big(lambda x, y: x - y)(a, b)


def big_multiply(a: Column, b: Column) -> Column:
    return _big(lambda x, y: x * y)(a, b)


def fft(seq: DataFrame, group: str) -> DataFrame:
    """(group, pos, re, im): the discrete Fourier transform exp(-2 pi i / n) of each group's values.

    A group is transformed in one task; its length is a power of two.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        if len(pdf) & (len(pdf) - 1):
            raise ValueError("the length is not a power of two")
        f = np.fft.fft(pdf["val"].to_numpy())
        return pd.DataFrame({group: pdf[group].to_numpy(), "pos": np.arange(len(f)), "re": f.real, "im": f.imag})

    kind = dict(seq.dtypes)[group]
    return seq.select(group, "pos", F.col("val").cast("double").alias("val")).groupBy(group).applyInPandas(run, f"{group} {kind}, pos long, re double, im double")


def line_fit(points: DataFrame) -> DataFrame:
    """One row: slope and intercept of the least-squares line through (x, y)."""
    return points.agg(F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"))


def primes(spark: SparkSession, n: int, segment: int = 1 << 18) -> DataFrame:
    """(p) of all primes up to ``n``: numbers without the multiples of primes up to its root.

    Segments of ``segment`` numbers, or the root of ``n`` if that is more, are sieved where they
    are. Only primes up to the root go to every task.
    """
    if n < 2:
        return spark.range(0).select(F.col("id").alias("p"))
    if n < 4:
        return spark.range(2, n + 1).select(F.col("id").alias("p"))
    root = math.isqrt(n)
    size = max(segment, root)
    small = primes(spark, root, segment).agg(F.collect_list("p").alias("small"))  # one row, of the primes up to the root

    def sieve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, start in enumerate(batch.column(0).to_pylist()):
                end = min(start + size, n + 1)
                left = np.ones(end - start, dtype=bool)
                left[: max(0, 2 - start)] = False
                for q in batch.column(1)[i].values.to_numpy().tolist():
                    left[max(q * q, -(-start // q) * q) - start :: q] = False
                yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(left) + start)], names=["p"])

    starts = spark.range(0, n + 1, size, max(1, min(-(-(n + 1) // size), 1_000)))
    return starts.crossJoin(F.broadcast(small)).mapInArrow(sieve, "p long")


def integrate(spark: SparkSession, f: Column, start: float, end: float, n: int) -> DataFrame:
    """One row: the midpoint rule with ``n`` steps; ``f`` is an expression of ``x``."""
    step = (end - start) / n
    return spark.range(n).select((F.lit(start + step / 2) + F.col("id") * step).alias("x")).agg((F.sum(f) * step).alias("integral"))


def range_min(seq: DataFrame, queries: DataFrame, block: int = 64) -> DataFrame:
    """(q, pos): the first position of the least value in positions i..j (inclusive) of each query (q, i, j).

    A query over several blocks takes the least from i to its block's end, that from the start of
    j's block to j, and of the whole blocks between them two runs of 2**k blocks that may
    overlap. One within a block looks at its elements, ``block`` at most.
    """
    b = F.floor(F.col("pos") / block)
    in_block = Window.partitionBy("b")
    m = F.struct("val", "pos")
    from_start, to_end = (F.min(m).over(in_block.orderBy(o).rowsBetween(Window.unboundedPreceding, 0)) for o in (F.asc("pos"), F.desc("pos")))
    placed = cut(seq.select("pos", "val", b.alias("b")).withColumns({"upto": from_start, "since": to_end}), "placed")
    level = cut(placed.groupBy("b").agg(F.min(m).alias("m")), "runs")
    last = placed.agg(F.max("pos")).first()[0]
    last = -1 if last is None else last
    top, k = last // block + 1, 0
    runs = level.withColumn("k", F.lit(0))
    while 2 << k <= top:
        later = level.select((F.col("b") - (1 << k)).alias("b"), F.col("m").alias("n"))
        level = cut(level.join(later, "b", "left").select("b", F.least("m", "n").alias("m")), "runs")
        k += 1
        runs = runs.unionByName(level.withColumn("k", F.lit(k)))
    lo, hi = F.floor(F.col("i") / block), F.floor(F.col("j") / block)
    within = queries.where("i <= j").select("q", F.greatest("i", F.lit(0)).cast("long").alias("i"), F.least("j", F.lit(last)).cast("long").alias("j")).where("i <= j")
    asked = cut(within.select("q", "i", "j", lo.alias("lo"), hi.alias("hi")), "asked")
    wide = asked.where("lo < hi")
    parts = [wide.select("q", F.col("i").alias("pos")).join(placed, "pos").select("q", F.col("since").alias("m")), wide.select("q", F.col("j").alias("pos")).join(placed, "pos").select("q", F.col("upto").alias("m"))]
    inner = asked.where("hi - lo > 1").withColumn("k", (F.length(F.bin(F.col("hi") - F.col("lo") - 1)) - 1).cast("int"))
    starts = F.array_distinct(F.array(F.col("lo") + 1, F.col("hi") - F.expr("shiftleft(1L, k)")))
    parts.append(inner.select("q", "k", F.explode(starts).alias("b")).join(runs, ["k", "b"]).select("q", "m"))
    parts.append(asked.where("lo = hi").select("q", F.explode(F.sequence("i", "j")).alias("pos")).join(placed, "pos").select("q", m.alias("m")))
    found = reduce(lambda x, y: x.unionByName(y), parts)
    return found.groupBy("q").agg(F.min("m").alias("m")).select("q", F.col("m.pos").alias("pos"))


def cycle_count(permutation: DataFrame, least: int = 100_000) -> int:
    """Cycles of a permutation (pos, val).

    Each round takes positions out of their cycles: of those that a coin, thrown anew, chooses,
    those whose position before was not chosen, which then leads on to the one after. That is a
    quarter of all, so that all rounds together shuffle a few times the input. A position that leads to
    itself is a cycle. With at most ``least`` positions left, the steps are doubled over which a
    position knows the least of its cycle.
    """
    state, cycles, rounds = permutation.select("pos", "val"), 0, 0
    while True:
        state = cut(state, "cycles")
        row = state.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("pos") == F.col("val")).alias("own")).first()
        cycles, n = cycles + row["own"], row["n"] - row["own"]
        open_ = state.where("pos <> val")
        if n <= least:
            return cycles + _cycles_by_doubling(open_, n)
        coin = lambda c: F.xxhash64(F.lit(rounds), c).bitwiseAND(F.lit(1)) == 1  # noqa: E731, B023
        chosen = open_.where(coin("pos")).select("pos", "val")
        rest = open_.where(~coin("pos"))
        jumps = rest.where(coin("val")).select(F.col("pos").alias("before"), F.col("val").alias("pos"))
        moved = chosen.join(jumps, "pos", "left").select(F.coalesce("before", "pos").alias("pos"), "val")
        state, rounds = rest.where(~coin("val")).select("pos", "val").unionByName(moved), rounds + 1


def _cycles_by_doubling(permutation: DataFrame, n: int) -> int:
    steps = 1
    state = permutation.select("pos", F.col("val").alias("to"), F.least("pos", "val").alias("least"))
    while steps < n:
        ahead = state.select(F.col("pos").alias("to"), F.col("to").alias("further"), F.col("least").alias("m"))
        state = cut(state.join(ahead, "to").select("pos", F.col("further").alias("to"), F.least("least", "m").alias("least")), "cycles")
        steps *= 2
    return state.select("least").distinct().count()


def log2_up(x: Column) -> Column:
    """The least k with 2^k >= x."""
    return F.when(x <= 1, 0).otherwise(F.length(F.bin(x - 1))).cast("int")


def hash64(seed: int, *cols: Column | str) -> Column:
    """A 64-bit hash of a seed and columns; its values are this engine's own."""
    return F.xxhash64(F.lit(seed), *cols)


def bucket_of(x: Column, pivots: list[float]) -> Column:
    """The number of sorted pivots that are not greater than ``x``."""
    return F.aggregate(F.array(*map(F.lit, sorted(pivots))), F.lit(0), lambda acc, p: acc + F.when(p <= x, 1).otherwise(0)) if pivots else F.lit(0)
