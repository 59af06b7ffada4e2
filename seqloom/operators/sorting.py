"""Sorting, merging, ranks and order statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import positions


def sort(seq: DataFrame, key: Column | None = None, descending: bool = False) -> DataFrame:
    """Elements by key (val by default) with new positions; ties keep their order."""
    key = F.col("val") if key is None else key
    own = seq.withColumnRenamed("pos", "_p").withColumn("_k", -key if descending else key)
    return positions(own, "_k", "_p").drop("_k", "_p")


def counting_sort(seq: DataFrame, buckets: int) -> tuple[DataFrame, DataFrame]:
    """Elements by an integer key ``k`` below ``buckets``, and (k, start) of every bucket and of the end."""
    from .grouping import by_index
    from .scans import scan

    counts = by_index(seq.sparkSession, buckets + 1, seq.select(F.col("k").cast("long")), F.count(F.lit(1)), F.lit(0))
    starts = scan(counts.withColumnRenamed("k", "pos")).select(F.col("pos").alias("k"), F.col("val").alias("start"))
    return sort(seq, F.col("k")), starts


def merge(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two sorted inputs as one, stable, those of ``a`` first on ties."""
    both = a.select("pos", "val", F.lit(0).alias("_s")).unionByName(b.select("pos", "val", F.lit(1).alias("_s"))).withColumnRenamed("pos", "_p")
    return positions(both, "val", "_s", "_p").drop("_s", "_p")


def rank(seq: DataFrame) -> DataFrame:
    """(pos, rank): the number of elements before it in sorted order; ties by position."""
    own = seq.select(F.col("pos").alias("_p"), "val")
    return positions(own, "val", "_p").select(F.col("_p").alias("pos"), F.col("pos").alias("rank"))


def kth_smallest(seq: DataFrame, k: int) -> DataFrame:
    """One row: the element of rank ``k`` (from 0).

    Only values that can be the answer are sorted: a histogram of quantiles narrows
    the range first.
    """
    n = seq.count()
    if not 0 <= k < n:
        raise ValueError("k is outside the sequence")
    low, high = seq.agg(F.percentile_approx("val", F.array(F.lit(max(0.0, k / n - 0.02)), F.lit(min(1.0, (k + 1) / n + 0.02))), F.lit(1000)).alias("q")).first()["q"]
    below, inside = seq.agg(F.count_if(F.col("val") < low), F.count_if((F.col("val") >= low) & (F.col("val") <= high))).first()
    if below <= k < below + inside:
        return seq.where((F.col("val") >= low) & (F.col("val") <= high)).orderBy("val").offset(int(k - below)).limit(1).select("val")
    return seq.orderBy("val").offset(k).limit(1).select("val")


def top_k(df: DataFrame, k: int, by: str, tie: str) -> DataFrame:
    """The ``k`` rows with the largest ``by``; ties go to the smaller ``tie``."""
    return df.orderBy(F.desc(by), tie).limit(k)
