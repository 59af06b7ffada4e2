"""By-key and by-index aggregation, and keyed collections."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def reduce_by_key(pairs: DataFrame, *folds: Column) -> DataFrame:
    """(k, folds): one row for each key."""
    return pairs.groupBy("k").agg(*folds)


def histogram_by_key(keys: DataFrame) -> DataFrame:
    return keys.groupBy("k").agg(F.count(F.lit(1)).alias("n"))


def group_by_key(pairs: DataFrame, order: str | None = "pos") -> DataFrame:
    """(k, vals): the values of each key, in input order if pairs have ``order``, else sorted.

    A group is one row: keys that may hold a large share of all rows want a fold instead.
    """
    if order is None:
        return pairs.groupBy("k").agg(F.array_sort(F.collect_list("v")).alias("vals"))
    sorted_ = F.array_sort(F.collect_list(F.struct(order, "v")))
    return pairs.groupBy("k").agg(F.transform(sorted_, lambda x: x["v"]).alias("vals"))


def fold_by_key(pairs: DataFrame, zero: Column, merge: Callable[[Column, Column], Column], order: str = "pos") -> DataFrame:
    """(k, val): a user-defined fold of each key's values in input order."""
    return group_by_key(pairs, order).select("k", F.aggregate("vals", zero, merge).alias("val"))


def by_index(spark: SparkSession, n: int, pairs: DataFrame, fold: Column, identity: Column) -> DataFrame:
    """(k, val) for every k < n: the fold of the index's values, the identity where there is none.

    An index outside 0..n-1 is an error.
    """
    wrong = pairs.where((F.col("k") < 0) | (F.col("k") >= n) | F.col("k").isNull())
    if not wrong.isEmpty():
        raise ValueError(f"index outside 0..{n - 1}")
    return spark.range(n).select(F.col("id").alias("k")).join(pairs.groupBy("k").agg(fold.alias("_v")), "k", "left").select("k", F.coalesce("_v", identity).alias("val"))


def unique(seq: DataFrame) -> DataFrame:
    """Drops elements that equal the one before, and only those."""
    from .ordered import neighbours, renumber

    own = neighbours(seq.select("pos", "val"), "val")
    return renumber(own.where((F.col("pos") == 0) | ~F.col("val").eqNullSafe(F.col("prev_val"))).select("pos", "val"))


def remove_duplicates(values: DataFrame) -> DataFrame:
    return values.distinct()


class KeyedTable:
    """A keyed collection: of several writers of a key the first (by ``pos``) wins; a
    removed key can be written again."""

    def __init__(self, df: DataFrame):
        self.df = df

    @staticmethod
    def of(writes: DataFrame) -> KeyedTable:
        return KeyedTable(writes.groupBy("k").agg(F.min_by("v", "pos").alias("v")))

    def insert(self, writes: DataFrame) -> KeyedTable:
        new = KeyedTable.of(writes).df.join(self.df.select("k"), "k", "left_anti")
        return KeyedTable(self.df.unionByName(new))

    def remove(self, keys: DataFrame) -> KeyedTable:
        return KeyedTable(self.df.join(keys.select("k").distinct(), "k", "left_anti"))

    def find(self, keys: DataFrame) -> DataFrame:
        """keys with v, null where the key is not there."""
        return keys.join(self.df, "k", "left")

    def size(self) -> int:
        return self.df.count()


def scatter(updates: DataFrame, combine: str) -> DataFrame:
    """(k, v): updates of a target combined by sum, min or max."""
    return updates.groupBy("k").agg(getattr(F, combine)("v").alias("v"))


def gather(vector: DataFrame, index: DataFrame) -> DataFrame:
    """index (pos, k) with the vector's value at k."""
    return index.join(vector.select(F.col("pos").alias("k"), "val"), "k")
