"""Ordered collections: DataFrames with a dense position ``pos`` from 0 and a value ``val``.

Order-sensitive operators work by blocks of consecutive positions: windows run within
a block, and what a block passes on to the next is a row of a table with one row for
each block. No window spans all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..storage import cut

#: Consecutive positions that one window covers.
BLOCK = 65_536


def positions(df: DataFrame, *order: str) -> DataFrame:
    """``df`` with ``pos``, its rows numbered by ``order`` (which must be total).

    One exchange: rows are range-partitioned and sorted, and written with their places
    in their partitions; offsets are the sums of the partitions' sizes before.
    """
    ranged = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()), "ranged")
    ranged = ranged.withColumns({"_part": F.shiftright("_at", 33), "_at": F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))})
    sizes = ranged.groupBy("_part").count().withColumn("_from", F.coalesce(F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return ranged.join(sizes.select("_part", "_from"), "_part").withColumn("pos", F.col("_from") + F.col("_at")).drop("_part", "_at", "_from")


def tabulate(spark: SparkSession, n: int, f: Column) -> DataFrame:
    """(pos, val) for pos < n; ``f`` is an expression of ``pos``."""
    return spark.range(n).select(F.col("id").alias("pos")).withColumn("val", f)


def iota(spark: SparkSession, n: int) -> DataFrame:
    return tabulate(spark, n, F.col("pos"))


def _block(pos: Column = None) -> Column:
    return F.floor((F.col("pos") if pos is None else pos) / BLOCK)


def neighbours(seq: DataFrame, *cols: str) -> DataFrame:
    """``seq`` with prev_<c> and next_<c>: the values at pos - 1 and pos + 1, null at the ends."""
    own = seq.withColumn("_b", _block())
    order = Window.partitionBy("_b").orderBy("pos")
    edges = own.where((F.col("pos") % BLOCK == 0) | (F.col("pos") % BLOCK == BLOCK - 1)).select(F.col("pos").alias("_p"), *(F.col(c).alias(f"_e_{c}") for c in cols))
    for c in cols:
        own = own.withColumns({f"prev_{c}": F.lag(c).over(order), f"next_{c}": F.lead(c).over(order)})
    before = edges.select((F.col("_p") + 1).alias("pos"), *(F.col(f"_e_{c}").alias(f"_l_{c}") for c in cols))
    after = edges.select((F.col("_p") - 1).alias("pos"), *(F.col(f"_e_{c}").alias(f"_r_{c}") for c in cols))
    out = own.join(before, "pos", "left").join(after, "pos", "left")
    for c in cols:
        out = out.withColumns({f"prev_{c}": F.when(F.col("pos") % BLOCK == 0, F.col(f"_l_{c}")).otherwise(F.col(f"prev_{c}")), f"next_{c}": F.when(F.col("pos") % BLOCK == BLOCK - 1, F.col(f"_r_{c}")).otherwise(F.col(f"next_{c}"))})
    return out.drop("_b", *(f"_l_{c}" for c in cols), *(f"_r_{c}" for c in cols))


def pack(seq: DataFrame, flags: DataFrame) -> DataFrame:
    """The elements whose flag (pos, flag) is true, renumbered in order."""
    return renumber(seq.join(flags, "pos").where("flag").drop("flag"))


def pack_index(flags: DataFrame) -> DataFrame:
    """The positions of true flags, in order."""
    return renumber(flags.where("flag").select("pos", F.col("pos").alias("val")))


def renumber(seq: DataFrame) -> DataFrame:
    """Dense positions for rows whose positions have gaps."""
    own = seq.withColumnRenamed("pos", "_old").withColumn("_b", _block(F.col("_old")))
    order = Window.partitionBy("_b").orderBy("_old")
    sizes = own.groupBy("_b").count().withColumn("_from", F.coalesce(F.sum("count").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    out = own.withColumn("_n", F.row_number().over(order)).join(sizes.select("_b", "_from"), "_b")
    return out.select((F.col("_from") + F.col("_n") - 1).alias("pos"), *(c for c in seq.columns if c != "pos"))


def filter_into(seq: DataFrame, p: Column) -> tuple[DataFrame, int]:
    """The elements that satisfy ``p``, renumbered, and how many there are."""
    kept = renumber(seq.where(p))
    return kept, kept.count()


def map_maybe(seq: DataFrame, f: Column) -> DataFrame:
    """``f`` of each element where it is not null, renumbered."""
    return renumber(seq.select("pos", f.alias("val")).where(F.col("val").isNotNull()))


def split_parts(seq: DataFrame, part: Column) -> DataFrame:
    """Elements by ``part`` (small integers), stable within each: (part, pos, val)."""
    own = seq.withColumn("part", part)
    sizes = own.groupBy("part", _block().alias("_b")).count()
    before = Window.orderBy("part", "_b").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_from", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    order = Window.partitionBy("part", "_b").orderBy("pos")
    numbered = own.withColumn("_b", _block()).withColumn("_n", F.row_number().over(order)).join(sizes, ["part", "_b"])
    return numbered.select("part", (F.col("_from") + F.col("_n") - 1).alias("pos"), "val")


def is_partitioned(seq: DataFrame, p: Column) -> DataFrame:
    """One row: whether all elements that satisfy ``p`` stand before all others."""
    last, first = F.max(F.when(p, F.col("pos"))), F.min(F.when(~p, F.col("pos")))
    return seq.agg(F.coalesce(last < first, F.lit(True)).alias("result"))


def quantifiers(seq: DataFrame, p: Column) -> DataFrame:
    """One row: count_if, all_of, any_of, none_of; of nothing 0, true, false, true."""
    n = F.count_if(p)
    return seq.agg(n.alias("count_if"), (n == F.count(F.lit(1))).alias("all_of"), (n > 0).alias("any_of"), (n == 0).alias("none_of"))


def find_if(seq: DataFrame, p: Column) -> DataFrame:
    """One row: the first position that satisfies ``p``, else the length."""
    return seq.agg(F.coalesce(F.min(F.when(p, F.col("pos"))), F.count(F.lit(1))).alias("pos"))


def find_first_of(seq: DataFrame, wanted: DataFrame) -> DataFrame:
    """One row: the first position whose value is a value of ``wanted``, else the length."""
    hit = seq.join(wanted.select("val").distinct(), "val", "left_semi").agg(F.min("pos").alias("hit"))
    return hit.crossJoin(seq.agg(F.count(F.lit(1)).alias("n"))).select(F.coalesce("hit", "n").alias("pos"))


def adjacent_find(seq: DataFrame, p: Column) -> DataFrame:
    """One row: the first position for which ``p`` of val and next_val holds, else the length."""
    own = neighbours(seq, "val")
    return own.agg(F.coalesce(F.min(F.when(p & (F.col("pos") + 1 < _length(seq)), F.col("pos"))), F.count(F.lit(1))).alias("pos"))


def _length(seq: DataFrame) -> Column:
    return F.lit(seq.count())


def mismatch(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: the first position at which both differ, else the shorter length."""
    both = a.select("pos", F.col("val").alias("x")).join(b.select("pos", F.col("val").alias("y")), "pos")
    return both.agg(F.coalesce(F.min(F.when(~F.col("x").eqNullSafe(F.col("y")), F.col("pos"))), F.count(F.lit(1))).alias("pos"))


def occurrences(seq: DataFrame, pattern: DataFrame) -> DataFrame:
    """(pos) of every occurrence of the non-empty ``pattern`` (pos, val), overlaps included.

    A position is a start if as many of its elements match as the pattern has.
    """
    m = pattern.count()
    hits = seq.join(pattern.select(F.col("pos").alias("at"), "val"), "val").groupBy((F.col("pos") - F.col("at")).alias("start")).agg(F.count(F.lit(1)).alias("n"))
    return hits.where((F.col("n") == m) & (F.col("start") >= 0)).select(F.col("start").alias("pos"))


def search(seq: DataFrame, pattern: DataFrame, last: bool = False) -> DataFrame:
    """One row: the first (or last) occurrence, else the length. An empty pattern occurs at 0; last of it, at the end."""
    n = seq.agg(F.count(F.lit(1)).alias("n"))
    if pattern.isEmpty():
        return n.select((F.col("n") if last else F.lit(0).cast("long")).alias("pos"))
    pick = F.max("pos") if last else F.min("pos")
    return occurrences(seq, pattern).agg(pick.alias("hit")).crossJoin(n).select(F.coalesce("hit", "n").alias("pos"))


def equal(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: whether both have the same elements in the same order."""
    both = a.select("pos", F.col("val").alias("x"), F.lit(1).alias("l")).join(b.select("pos", F.col("val").alias("y"), F.lit(1).alias("r")), "pos", "full")
    return both.agg(F.coalesce(F.bool_and(F.col("l").isNotNull() & F.col("r").isNotNull() & F.col("x").eqNullSafe(F.col("y"))), F.lit(True)).alias("result"))


def lexicographical_compare(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: whether ``a`` stands before ``b``: at the first difference, else by length."""
    both = a.select("pos", F.col("val").alias("x"), F.lit(1).alias("l")).join(b.select("pos", F.col("val").alias("y"), F.lit(1).alias("r")), "pos", "full")
    less = F.when(F.col("l").isNull(), True).when(F.col("r").isNull(), False).otherwise(F.col("x") < F.col("y"))
    differ = F.col("l").isNull() | F.col("r").isNull() | (F.col("x") != F.col("y"))
    return both.where(differ).agg(F.coalesce(F.min_by(less, "pos"), F.lit(False)).alias("result"))


def is_sorted_until(seq: DataFrame) -> DataFrame:
    """One row: the length of the longest sorted prefix, and whether it is everything."""
    own = neighbours(seq, "val")
    broken = F.min(F.when(F.col("prev_val") > F.col("val"), F.col("pos")))
    n = F.count(F.lit(1))
    return own.agg(F.coalesce(broken, n).alias("pos"), broken.isNull().alias("is_sorted"))


def reverse(seq: DataFrame) -> DataFrame:
    return seq.withColumn("pos", _length(seq) - 1 - F.col("pos"))


def rotate(seq: DataFrame, t: int) -> DataFrame:
    """Rotated left by ``t``."""
    n = max(seq.count(), 1)
    return seq.withColumn("pos", F.pmod(F.col("pos") - t, F.lit(n)))


def zip_with(a: DataFrame, b: DataFrame, f: Column | None = None) -> DataFrame:
    """Elements of both at each position (x and y; or ``f`` of them), as long as the shorter."""
    both = a.select("pos", F.col("val").alias("x")).join(b.select("pos", F.col("val").alias("y")), "pos")
    return both if f is None else both.select("pos", f.alias("val"))


def append(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("pos", "val").unionByName(b.select((F.col("pos") + _length(a)).alias("pos"), "val"))


def flatten(nested: DataFrame) -> DataFrame:
    """(pos, array val) to its elements, order kept."""
    sizes = nested.select("pos", F.size("val").cast("long").alias("val"))
    from .scans import scan

    starts = scan(sizes, "sum").select("pos", F.col("val").alias("_from"))
    return nested.join(starts, "pos").select("_from", F.posexplode("val").alias("i", "val")).select((F.col("_from") + F.col("i")).alias("pos"), "val")


def split_at(seq: DataFrame, flag: Column) -> DataFrame:
    """seq with ``piece``: elements are cut after flagged positions, so there are flags + 1 pieces, the last maybe empty."""
    from .scans import scan

    flags = seq.select("pos", flag.cast("long").alias("val"))
    return seq.join(scan(flags, "sum").select("pos", F.col("val").alias("piece")), "pos")


def piece_sizes(seq: DataFrame, flag: Column) -> DataFrame:
    """(piece, size) of `split_at`, the empty last piece included."""
    pieces = split_at(seq, flag).groupBy("piece").agg(F.count(F.lit(1)).alias("size"))
    last = seq.agg(F.coalesce(F.sum(flag.cast("long")), F.lit(0)).alias("piece"))
    return last.join(pieces, "piece", "left").select("piece", F.coalesce("size", F.lit(0)).alias("size")).unionByName(pieces.join(last, "piece", "left_anti"))


def random_shuffle(seq: DataFrame, seed: int = 0) -> DataFrame:
    """In the order of a hash of seed and position: the same for the same seed."""
    own = seq.withColumnRenamed("pos", "_p").withColumn("_h", F.xxhash64(F.lit(seed), F.col("_p")))
    return positions(own, "_h", "_p").drop("_h", "_p")


def lower_bound(seq: DataFrame, keys: DataFrame) -> DataFrame:
    """(key, pos): for each different key the number of elements of a sorted sequence that are less.

    Keys and elements are put in one order; a scan counts the elements.
    """
    from .scans import scan

    both = seq.select(F.col("val").alias("key"), F.lit(1).cast("long").alias("e")).unionByName(keys.select("key", F.lit(0).cast("long").alias("e")).distinct())
    at = cut(positions(both.withColumn("_t", F.monotonically_increasing_id()), "key", "e", "_t").select("pos", "key", "e"), "bounds")
    before = scan(at.select("pos", F.col("e").alias("val")))
    return at.where("e = 0").join(before, "pos").select("key", F.col("val").alias("pos"))


def map_split_at(seq: DataFrame, flag: Column, fold: Column) -> DataFrame:
    """(piece, val): a fold of each non-empty piece of `split_at`."""
    return split_at(seq, flag).groupBy("piece").agg(fold.alias("val"))


def for_each(seq: DataFrame, action) -> None:
    """Runs ``action`` on an iterator of the rows of each partition, on the executors."""
    seq.foreachPartition(action)


def keys_of(pairs: DataFrame) -> DataFrame:
    """(pos, val): the first of each pair (pos, k, v)."""
    return pairs.select("pos", F.col("k").alias("val"))


def values_of(pairs: DataFrame) -> DataFrame:
    """(pos, val): the second of each pair (pos, k, v)."""
    return pairs.select("pos", F.col("v").alias("val"))


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    """The distinct rows of both."""
    return a.unionByName(b).distinct()


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """The distinct rows of ``a`` that are not in ``b``."""
    return a.join(b, [a[c].eqNullSafe(b[c]) for c in a.columns], "left_anti").distinct()


def intersection_size(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: n, how many distinct rows are in both."""
    return a.distinct().join(b, [a[c].eqNullSafe(b[c]) for c in a.columns], "left_semi").agg(F.count(F.lit(1)).alias("n"))
