"""Numbering rows in an order, without a window over all of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: A row's place within its partition: the low bits of ``monotonically_increasing_id``.
_PLACE = (1 << 33) - 1


def numbered(df: DataFrame, by: list[str], order: list[Column], name: str, weight: str | None = None) -> DataFrame:
    """``df`` with ``name``: its rows of equal ``by`` numbered from 0 by ``order``; with
    ``weight``, the sum of that column over the rows before.

    One exchange: rows are range-partitioned by (by, order), and a row's number is its
    place in its partition, less that of its group's first row there, plus the
    rows that its group has in the partitions before. A group of any size is cut at
    partition bounds, and what passes between partitions is a row for each group and
    partition. The rows are written once.
    """
    keys = [F.col(c) for c in by] + order
    placed = cut(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_m", F.monotonically_increasing_id()), name)
    placed = placed.withColumns({"_part": F.shiftright("_m", 33), "_m": F.col("_m").bitwiseAND(F.lit(_PLACE))})
    before = Window.partitionBy(*by, F.lit(0)).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    size = F.sum(weight) if weight else F.count(F.lit(1))
    counts = placed.groupBy("_part", *by).agg(size.alias("_n"), F.min("_m").alias("_least"))
    counts = counts.withColumn("_from", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    counts = counts.select(F.col("_part").alias("_p"), *(F.col(c).alias(f"_by_{c}") for c in by), "_least", "_from")
    same = F.col("_part") == F.col("_p")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    if weight:
        own = Window.partitionBy("_part", *by).orderBy("_m").rowsBetween(Window.unboundedPreceding, -1)
        placed = placed.withColumn("_own", F.coalesce(F.sum(weight).over(own), F.lit(0)))
    place = F.col("_own") if weight else F.col("_m") - F.col("_least")
    return placed.join(counts, same).select(*df.columns, (F.col("_from") + place).cast("long").alias(name))
