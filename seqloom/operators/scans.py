"""Reductions and prefix operators.

A scan takes two passes: windows within blocks of positions, then the totals of the
blocks (a row for each) are scanned and joined back.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import _block

#: Monoids: aggregate, identity, and how two results combine.
MONOIDS: dict[str, tuple[Callable[[Column | str], Column], int | bool | None, Callable[[Column, Column], Column]]] = {
    "sum": (F.sum, 0, lambda a, b: a + b),
    "product": (F.product, 1, lambda a, b: a * b),
    "min": (F.min, None, F.least),
    "max": (F.max, None, F.greatest),
    "bit_or": (F.bit_or, 0, lambda a, b: a.bitwiseOR(b)),
    "bit_xor": (F.bit_xor, 0, lambda a, b: a.bitwiseXOR(b)),
    "bit_and": (F.bit_and, -1, lambda a, b: a.bitwiseAND(b)),
    "bool_and": (F.bool_and, True, lambda a, b: a & b),
    "bool_or": (F.bool_or, False, lambda a, b: a | b),
}


def reduce(seq: DataFrame, *monoids: str, col: str = "val") -> DataFrame:
    """One row with the fold of ``col`` by each monoid, all in one pass; of nothing, its
    identity. Products are doubles."""
    return reduce_columns(seq, {m: (m, col) for m in monoids})


def reduce_columns(seq: DataFrame, folds: dict[str, tuple[str, str]]) -> DataFrame:
    """One row with a fold for each name: (monoid, column). Folds of several columns by
    several monoids are one composed monoid, combined map-side in one pass."""
    kinds = dict(seq.dtypes)
    kind = lambda m, c: "boolean" if m.startswith("bool") else "double" if m == "product" else kinds[c]
    return seq.agg(*(F.coalesce(MONOIDS[m][0](c), F.lit(MONOIDS[m][1]).cast(kind(m, c))).alias(name) for name, (m, c) in folds.items()))


def scan(seq: DataFrame, monoid: str = "sum", inclusive: bool = False) -> DataFrame:
    """Prefix folds (pos, val); the exclusive ones begin with the identity."""
    fold, identity, combine = MONOIDS[monoid]
    own = seq.select("pos", "val", _block().alias("_b"))
    totals = own.groupBy("_b").agg(fold("val").alias("_t"))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # a row for each block
    offsets = totals.select("_b", fold("_t").over(before).alias("_o"))
    inner = Window.partitionBy("_b").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    out = own.withColumn("_v", fold("val").over(inner)).join(offsets, "_b")
    joined = F.when(F.col("_o").isNull(), F.col("_v")).when(F.col("_v").isNull(), F.col("_o")).otherwise(combine(F.col("_o"), F.col("_v")))
    return out.select("pos", F.coalesce(joined, F.lit(identity).cast(dict(seq.dtypes)["val"])).alias("val"))


def extreme_positions(seq: DataFrame, col: str = "val") -> DataFrame:
    """One row: min_pos and max_pos, the first position on ties; null for nothing."""
    return seq.agg(F.min_by("pos", F.struct(col, "pos")).alias("min_pos"), F.max_by("pos", F.struct(F.col(col), -F.col("pos"))).alias("max_pos"))


def max_subsequence_sum(seq: DataFrame) -> DataFrame:
    """One row: the largest sum of a non-empty run of consecutive elements."""
    sums = scan(seq, "sum", inclusive=True)
    lows = scan(sums, "min").select("pos", F.least(F.coalesce("val", F.lit(0)), F.lit(0)).alias("low"))
    return sums.join(lows, "pos").agg(F.max(F.col("val") - F.col("low")).alias("mcss"))
