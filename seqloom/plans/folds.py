"""Queries of user-defined folds."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import query
from ..operators import monoids
from .tables import SEQ, seq, table

_LINES = """WITH o AS (SELECT l_suppkey AS supplier, CAST(l_quantity AS BIGINT) - 25 AS v, l_returnflag = 'R' AS back,
 row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice, l_returnflag) AS r FROM lineitem),
 s AS (SELECT supplier, r, sum(v) OVER (PARTITION BY supplier ORDER BY r) AS s FROM o),
 m AS (SELECT supplier, s - least(0, coalesce(min(s) OVER (PARTITION BY supplier ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS rise FROM s),
 i AS (SELECT supplier, back, r - row_number() OVER (PARTITION BY supplier, back ORDER BY r) AS island FROM o),
 w AS (SELECT supplier, count(*) AS k FROM i WHERE back GROUP BY supplier, island)
 SELECT supplier, CAST(t AS BIGINT) AS total, CAST(greatest(0, b) AS BIGINT) AS best, coalesce(k, 0) AS longest FROM (SELECT supplier, sum(v) AS t FROM o GROUP BY 1)
 JOIN (SELECT supplier, max(rise) AS b FROM m GROUP BY 1) USING (supplier) LEFT JOIN (SELECT supplier, max(k) AS k FROM w GROUP BY 1) USING (supplier)"""


@query("monoid_subarray_and_run", _LINES)
def _(spark, d):
    """By supplier, over its lines in order: the largest sum of consecutive quantities less 25, and the longest run of returned lines."""
    lines = table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("supplier"), (F.col("l_quantity").cast("long") - 25).alias("v"), (F.col("l_returnflag") == "R").alias("back"),
        "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_returnflag",
    )
    both = monoids.pair(monoids.maximal_subarray(), monoids.longest_run(), slice(0, 1), slice(1, 2))
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_returnflag"]
    return monoids.fold(lines, ["supplier"], both, ["v", "back"], order).select("supplier", "total", "best", "longest")


_MAPS = SEQ.rstrip() + """, l AS (SELECT "user", list({'m': 1 + val % 97, 'c': pos % 101} ORDER BY pos) AS maps FROM s WHERE val IS NOT NULL GROUP BY 1),
 f AS (SELECT "user", list_reduce(maps, lambda f, g: {'m': g.m * f.m % 1000003, 'c': (g.m * f.c + g.c) % 1000003}) AS f FROM l)
 SELECT "user", CAST(f.m AS BIGINT) AS slope, CAST(f.c AS BIGINT) AS shift FROM f"""


@query("monoid_affine_by_user", _MAPS)
def _(spark, d):
    """By user: the composition of a map x -> m * x + c for each event, in order of time (not commutative)."""
    maps = seq(spark, d).select("user", "pos", (1 + F.col("val") % 97).alias("m"), (F.col("pos") % 101).alias("c"))
    return monoids.fold(maps, ["user"], monoids.affine(1_000_003), ["m", "c"], ["pos"])


@query("monoid_two_largest", "SELECT part, max(p) AS largest, max(CASE WHEN k = 2 THEN p END) AS second FROM (SELECT l_partkey AS part, CAST(l_extendedprice AS DOUBLE) AS p, dense_rank() OVER (PARTITION BY l_partkey ORDER BY l_extendedprice DESC) AS k FROM lineitem) GROUP BY 1")
def _(spark, d):
    lines = table(spark, d, "lineitem").select(F.col("l_partkey").alias("part"), F.col("l_extendedprice").cast("double").alias("price"))
    got = monoids.fold(lines, ["part"], monoids.two_largest(), ["price"])
    return got.select("part", "largest", F.when(F.col("second") > float("-inf"), F.col("second")).alias("second"))


@query("monoid_subarray_of_all", SEQ.rstrip() + ", c AS (SELECT pos, sum(val - 5000) OVER (ORDER BY pos) AS t FROM s WHERE val IS NOT NULL), m AS (SELECT t - least(0, coalesce(min(t) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS rise FROM c) SELECT CAST(greatest(0, max(rise)) AS BIGINT) AS best FROM m")
def _(spark, d):
    """Over all events in order of time: one fold without keys."""
    centred = seq(spark, d).select("pos", (F.col("val") - 5000).alias("v"))
    return monoids.fold(centred, [], monoids.maximal_subarray(), ["v"], ["pos"]).select("best")
