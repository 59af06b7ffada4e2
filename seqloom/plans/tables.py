"""Collections and graphs that the queries make of the tables, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.ordered import positions
from ..storage import cut


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def seq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events in order of time: (pos, val: cents, kind, user)."""
    events = table(spark, sf_dir, "events").select("ts", "event_id", F.round(F.col("value") * 100).cast("long").alias("val"), F.col("event_type").alias("kind"), F.col("user_id").alias("user"))
    return cut(positions(events, "ts", "event_id").select("pos", "val", "kind", "user"), "seq")


SEQ = """WITH s AS (SELECT row_number() OVER (ORDER BY ts, event_id) - 1 AS pos, CAST(round(value * 100) AS BIGINT) AS val,
 event_type AS kind, user_id AS "user" FROM events) """


def other(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by date: (pos, val: whole price)."""
    orders = table(spark, sf_dir, "orders").select("o_orderdate", "o_orderkey", F.floor("o_totalprice").alias("val"))
    return cut(positions(orders, "o_orderdate", "o_orderkey").select("pos", "val"), "other")


OTHER = "t AS (SELECT row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS pos, CAST(floor(o_totalprice) AS BIGINT) AS val FROM orders) "
BOTH = SEQ.rstrip() + ", " + OTHER


def part_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All parts (id), and undirected edges (src < dst) between parts that follow each other in an order."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    nxt = F.lead("l_partkey").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity"))  # an order has few lines
    pairs = lines.select(F.col("l_partkey").alias("a"), nxt.alias("b")).where("b is not null and a <> b")
    edges = cut(pairs.select(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).distinct(), "edges")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id")), edges


EDGES = """WITH RECURSIVE e AS (SELECT DISTINCT least(a, b) AS src, greatest(a, b) AS dst FROM (SELECT l_partkey AS a,
 lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS b FROM lineitem) WHERE b IS NOT NULL AND a <> b),
 h AS (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e) """


def link_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All parts (id), and edges (eid, src, dst, w) from each part to the neighbour in the
    part graph with the highest price (ties to the smaller id), without duplicates."""
    vertices, edges = part_graph(spark, sf_dir)
    price = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("dst"), F.col("p_retailprice").alias("price"))
    both = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    best = both.join(price, "dst").groupBy("src").agg(F.max_by("dst", F.struct("price", -F.col("dst"))).alias("dst"))
    own = best.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
    numbered = positions(own, "src", "dst").withColumn("w", F.pmod(F.col("src") * 31 + F.col("dst") * 17, F.lit(97)))
    return vertices, cut(numbered.select(F.col("pos").alias("eid"), "src", "dst", "w"), "links")


LINKS = EDGES.rstrip() + """, b AS (SELECT h.src, h.dst, row_number() OVER (PARTITION BY h.src ORDER BY p_retailprice DESC, h.dst) AS r FROM h JOIN part ON p_partkey = h.dst),
 d AS (SELECT DISTINCT least(src, dst) AS src, greatest(src, dst) AS dst FROM b WHERE r = 1),
 k AS (SELECT row_number() OVER (ORDER BY src, dst) - 1 AS eid, src, dst, (src * 31 + dst * 17) % 97 AS w FROM d),
 kk AS (SELECT eid, src, dst, w FROM k UNION ALL SELECT eid, dst, src, w FROM k) """


def whole_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All parts (id), and all edges of the part graph as (eid, src, dst, w), numbered by (src, dst)."""
    vertices, edges = part_graph(spark, sf_dir)
    numbered = positions(edges, "src", "dst").withColumn("w", F.pmod(F.col("src") * 31 + F.col("dst") * 17, F.lit(97)))
    return vertices, cut(numbered.select(F.col("pos").alias("eid"), "src", "dst", "w"), "whole")


def both_ways(edges: DataFrame) -> DataFrame:
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    return edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *rest))
