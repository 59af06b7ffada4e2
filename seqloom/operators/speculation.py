"""Ordered speculation: items reserve resources by priority, winners commit, losers go on.

What comes out is what trying the items one by one in order of (priority, item) gives. `speculate`
takes as many rounds as the longest chain of items that wait for each other, `reserve` as many as
the claims have prefixes of bounded size.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import cut, shared_path
from .prefixes import PREFIX, in_order
from .structure import components


@dataclass(frozen=True)
class Speculated:
    """committed: (item, priority, round) of the winners; rounds: how many there were."""

    committed: DataFrame
    rounds: int


def speculate(claims_of: Callable[[], DataFrame], commit: Callable[[DataFrame, DataFrame], None], hold: str = "all") -> Speculated:
    """Rounds of reserving and committing.

    claims_of() gives the round's claims, as a written table: item, priority, resource, needs, takes
    (priorities may tie). An item without claims is done with; no claims end it. The first
    item (by priority, then item) among those that take a resource holds it; an item that
    holds what it needs (``all`` of it, or ``any``) wins: nobody before it takes a resource that it
    needs. commit(winners, claims) updates what claims_of looks at. Reservations are
    minima, taken before they are shuffled; a resource that many want is a plain equi-join of
    two written tables, which can be split.
    """
    claims = claims_of()
    spark, path = claims.sparkSession, shared_path(claims.sparkSession, "committed")
    kinds = dict(claims.dtypes)
    schema = f"item {kinds['item']}, priority {kinds['priority']}, round int"
    spark.createDataFrame([], schema).write.partitionBy("round").parquet(path)
    mine, rounds = F.struct("priority", "item"), 0
    while not claims.isEmpty():
        rounds += 1
        first = cut(claims.where("takes").groupBy("resource").agg(F.min(mine).alias("first")), "reserved")
        held = claims.where("needs").join(first, "resource", "left").select("item", "priority", (F.col("first").isNull() | (F.col("first") >= mine)).alias("held"))
        wins = F.bool_and("held") if hold == "all" else F.bool_or("held")
        held.groupBy("item", "priority").agg(wins.alias("wins")).where("wins").select("item", "priority").write.parquet(f"{path}/round={rounds}")
        commit(spark.read.schema(schema.rpartition(",")[0]).parquet(f"{path}/round={rounds}"), claims)
        claims = claims_of()
    return Speculated(spark.read.schema(schema).parquet(path), rounds)


def reserve(claims: DataFrame, prefix: int = PREFIX) -> Speculated:
    """The items that commit, of (item, priority, resource, needs, takes): in order, an item
    commits if nothing that it needs is taken, and takes what it takes.

    A round is a prefix of the order, of about ``prefix`` claims.
    """
    return Speculated(*in_order(claims, prefix))


def matching(edges: DataFrame) -> Speculated:
    """The greedy matching of (eid, src, dst) in order of eid: an edge needs and takes both ends."""
    ends = edges.where("src <> dst").select(F.col("eid").alias("item"), F.col("eid").alias("priority"), F.explode(F.array("src", "dst")).alias("resource"))
    return reserve(ends.withColumns({"needs": F.lit(True), "takes": F.lit(True)}))


def independent_set(vertices: DataFrame, edges: DataFrame, seed: int | None = None) -> Speculated:
    """The first maximal independent set in order of id; with ``seed``, in the order of a hash,
    for which rounds are few on any graph. A vertex needs itself, and takes its neighbours after it."""
    order = F.lit(0).cast("long") if seed is None else F.xxhash64(F.lit(seed), "item")
    own = vertices.select(F.col("id").alias("item"), F.col("id").alias("resource"), F.lit(True).alias("needs"), F.lit(False).alias("takes"))
    pairs = edges.where("src <> dst").select("src", "dst")
    near = pairs.unionByName(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    near = near.select(F.col("src").alias("item"), F.col("dst").alias("resource"), F.lit(False).alias("needs"), F.lit(True).alias("takes"))
    return reserve(own.unionByName(near).withColumn("priority", order))


def spanning_forest(vertices: DataFrame, edges: DataFrame) -> Speculated:
    """The edges (eid, src, dst) that join two components in order of eid. An edge claims the
    components of its ends, and commits if it is the first at either; components then
    merge, and edges within one leave."""
    first = edges.where("src <> dst").select(F.col("eid").alias("item"), "src", "dst")
    state = {"open": cut(first, "open"), "comps": vertices.select("id")}

    def claims_of() -> DataFrame:
        ends = state["open"].select("item", F.col("item").alias("priority"), F.explode(F.array("src", "dst")).alias("resource"))
        return ends.withColumns({"needs": F.lit(True), "takes": F.lit(True)})

    def commit(winners: DataFrame, _: DataFrame) -> None:
        links = state["open"].join(winners.select("item"), "item", "left_semi")
        merged = components(state["comps"], links)
        a, b = (merged.select(F.col("id").alias(e), F.col("comp").alias(f"c_{e}")) for e in ("src", "dst"))
        # edges go on between components instead of vertices
        state["open"] = cut(state["open"].join(a, "src").join(b, "dst").where("c_src <> c_dst").select("item", F.col("c_src").alias("src"), F.col("c_dst").alias("dst")), "open")
        state["comps"] = merged.select(F.col("comp").alias("id")).distinct()

    return speculate(claims_of, commit, hold="any")
