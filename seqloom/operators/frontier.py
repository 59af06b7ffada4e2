"""Traversal that switches direction: small frontiers push along their edges, large ones
are pulled by the vertices not visited yet.

Vertex sets are bitmaps in blocks of 32,768 ids: a block is one row of 512 words. Testing
an id joins on its block, so a set of n ids is n / 8 bytes wherever it is sent.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import cut, shared_path

WORDS = 512


def _bits(n: int) -> Column:
    return F.lit(n).cast("int")


def _block(id_: Column) -> Column:
    return F.shiftright(id_, 15)


def _word(id_: Column) -> Column:
    return F.shiftright(id_, 6).bitwiseAND(F.lit(WORDS - 1)).cast("int")


def words(ids: DataFrame) -> DataFrame:
    """(block, word, bits): the set of ``ids`` (id, integers) as words of 64 ids; nulls are left out."""
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("id").bitwiseAND(F.lit(63)).cast("int"))
    return ids.where("id is not null").groupBy(_block(F.col("id")).alias("block"), _word(F.col("id")).alias("word")).agg(F.bit_or(bit).alias("bits"))


def both(a: DataFrame, b: DataFrame) -> DataFrame:
    """The union of two sets of words."""
    return a.unionByName(b).groupBy("block", "word").agg(F.bit_or("bits").alias("bits"))


def size(set_: DataFrame) -> int:
    """How many ids a set of words has."""
    return set_.agg(F.coalesce(F.sum(F.bit_count("bits")), F.lit(0))).first()[0]


def blocks(set_: DataFrame) -> DataFrame:
    """(block, map): a row for each block, with all of its words."""
    by = F.map_from_entries(F.collect_list(F.struct("word", "bits")))
    filled = F.transform(F.sequence(_bits(0), _bits(WORDS - 1)), lambda w: F.coalesce(F.try_element_at("by", w), F.lit(0).cast("long")))
    return set_.groupBy("block").agg(by.alias("by")).select("block", filled.alias("map"))


def tested(df: DataFrame, column: str, maps: DataFrame, name: str) -> DataFrame:
    """``df`` with ``name``: whether ``column`` is in the set. Whether the set's blocks are
    broadcast or shuffled follows from their size at run time."""
    own = maps.select(F.col("block").alias("_block"), F.col("map").alias("_map"))
    joined = df.join(own, _block(F.col(column)) == F.col("_block"), "left")
    bit = F.call_function("getbit", F.get("_map", _word(F.col(column))), F.col(column).bitwiseAND(F.lit(63)).cast("int"))
    return joined.withColumn(name, F.coalesce(bit.cast("int"), F.lit(0)) == 1).drop("_block", "_map")


def within(df: DataFrame, column: str, maps: DataFrame, there: bool = True) -> DataFrame:
    """The rows of ``df`` whose ``column`` is in the set (or is not)."""
    found = tested(df, column, maps, "_in")
    return found.where(F.col("_in") == there).drop("_in")


def push(edges: DataFrame, frontier: DataFrame, visited: DataFrame) -> DataFrame:
    """(id, parent): what the frontier's out-edges reach and is not visited; the parent is the smallest source."""
    reached = edges.join(frontier.select(F.col("id").alias("src")), "src").groupBy(F.col("dst").alias("id")).agg(F.min("src").alias("parent"))
    return within(reached, "id", visited, there=False)


def pull(edges: DataFrame, frontier: DataFrame, visited: DataFrame) -> DataFrame:
    """The same, from the other side: edges into vertices not visited whose source is in
    the frontier (blocks). Edges are tested where they lie and not shuffled."""
    open_ = within(edges, "dst", visited, there=False)
    return within(open_, "src", frontier, there=True).groupBy(F.col("dst").alias("id")).agg(F.min("src").alias("parent"))


@dataclass
class Search:
    """found: (id, dist, parent). directions: ``push`` or ``pull`` of every round, with the frontier's edges."""

    found: DataFrame | None = None
    directions: list[tuple[str, int]] = field(default_factory=list)


def search(edges: DataFrame, sources: DataFrame, share: float = 0.05, max_depth: int | None = None) -> Search:
    """Breadth-first search from ``sources`` (id) over edges (src, dst) of integer ids; rows as of ``traversal.bfs``.

    A round pulls if the frontier has more than ``share`` of all edges, else pushes. Levels
    are appended to one folder, the visited set is words: no plan grows with the rounds.
    """
    spark = edges.sparkSession
    own = cut(edges.where("src is not null and dst is not null").select("src", "dst"), "edges")
    degrees = cut(own.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("degree")), "degrees")
    total = degrees.agg(F.coalesce(F.sum("degree"), F.lit(0))).first()[0]
    kind = dict(sources.dtypes)["id"]
    path, schema = shared_path(spark, "levels"), f"id {kind}, parent {kind}, degree long, dist int"

    def level(found: DataFrame, depth: int) -> DataFrame:
        with_degree = found.join(degrees, "id", "left").select("id", "parent", F.coalesce("degree", F.lit(0)).alias("degree"), F.lit(depth).alias("dist"))
        with_degree.write.mode("append").partitionBy("dist").parquet(path)
        return spark.read.schema(schema).parquet(path).where(F.col("dist") == depth)

    out, depth = Search(), 0
    frontier = level(sources.where("id is not null").select("id", F.col("id").alias("parent")).distinct(), 0)
    visited = cut(words(frontier), "visited")
    while max_depth is None or depth < max_depth:
        n, reach = frontier.agg(F.count(F.lit(1)), F.coalesce(F.sum("degree"), F.lit(0))).first()
        if not n:
            break
        depth += 1
        direction = "pull" if n + reach > share * total else "push"
        out.directions.append((direction, reach))
        seen = blocks(visited)
        found = pull(own, blocks(words(frontier)), seen) if direction == "pull" else push(own, frontier, seen)
        frontier = level(found.select(F.col("id").cast(kind).alias("id"), F.col("parent").cast(kind).alias("parent")), depth)
        visited = cut(both(visited, words(frontier)), "visited")
    out.found = spark.read.schema(schema).parquet(path).select("id", "dist", "parent")
    return out
