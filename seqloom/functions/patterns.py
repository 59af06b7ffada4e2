"""Many patterns looked up at once in the suffixes of whole texts.

The index is a row for each suffix, with the first HEAD characters, in order: range
partitions of about ROWS suffixes, and the first head of each. Patterns binary-search
these bounds for the partitions that may hold them, and there the rows: what begins with
a pattern is an interval of the order, as under a node of a suffix tree.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import cut

#: Characters of a suffix that are in the order, suffixes of a partition, and patterns that are looked up in one at once.
HEAD, ROWS, ASKED = 32, 65_536, 65_536
#: Longer than any head in UTF-8: what is put after a pattern to come after all that begin with it.
_AFTER = b"\xff"


@dataclass(frozen=True)
class SuffixIndex:
    """suffixes: (part, head, doc, at), each part sorted by head. bounds: the parts' first heads, in order,
    with the number of suffixes before. texts: (doc, text)."""

    suffixes: DataFrame
    bounds: list[tuple[bytes, int, int]]
    texts: DataFrame


def build(texts: DataFrame, doc: str, text: str, head: int = HEAD, rows: int = ROWS) -> SuffixIndex:
    """The index of all suffixes of all whole texts; null texts have none, ids are unique.

    ``bounds`` is a row for each ``rows`` suffixes, all that the driver sees.
    """
    own = cut(texts.select(F.col(doc).alias("doc"), F.col(text).alias("text")).where(F.col("text").isNotNull() & (F.col("text") != "")), "texts")
    total = own.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    each = own.select("doc", "text", F.explode(F.sequence(F.lit(1), F.length("text"))).alias("at"))
    heads = each.select("doc", (F.col("at") - 1).cast("long").alias("at"), F.encode(F.col("text").substr(F.col("at"), F.lit(head)), "UTF-8").alias("head"))
    parts = max(1, -(-total // rows))
    order = ["head", "doc", "at"]
    ranged = heads.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id())
    ranged = cut(ranged.select(F.shiftright("place", 33).cast("int").alias("part"), F.col("place").bitwiseAND(F.lit((1 << 33) - 1)).alias("place"), *order), "suffixes")
    bounds, before = [], 0
    for r in ranged.groupBy("part").agg(F.min("head").alias("first"), F.count(F.lit(1)).alias("n")).orderBy("part").collect():
        bounds.append((bytes(r["first"]), r["part"], before))
        before += r["n"]
    return SuffixIndex(ranged, bounds, own)


def _parts_of(index: SuffixIndex, patterns: DataFrame, head: int) -> DataFrame:
    """(pattern, key, part): the parts that may hold suffixes beginning with each different pattern's first characters."""
    firsts, parts = [b[0] for b in index.bounds], [b[1] for b in index.bounds]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for pattern in batch.column(0).to_pylist():
                key = pattern[:head].encode()
                a, b = max(0, bisect_left(firsts, key) - 1), bisect_right(firsts, key + _AFTER)
                rows += [(pattern, key, p) for p in parts[a:b]]
            columns = list(zip(*rows)) if rows else [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.binary()), pa.array(columns[2], pa.int32())], names=["pattern", "key", "part"])

    different = patterns.select(F.col("pattern").cast("string").alias("pattern")).where("pattern is not null and pattern <> ''").distinct()
    return different.mapInArrow(run, "pattern string, key binary, part int")


def _search(index: SuffixIndex, patterns: DataFrame, head: int, out: Callable[[pd.DataFrame, pd.DataFrame, list[tuple[int, int]]], pd.DataFrame], schema: str) -> DataFrame:
    """What ``out`` makes of each part's suffixes, its patterns, and their intervals in it."""
    asked = cut(_parts_of(index, patterns, head), "asked")
    # a part that many patterns ask is read with so many of them at a time
    shares = asked.groupBy("part").agg(F.ceil(F.count(F.lit(1)) / ASKED).cast("int").alias("shares"))

    def run(suffixes: pd.DataFrame, asked_: pd.DataFrame) -> pd.DataFrame:
        suffixes = suffixes.sort_values("place", ignore_index=True)
        heads = [bytes(h) for h in suffixes["head"]]
        spans = [(bisect_left(heads, k), bisect_left(heads, k + _AFTER)) for k in map(bytes, asked_["key"])]
        return out(suffixes, asked_, spans)

    wanted = index.suffixes.join(shares, "part")  # parts that no pattern asks are not read on
    wanted = wanted.withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))).drop("shares")
    dealt = asked.join(shares, "part").withColumn("share", F.pmod(F.xxhash64("pattern"), F.col("shares")).cast("int")).drop("shares")
    return wanted.groupBy("part", "share").cogroup(dealt.groupBy("part", "share")).applyInPandas(run, schema)


def find(index: SuffixIndex, patterns: DataFrame, head: int = HEAD) -> DataFrame:
    """(pattern, doc, at): every place (from 0) where a text has a pattern (of ``patterns``, repeats
    and nulls aside; the empty one is nowhere). Patterns longer than a head are compared with
    the texts at the places of their heads."""
    kind = dict(index.suffixes.dtypes)["doc"]

    def out(suffixes: pd.DataFrame, asked: pd.DataFrame, spans: list[tuple[int, int]]) -> pd.DataFrame:
        first, end = np.array(spans, dtype=np.int64).reshape(-1, 2).T
        times = end - first
        rows = np.repeat(first - (np.cumsum(times) - times), times) + np.arange(times.sum())
        places = suffixes[["doc", "at"]].iloc[rows].reset_index(drop=True)
        return places.assign(pattern=asked["pattern"].to_numpy()[np.repeat(np.arange(len(times)), times)])[["pattern", "doc", "at"]]

    got = cut(_search(index, patterns, head, out, f"pattern string, doc {kind}, at long"), "places")
    short = got.where(F.length("pattern") <= head)
    long_ = got.where(F.length("pattern") > head).join(index.texts, "doc")
    whole = long_.where(F.col("text").substr(F.col("at").cast("int") + 1, F.length("pattern")) == F.col("pattern"))
    return short.unionByName(whole.select("pattern", "doc", "at"))


def intervals(index: SuffixIndex, patterns: DataFrame, head: int = HEAD) -> DataFrame:
    """(pattern, first, n): the ranks of the suffixes that begin with each pattern of at most a
    head: n from ``first`` on. Places are not listed, however many there are; patterns that
    are nowhere are left out, and longer ones raise ValueError."""
    if not patterns.where(F.length("pattern") > head).isEmpty():
        raise ValueError(f"intervals are of patterns of at most {head} characters")
    before = {b[1]: b[2] for b in index.bounds}

    def out(suffixes: pd.DataFrame, asked: pd.DataFrame, spans: list[tuple[int, int]]) -> pd.DataFrame:
        start = before[int(asked["part"].iloc[0])] if len(asked) else 0
        rows = [(p, start + a, b - a) for (a, b), p in zip(spans, asked["pattern"]) if a < b]
        return pd.DataFrame(rows, columns=["pattern", "first", "n"]).astype({"first": "int64", "n": "int64"})

    got = _search(index, patterns, head, out, "pattern string, first long, n long")
    return got.groupBy("pattern").agg(F.min("first").alias("first"), F.sum("n").alias("n"))


def words_of(text: Column, least: int, most: int) -> Column:
    """The parts between spaces of ``least`` to ``most`` characters."""
    return F.filter(F.split(text, " "), lambda w: F.length(w).between(least, most))
