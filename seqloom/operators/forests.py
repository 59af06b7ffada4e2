"""Minimum spanning forests with a filter: light edges first, and heavy edges that they
make needless go before they are shuffled."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import cut, shared_path
from .frontier import blocks, tested, words
from .structure import merge_least


@dataclass
class Filtered:
    """forest: (eid, src, dst, w). passes: for each, (light edges solved, heavy edges dropped where
    they lie by the largest component's bitmap, heavy edges dropped by their labels)."""

    forest: DataFrame | None = None
    passes: list[tuple[int, int, int]] = field(default_factory=list)


def _light(df: DataFrame, w, eid) -> Column:
    """Whether an edge of ``df`` comes no later than (w, eid)."""
    kinds = dict(df.dtypes)
    return F.struct("w", "eid") <= F.struct(F.lit(w).cast(kinds["w"]).alias("w"), F.lit(eid).cast(kinds["eid"]).alias("eid"))


def filtered_forest(vertices: DataFrame, edges: DataFrame, share: float = 1.5, least: int = 100_000) -> Filtered:
    """The minimum spanning forest of (eid, src, dst, w) under (w, eid); ids are integers.

    The edges up to a pivot, the quantile that leaves about ``share`` edges a
    vertex, are solved first. An edge above it that lies within a component of their forest is never
    needed. Most of those lie in the largest component: its vertices are a bitmap, which
    edges are tested against where they lie, without an exchange where the bitmap is small
    enough to be sent; only the rest is joined with labels. With at most ``least`` edges
    left the rest is solved at once.
    """
    spark, path, out = edges.sparkSession, shared_path(edges.sparkSession, "forest"), Filtered()
    kinds = dict(edges.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in ("eid", "src", "dst", "w"))
    spark.createDataFrame([], schema).write.parquet(path)
    labels = cut(vertices.select("id", F.col("id").alias("comp")), "labels")
    n = labels.count()
    left = cut(edges.where("src <> dst").select("eid", "src", "dst", "w"), "left")
    m = left.count()
    while m:
        if m <= least or m <= share * n:
            light, heavy = left, None
        else:
            q = min(0.5, share * n / m)
            w = left.agg(F.percentile_approx("w", F.lit(q), F.lit(1000))).first()[0]
            # of edges of the pivot's weight as many as are needed, by eid
            below = left.where(F.col("w") < w).count()
            want = (q * m - below) / max(1, left.where(F.col("w") == w).count())
            e = left.where(F.col("w") == w).agg(F.percentile_approx("eid", F.lit(min(1.0, max(0.0, want))), F.lit(1000))).first()[0]
            light, heavy = left.where(_light(left, w, e)), left.where(~_light(left, w, e))
        solved = light.count() if heavy is not None else m
        a, b = (labels.select(F.col("id").alias(e), F.col("comp").alias(f"c_{e}")) for e in ("src", "dst"))
        joined = cut(light.join(a, "src").join(b, "dst").where("c_src <> c_dst"), "light")
        chosen, roots = merge_least(joined.select("eid", F.col("c_src").alias("ca"), F.col("c_dst").alias("cb"), "w"))
        joined.join(chosen.select("eid"), "eid", "left_semi").select("eid", "src", "dst", "w").write.mode("append").parquet(path)
        if heavy is None:
            out.passes.append((solved, 0, 0))
            break
        labels = cut(labels.join(roots, "comp", "left").select("id", F.coalesce("root", "comp").alias("comp")), "labels")
        giant = labels.groupBy("comp").count().orderBy(F.desc("count"), "comp").first()["comp"]
        map_ = blocks(words(labels.where(F.col("comp") == giant).select("id")))
        kept = cut(_outside(heavy, map_), "outside")
        k = kept.count()
        a, b = (labels.select(F.col("id").alias(e), F.col("comp").alias(f"c_{e}")) for e in ("src", "dst"))
        left = cut(kept.join(a, "src").join(b, "dst").where("c_src <> c_dst").select("eid", "src", "dst", "w"), "left")
        rest = left.count()
        out.passes.append((solved, m - solved - k, k - rest))
        m = rest
    out.forest = spark.read.schema(schema).parquet(path)
    return out


def _outside(edges: DataFrame, map_: DataFrame) -> DataFrame:
    """The edges of which an end is not in the set."""
    both = tested(tested(edges, "src", map_, "_s"), "dst", map_, "_d")
    return both.where(~(F.col("_s") & F.col("_d"))).drop("_s", "_d")
