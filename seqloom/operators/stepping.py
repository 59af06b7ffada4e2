"""Shortest paths by buckets of distance (delta-stepping)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import cut, shared_path


@dataclass(frozen=True)
class Stepped:
    """paths: (id, dist, root). relaxations: edges followed; buckets and phases: how many were worked on."""

    paths: DataFrame
    relaxations: int
    buckets: int
    phases: int


def delta_stepping(edges: DataFrame, sources: DataFrame, delta: float | None = None) -> Stepped:
    """The smallest distance of every vertex reached from ``sources`` (id), and the source
    (ties to the smaller), over edges (src, dst, w) with w of 0 or more.

    Tentative distances lie in a folder partitioned by bucket (dist / delta), and a round
    reads the open bucket's only. Edges lighter than ``delta`` are followed until the open bucket
    does not change; heavy ones once, when it is settled, as they lead to later buckets.
    So heavy edges are followed from final distances alone. Without ``delta`` it is the mean
    weight. Edges with nulls are ignored; a negative weight raises ValueError.
    """
    spark = edges.sparkSession
    kind = "double" if dict(edges.dtypes)["w"] in ("double", "float") else "long"
    whole = cut(edges.where("src is not null and dst is not null and w is not null").select("src", "dst", F.col("w").cast(kind).alias("w")), "edges")
    least, mean = whole.agg(F.min("w"), F.avg("w")).first()
    if least is not None and least < 0:
        raise ValueError("delta-stepping wants weights of 0 or more")
    delta = delta or float(mean or 1) or 1.0
    parts = shared_path(spark, "weights")
    whole.withColumn("light", F.col("w") < delta).write.partitionBy("light").parquet(parts)
    by_weight = spark.read.schema(f"{_ddl(whole)}, light boolean").parquet(parts)
    light, heavy = by_weight.where("light").drop("light"), by_weight.where("not light").drop("light")

    id_kind = dict(sources.dtypes)["id"]
    path, settled_path = shared_path(spark, "tentative"), shared_path(spark, "settled")
    schema = f"id {id_kind}, dist {kind}, root {id_kind}, relaxed long, bucket long, phase long"
    bucket = F.floor(F.col("dist") / F.lit(float(delta))).cast("long")
    best = F.min(F.struct("dist", "root")).alias("b")

    def note(found: DataFrame, phase: int) -> None:
        found.withColumns({"bucket": bucket, "phase": F.lit(phase).cast("long")}).write.mode("append").partitionBy("bucket", "phase").parquet(path)

    def tentative() -> DataFrame:
        return spark.read.schema(schema).parquet(path)

    def relax(from_: DataFrame, along: DataFrame) -> DataFrame:
        moved = along.join(from_.select(F.col("id").alias("src"), "dist", "root"), "src")
        found = moved.groupBy(F.col("dst").cast(id_kind).alias("id")).agg(F.min(F.struct((F.col("dist") + F.col("w")).alias("dist"), "root")).alias("b"), F.count(F.lit(1)).alias("relaxed"))
        return found.select("id", "b.dist", "b.root", "relaxed")

    def settled() -> DataFrame:
        return spark.read.schema(f"id {id_kind}, dist {kind}, root {id_kind}").parquet(settled_path)

    note(sources.where("id is not null").select("id", F.lit(0).cast(kind).alias("dist"), F.col("id").alias("root"), F.lit(0).cast("long").alias("relaxed")).distinct(), 0)
    spark.createDataFrame([], f"id {id_kind}, dist {kind}, root {id_kind}").write.parquet(settled_path)
    now, buckets, phase = -1, 0, 0
    while True:
        now = tentative().where(F.col("bucket") > now).agg(F.min("bucket")).first()[0]
        if now is None:
            break
        inner = tentative().where(F.col("bucket") == now)
        opened = shared_path(spark, "open")
        fresh = cut(inner.groupBy("id").agg(best).select("id", "b.dist", "b.root").join(settled(), "id", "left_anti"), "fresh")
        if fresh.isEmpty():
            continue
        buckets += 1
        while True:
            fresh.write.mode("append").parquet(opened)
            phase += 1
            note(relax(fresh, light), phase)
            here = spark.read.schema(fresh.schema).parquet(opened).groupBy("id").agg(best)
            found = tentative().where((F.col("bucket") == now) & (F.col("phase") == phase)).select("id", F.struct("dist", "root").alias("n"))
            better = found.join(here, "id", "left").where(F.col("b").isNull() | (F.col("n") < F.col("b"))).select("id", "n.dist", "n.root")
            fresh = cut(better.join(settled(), "id", "left_anti"), "fresh")
            if fresh.isEmpty():
                break
        done = cut(spark.read.schema(fresh.schema).parquet(opened).groupBy("id").agg(best).select("id", "b.dist", "b.root"), "done")
        done.write.mode("append").parquet(settled_path)
        phase += 1
        note(relax(done, heavy), phase)
    relaxed = tentative().agg(F.coalesce(F.sum("relaxed"), F.lit(0))).first()[0]
    return Stepped(settled(), relaxed, buckets, phase)


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{n}` {k}" for n, k in df.dtypes)

