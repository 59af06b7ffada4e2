"""Text files are written by many tasks, in files that follow each other by name."""

from pathlib import Path

from pyspark.sql import functions as F

from seqloom.plans.formats import _text


def test_ordered_text_is_written_by_many_tasks(spark):
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        path = _text(spark.range(2_000).select((-F.col("id")).alias("k"), F.col("id").cast("string").alias("value")), ["k"], spark, "ordered")
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    parts = [p for p in sorted(Path(path.removeprefix("file:")).glob("part-*")) if p.stat().st_size]
    assert len(parts) > 1
    assert [int(x) for p in parts for x in p.read_text().split()] == list(range(1_999, -1, -1))
