"""What only larger inputs show: overflow."""

import duckdb
from pyspark.sql import functions as F

from seqloom import catalog


def test_scan_product_is_finite_past_the_largest_power(spark, tmp_path):
    n = 700_000  # 2 to the power of n / 500 is no double
    rows = spark.range(n).select(F.col("id").alias("event_id"), F.timestamp_seconds("id").alias("ts"), F.lit(1.0).alias("value"), F.lit("view").alias("event_type"), F.lit(1).alias("user_id"))
    rows.coalesce(4).write.parquet(str(tmp_path / "events.parquet"))
    got = catalog.queries()["scan_product"](spark, str(tmp_path)).agg(F.max("val"), F.min("val"), F.sum(F.log2("val")), F.count("val")).first()
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = con.execute(f"SELECT max(val), min(val), sum(log2(val)), count(*) FROM ({catalog.oracle_sql()['scan_product']})").fetchone()
    assert tuple(got) == want and want[0] == 2.0**200 and want[1] == 1.0 and want[3] == n


def test_scan_product_sql_is_finite():
    con = duckdb.connect()
    con.execute("CREATE TABLE events AS SELECT to_timestamp(i) AS ts, i AS event_id, 1.0 AS value, 'view' AS event_type, 1 AS user_id FROM range(600000) r(i)")
    assert con.execute(f"SELECT bool_and(isfinite(val)) FROM ({catalog.oracle_sql()['scan_product']})").fetchone()[0]
