"""Comparison pipelines: runs of one kind joined with runs of another, and ratios."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalog import query
from .tables import table


def compare_runs(baseline: DataFrame, others: dict[str, DataFrame], key: str, value: str) -> DataFrame:
    """Runs (key, value) of each of ``others`` with those of the baseline on the same key:
    kind, value, value_base, speedup (base / own), size (the number after ``_n`` in the
    key, else the key) and a short key."""
    tagged = [df.select(key, value, F.lit(kind).alias("kind")) for kind, df in others.items()]
    all_ = reduce(lambda a, b: a.unionByName(b), tagged)
    both = all_.join(baseline.select(key, F.col(value).alias(f"{value}_base")), key)
    size = F.coalesce(F.nullif(F.regexp_extract(key, r"_n(\d+)_", 1), F.lit("")), F.col(key))
    return both.withColumn("speedup", F.col(f"{value}_base") / F.col(value)).withColumn("size", size).withColumn("short", F.regexp_replace(key, r"_(input|weights)?_?file$", ""))


_KEY = "'sbm_n' || CAST(o_custkey % 50 AS VARCHAR) || '_k' || CAST(o_custkey % 7 AS VARCHAR) || '_input_file'"


def _runs(spark, d, status: str) -> DataFrame:
    key = F.concat(F.lit("sbm_n"), (F.col("o_custkey") % 50).cast("string"), F.lit("_k"), (F.col("o_custkey") % 7).cast("string"), F.lit("_input_file"))
    return table(spark, d, "orders").where(F.col("o_orderstatus") == status).groupBy(key.alias("graph")).agg(F.sum(F.floor("o_totalprice")).alias("seconds"))


def _sql(kind: str) -> str:
    return f"SELECT {_KEY} AS graph, CAST(sum(CAST(floor(o_totalprice) AS BIGINT)) AS BIGINT) AS seconds FROM orders WHERE o_orderstatus = '{kind}' GROUP BY 1"


@query("run_comparison", f"""WITH f AS ({_sql('F')}), o AS ({_sql('O')}), p AS ({_sql('P')}), a AS (SELECT *, 'O' AS kind FROM o UNION ALL SELECT *, 'P' FROM p)
 SELECT a.graph, a.seconds, kind, f.seconds AS seconds_base, round(f.seconds / CAST(a.seconds AS DOUBLE), 6) AS speedup, coalesce(nullif(regexp_extract(a.graph, '_n([0-9]+)_', 1), ''), a.graph) AS size, regexp_replace(a.graph, '_(input|weights)?_?file$', '') AS short FROM a JOIN f USING (graph)""")
def _(spark, d):
    out = compare_runs(_runs(spark, d, "F"), {"O": _runs(spark, d, "O"), "P": _runs(spark, d, "P")}, "graph", "seconds")
    return out.withColumn("speedup", F.round("speedup", 6))


@query("run_comparison_by_size", f"""WITH f AS ({_sql('F')}), o AS ({_sql('O')}) SELECT regexp_extract(graph, '_n([0-9]+)_', 1) AS size, count(*) AS runs, round(avg(f.seconds / CAST(o.seconds AS DOUBLE)), 6) AS speedup FROM o JOIN f USING (graph) GROUP BY 1""")
def _(spark, d):
    out = compare_runs(_runs(spark, d, "F"), {"O": _runs(spark, d, "O")}, "graph", "seconds")
    return out.groupBy("size").agg(F.count(F.lit(1)).alias("runs"), F.round(F.avg("speedup"), 6).alias("speedup"))


@query("hierarchy_join", "SELECT r_name, n_name, count(c_custkey) AS customers, CAST(round(sum(c_acctbal), 2) AS DOUBLE) AS balance FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey GROUP BY 1, 2")
def _(spark, d):
    r, n, c = (table(spark, d, t) for t in ("region", "nation", "customer"))
    joined = r.join(n, F.col("n_regionkey") == F.col("r_regionkey")).join(c, F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("r_name", "n_name").agg(F.count("c_custkey").alias("customers"), F.round(F.sum("c_acctbal"), 2).alias("balance"))
