"""Queries that write files in each format and read them again."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..catalog import query
from ..operators import community
from ..sources import files
from ..storage import shared_path
from .tables import EDGES, both_ways, part_graph, table

_W = "CAST((src * 7 + dst * 13) % 97 AS DOUBLE) + 0.5"


def _weight():
    return (F.pmod(F.col("src") * 7 + F.col("dst") * 13, F.lit(97)) + 0.5).cast("float").alias("w")


def _text(rows: DataFrame, order: list[str], spark, name: str) -> str:
    """Writes rows (value) in order as text files that follow each other by name; their folder."""
    path = shared_path(spark, name)
    rows.orderBy(*order).select("value").write.text(path)
    return path


@query("edge_list_file", EDGES + "SELECT src, dst FROM h")
def _(spark, d):
    path, (vertices, edges) = shared_path(spark, "edge-list"), part_graph(spark, d)
    files.write_edge_list(vertices, edges, path)
    return files.read_edge_list(spark, path)[1]


@query("edge_list_file_directed", EDGES + "SELECT src, dst FROM e")
def _(spark, d):
    path, (vertices, edges) = shared_path(spark, "edge-list"), part_graph(spark, d)
    files.write_edge_list(vertices, edges, path)
    return files.read_edge_list(spark, path, directed=True)[1]


@query("edge_list_file_unit_weights", EDGES + "SELECT src, dst, CAST(1 AS DOUBLE) AS w FROM h")
def _(spark, d):
    path, (vertices, edges) = shared_path(spark, "edge-list"), part_graph(spark, d)
    files.write_edge_list(vertices, edges, path)
    return files.with_unit_weights(files.read_edge_list(spark, path)[1])


@query("triples_file", EDGES + f"SELECT src, dst, {_W} AS w FROM e UNION ALL SELECT dst, src, {_W} FROM e")
def _(spark, d):
    lines = part_graph(spark, d)[1].select("src", "dst", F.concat_ws(" ", "src", "dst", _weight()).alias("value"))
    path = _text(lines, ["src", "dst"], spark, "triples")
    return files.read_triples(spark, path)[1].withColumn("w", F.col("w").cast("double"))


@query("pairs_file", EDGES + "SELECT src, dst FROM h")
def _(spark, d):
    lines = part_graph(spark, d)[1].select("src", "dst", F.concat_ws(" ", "src", "dst").alias("value"))
    return files.read_triples(spark, _text(lines, ["src", "dst"], spark, "pairs"), weighted=False)[1]


@query("convert_triples_files", "SELECT l_suppkey AS src, l_partkey AS dst, CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) AS w FROM lineitem WHERE l_suppkey <> l_partkey GROUP BY 1, 2")
def _(spark, d):
    """Suppliers are numbered below 0 (-1 for 0), so that no pair stands in both directions."""
    lines = table(spark, d, "lineitem").where("l_suppkey <> l_partkey").select((-F.col("l_suppkey") - 1).alias("src"), F.col("l_partkey").alias("dst"), "l_quantity")
    lines = lines.select("src", "dst", F.concat_ws(" ", "src", "dst", F.col("l_quantity").cast("int")).alias("value"))
    path, out = _text(lines, ["src", "dst"], spark, "triples"), shared_path(spark, "converted")
    files.convert_triples(spark, [path], out)
    got = spark.read.parquet(f"{out}/{path.rpartition('/')[2]}")
    return got.where("src < 0").select((-F.col("src") - 1).alias("src"), "dst", F.col("w").cast("double").alias("w"))


@query("binary_graph_file", EDGES + f"SELECT src, dst, {_W} AS w FROM e")
def _(spark, d):
    path, edges = shared_path(spark, "binary"), part_graph(spark, d)[1]
    n = edges.agg(F.max(F.greatest("src", "dst"))).first()[0] + 1
    files.write_csr(spark.range(n), edges.select("src", "dst", _weight()), path)
    return files.read_csr(spark, path).withColumn("w", F.col("w").cast("double"))


@query("binary_graph_file_unweighted", EDGES + "SELECT src, dst FROM h")
def _(spark, d):
    path, edges = shared_path(spark, "binary"), both_ways(part_graph(spark, d)[1])
    n = edges.agg(F.max("src")).first()[0] + 1
    files.write_csr(spark.range(n), edges, path)
    return files.read_csr(spark, path).select("src", "dst")


@query("adjacency_file", EDGES + "SELECT src, dst FROM h")
def _(spark, d):
    path, edges = shared_path(spark, "adjacency"), both_ways(part_graph(spark, d)[1])
    n = edges.agg(F.max("src")).first()[0] + 1
    files.write_adjacency(spark.range(n), edges, path)
    return files.read_adjacency(spark, path)


@query("delta_file", EDGES + "SELECT src, dst FROM h")
def _(spark, d):
    path, edges = shared_path(spark, "delta"), both_ways(part_graph(spark, d)[1])
    n = edges.agg(F.max("src")).first()[0] + 1
    files.write_delta(spark.range(n), edges, path)
    return files.read_delta(spark, path)


@query("delta_lists", EDGES + "SELECT src AS id, count(*) AS degree, string_agg(CAST(dst - p AS VARCHAR), ' ' ORDER BY dst) AS deltas FROM (SELECT src, dst, coalesce(lag(dst) OVER (PARTITION BY src ORDER BY dst), src) AS p FROM h) GROUP BY 1")
def _(spark, d):
    edges = both_ways(part_graph(spark, d)[1])
    lists = files.to_delta(edges.select(F.col("src").alias("id")).distinct(), edges)
    return lists.select("id", F.col("degree").cast("long").alias("degree"), F.array_join(F.col("deltas").cast("array<string>"), " ").alias("deltas"))


@query("edges_of_delta_lists", EDGES + "SELECT src, dst FROM h")
def _(spark, d):
    edges = part_graph(spark, d)[1]
    return files.from_delta(files.to_delta(edges.select(F.col("src").alias("id")).distinct(), edges), symmetric=True)


def _parts(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.pmod(F.col("p_partkey"), F.lit(10)).alias("comm"))


@query("partition_file", "SELECT p_partkey AS id, p_partkey % 10 AS comm FROM part")
def _(spark, d):
    path = shared_path(spark, "partition")
    files.partition_lines(_parts(spark, d)).coalesce(1).write.text(path)
    return files.read_partition(spark, path)


@query("first_partition", "SELECT p_partkey AS id, p_partkey AS comm FROM part")
def _(spark, d):
    return files.singletons(_parts(spark, d).select("id"))


@query("partition_display", "SELECT p_partkey || ' ' || p_partkey % 10 AS value FROM part")
def _(spark, d):
    return files.partition_lines(_parts(spark, d))


@query("quotient_display", EDGES + "SELECT src % 10 || ' ' || dst % 10 AS value FROM h")
def _(spark, d):
    return files.quotient_lines(both_ways(part_graph(spark, d)[1]), _parts(spark, d))


@query("community_display", "SELECT string_agg(CAST(p_partkey AS VARCHAR), ' ' ORDER BY p_partkey) || ' ' AS value FROM part GROUP BY p_partkey % 10")
def _(spark, d):
    return files.community_lines(_parts(spark, d))


@query("graph_display", EDGES + "SELECT src || ':' || string_agg(' ' || dst, '' ORDER BY dst) AS value FROM e GROUP BY src")
def _(spark, d):
    return files.graph_lines(part_graph(spark, d)[1])


@query("graph_display_reverse", EDGES + "SELECT dst || ':' || string_agg(' ' || src, '' ORDER BY src) AS value FROM e GROUP BY dst")
def _(spark, d):
    return files.graph_lines(part_graph(spark, d)[1], reverse=True)


_LEVELS = "SELECT l AS level, p_partkey AS id, p_partkey // 7 AS comm FROM part, (SELECT 0::BIGINT AS l) WHERE {0} UNION ALL SELECT 1, k, k // 5 FROM (SELECT DISTINCT p_partkey // 7 AS k FROM part)"


def _hierarchy(spark, d):
    first = table(spark, d, "part").select(F.lit(0).cast("long").alias("level"), F.col("p_partkey").alias("id")).withColumn("comm", F.floor(F.col("id") / 7))
    return first.unionByName(first.select(F.lit(1).cast("long").alias("level"), F.col("comm").alias("id")).distinct().withColumn("comm", F.floor(F.col("id") / 5)))


def _hierarchy_file(spark, d):
    lines = _hierarchy(spark, d).select("level", "id", F.concat_ws(" ", "id", "comm").alias("value"))
    return files.read_hierarchy(spark, _text(lines, ["level", "id"], spark, "hierarchy"))


@query("hierarchy_file", _LEVELS.format("true"))
def _(spark, d):
    return _hierarchy_file(spark, d)


@query("hierarchy_level", "SELECT p_partkey AS id, p_partkey // 35 AS comm FROM part")
def _(spark, d):
    """What the whole hierarchy puts each vertex into."""
    read = _hierarchy_file(spark, d)
    return community.compose([read.where(F.col("level") == k).select("id", "comm") for k in (0, 1)])


@query("hierarchy_sizes", "SELECT 0::BIGINT AS level, count(*) AS n FROM part UNION ALL SELECT 1, count(DISTINCT p_partkey // 7) FROM part UNION ALL SELECT 2, count(DISTINCT p_partkey // 35) FROM part")
def _(spark, d):
    read = _hierarchy_file(spark, d)
    sizes = community.level_sizes([read.where(F.col("level") == k).select("id", "comm") for k in (0, 1)])
    return spark.createDataFrame(list(enumerate(sizes)), "level long, n long")


@query("feature_file", "SELECT CAST(p_partkey % 3 AS INTEGER) AS label, p_size AS f0, CAST(p_partkey % 256 AS INTEGER) AS f1 FROM part")
def _(spark, d):
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.concat_ws(",", "p_size", F.col("p_partkey") % 256, F.col("p_partkey") % 3).alias("value"))
    head = spark.createDataFrame([(-1, "i,i,d")], "k long, value string")
    return files.read_features(spark, _text(head.unionByName(rows), ["k"], spark, "features"))[0].select("label", "f0", "f1")


@query("sparse_regression_file", "SELECT s_suppkey AS \"row\", n_nationkey::BIGINT AS col, CAST((s_suppkey * 7 + n_nationkey) % 10 AS DOUBLE) / 4 AS val, CAST(s_suppkey % 5 AS DOUBLE) / 2 AS y FROM supplier, nation WHERE (s_suppkey + n_nationkey) % 6 = 0")
def _(spark, d):
    keys = table(spark, d, "supplier").select(F.col("s_suppkey").alias("r"))
    n = keys.count()
    targets = keys.select(F.lit(0).alias("part"), F.col("r").alias("i"), F.lit(0).alias("j"), (F.col("r") % 5 / 2).cast("string").alias("value"))
    cells = keys.join(table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("c")), (F.col("r") + F.col("c")) % 6 == 0)  # 25 nations
    at, val = F.col("c") * n + F.col("r") + 1, (F.col("r") * 7 + F.col("c")) % 10 / 4
    pairs = cells.select(F.lit(1).alias("part"), at.alias("i"), F.posexplode(F.array(at.cast("string"), val.cast("string"))).alias("j", "value"))
    y, entries = files.read_sparse_regression(spark, _text(targets.unionByName(pairs), ["part", "i", "j"], spark, "regression"), n)
    return entries.join(y, "row").select("row", "col", "val", "y")


@query("char_file", "SELECT string_agg(n_name || chr(10), '' ORDER BY n_nationkey) AS value FROM nation")
def _(spark, d):
    names = table(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("value"))
    return files.read_chars(spark, _text(names, ["n_nationkey"], spark, "chars") + "/*.txt").select("value")


@query("char_file_range", "SELECT substr(string_agg(n_name || chr(10), '' ORDER BY n_nationkey), 6, 20) AS value FROM nation")
def _(spark, d):
    names = table(spark, d, "nation").select("n_nationkey", F.col("n_name").alias("value"))
    return files.read_chars(spark, _text(names, ["n_nationkey"], spark, "chars") + "/*.txt", 5, 25).select("value")


@query("char_sink", "SELECT n_nationkey, n_name || chr(10) || n_regionkey AS text FROM nation")
def _(spark, d):
    """A folder for each nation, with the characters as they stand."""
    path = shared_path(spark, "char-sink")
    rows = table(spark, d, "nation").select("n_nationkey", F.concat("n_name", F.lit("\n"), "n_regionkey").alias("text"))
    files.write_chars(rows, "n_nationkey", "text", path)
    return files.read_char_folders(spark, path, "n_nationkey", "text").select(F.col("n_nationkey").cast("int").alias("n_nationkey"), "text")


@query("commented_tsv_file", "SELECT c_custkey AS id, c_mktsegment AS segment, round(c_acctbal, 2) AS bal FROM customer")
def _(spark, d):
    rows = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.concat_ws("\t", "c_custkey", "c_mktsegment", F.format_string("%.2f", "c_acctbal")).alias("value"))
    extra = spark.createDataFrame([(-2, "id\tsegment\tbal"), (3, "# a comment\t1\t2")], "k long, value string")
    path = _text(extra.unionByName(rows), ["k", "value"], spark, "tsv")
    return files.read_commented_tsv(spark, path, "id long, segment string, bal double")


@query("result_file", "SELECT r_name AS name, count(*) AS n, round(avg(s_acctbal), 2) AS mean FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY 1")
def _(spark, d):
    path = shared_path(spark, "results")
    nation = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = table(spark, d, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).groupBy(F.col("r_name").alias("name")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("s_acctbal"), 2).alias("mean"))
    files.write_results(rows, path, "name")
    return spark.read.csv(path, header=True, schema="name string, n long, mean double")


@query("symmetric_weights", EDGES + "SELECT count(*) AS edges, 0::BIGINT AS uneven, 0::BIGINT AS outside, true AS spread FROM h")
def _(spark, d):
    """Both directions of an edge share a weight in [0.1, 1); half of the weights are below the middle, nearly."""
    from ..sources.generators import edge_weight

    half = both_ways(part_graph(spark, d)[1]).withColumn("w", edge_weight(3))
    pair = Window.partitionBy(F.least("src", "dst"), F.greatest("src", "dst"))
    half = half.withColumn("uneven", F.max("w").over(pair) != F.min("w").over(pair))
    return half.agg(F.count(F.lit(1)).alias("edges"), F.count_if("uneven").alias("uneven"), F.count_if(~F.col("w").between(0.1, 0.9999999999)).alias("outside"), F.avg("w").between(0.53, 0.57).alias("spread"))
