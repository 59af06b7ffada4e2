"""File formats of graphs, partitions, hierarchies and feature tables.

Paths go to Spark's readers and writers only, so any store that Spark reads will do.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.ordered import positions, renumber
from ..storage import cut


def _ordered(spark: SparkSession, path: str, value: Column) -> DataFrame:
    """(pos, value): what ``value`` makes of each line (its column ``value``), numbered in order of
    the files' names and, within a file, of the lines.

    A file is read in splits, by as many tasks. Rows are numbered where they are read, and
    written; the splits' sizes, a row for each, give the rest of the number. Rows are not shuffled.
    """
    read = spark.read.text(path).select(F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"), value.alias("value"))
    placed = cut(read.withColumn("_m", F.monotonically_increasing_id()), "lines")
    before = Window.orderBy("_file", "_start").rowsBetween(Window.unboundedPreceding, -1)
    splits = placed.groupBy("_file", "_start").agg(F.min("_m").alias("_least"), F.count(F.lit(1)).alias("_n")).withColumn("_from", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    return placed.join(splits, ["_file", "_start"]).select((F.col("_from") + F.col("_m") - F.col("_least")).alias("pos"), "value")


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(pos, value): the lines of text files that are not blank, numbered in order."""
    return _ordered(spark, path, F.col("value")).where("trim(value) <> ''")


def _numbers(spark: SparkSession, path: str) -> DataFrame:
    """(pos, val): all numbers of text files, in order."""
    return _ordered(spark, path, F.explode(F.filter(F.split("value", r"\s+"), lambda x: x != ""))).withColumnRenamed("value", "val")


def read_edge_list(spark: SparkSession, path: str, directed: bool = False) -> tuple[DataFrame, DataFrame]:
    """Vertices (id) and edges (src, dst) of a file whose first line is ``n m`` and whose
    next m lines are ``u v``. Too few pairs are an error; more are not read."""
    numbers = _numbers(spark, path).select("pos", F.col("val").cast("long").alias("val"))
    head = {r["pos"]: r["val"] for r in numbers.where("pos < 2").collect()}
    n, m = head[0], head[1]
    body = numbers.where((F.col("pos") >= 2) & (F.col("pos") < 2 + 2 * m)).withColumn("k", F.floor(F.col("pos") / 2))
    edges = body.groupBy("k").agg(F.min_by("val", "pos").alias("src"), F.max_by("val", "pos").alias("dst"), F.count(F.lit(1)).alias("c")).where("c = 2")
    if edges.count() != m:
        raise ValueError(f"{path} has fewer than {m} edges")
    edges = edges.select("src", "dst")
    if not directed:
        edges = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return spark.range(n), edges


def write_edge_list(vertices: DataFrame, edges: DataFrame, path: str) -> None:
    """``n m`` and a line for each edge, in order: files that follow each other by name."""
    n, m = vertices.count(), edges.count()
    head = vertices.sparkSession.createDataFrame([(-1, -1, f"{n} {m}")], "src long, dst long, value string")
    body = edges.select("src", "dst", F.concat_ws(" ", "src", "dst").alias("value"))
    head.unionByName(body).orderBy("src", "dst").select("value").write.text(path)


def read_triples(spark: SparkSession, path: str, weighted: bool = True) -> tuple[DataFrame, DataFrame]:
    """Vertices 0..largest id and half-edges (src, dst[, w]) of lines ``u v [w]``; a
    self-loop stands once."""
    schema = "src long, dst long" + (", w float" if weighted else "")
    one = spark.read.csv(path, sep=" ", schema=schema)
    back = one.where("src <> dst").select(F.col("dst").alias("src"), F.col("src").alias("dst"), *(["w"] if weighted else []))
    n = one.agg(F.coalesce(F.max(F.greatest("src", "dst")), F.lit(-1)) + 1).first()[0]
    return spark.range(n), one.unionByName(back)


def with_unit_weights(edges: DataFrame) -> DataFrame:
    """Edges with w = 1 each."""
    return edges.withColumn("w", F.lit(1.0))


#: Numbers in a piece of a binary graph.
PIECE = 1 << 18


def _packed(rows: DataFrame, part: int, offset: int, width: int, kind: str) -> DataFrame:
    """(part, at, data): the numbers (pos, val) as bytes of ``kind`` in pieces; number ``pos`` stands at ``offset + width * pos``."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        return pd.DataFrame({"part": [part], "at": [offset + width * int(pdf["pos"].iloc[0])], "data": [pdf["val"].to_numpy().astype(kind).tobytes()]})

    return rows.groupBy(F.floor(F.col("pos") / PIECE).alias("_piece")).applyInPandas(run, "part int, at long, data binary")


def write_csr(vertices: DataFrame, edges: DataFrame, path: str) -> None:
    """A binary graph as rows (part, at, data): the bytes at ``at`` of part 0, which is u32 n, u64
    cumulative degrees, u32 links, and with weights of part 1, f32 weights in the order of the links.

    A part is one array; pieces of PIECE numbers are made by as many tasks, and follow each other by ``at``.
    """
    from ..operators.scans import scan

    n, weighted = vertices.count(), "w" in edges.columns
    spark, links = vertices.sparkSession, cut(positions(edges.select("src", "dst", *(["w"] if weighted else [])), "src", "dst"), "links")
    degree = links.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("k"))
    sizes = vertices.join(degree, "id", "left").select(F.col("id").alias("pos"), F.coalesce("k", F.lit(0)).alias("val"))
    out = spark.createDataFrame([(0, 0, bytearray(struct.pack("<I", n)))], "part int, at long, data binary")
    out = out.unionByName(_packed(scan(sizes, inclusive=True), 0, 4, 8, "<u8"))
    out = out.unionByName(_packed(links.select("pos", F.col("dst").alias("val")), 0, 4 + 8 * n, 4, "<u4"))
    if weighted:
        out = out.unionByName(_packed(links.select("pos", F.col("w").alias("val")), 1, 0, 4, "<f4"))
    out.write.parquet(path)


def parse_csr(graph: DataFrame) -> DataFrame:
    """Half-edges (src, dst[, w as null]) of rows (data, weights) in the binary format; weights may be null."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for data, weights in zip(pdf["data"], pdf["weights"], strict=True):
                n = struct.unpack_from("<I", data)[0]
                ends = np.frombuffer(data, dtype="<u8", count=n, offset=4)
                links = np.frombuffer(data, dtype="<u4", offset=4 + 8 * n)
                src = np.repeat(np.arange(n), np.diff(np.concatenate(([0], ends)).astype(np.int64)))
                w = np.frombuffer(weights, dtype="<f4") if weights is not None else np.full(len(links), np.nan, dtype="<f4")
                yield pd.DataFrame({"src": src.astype("int64"), "dst": links.astype("int64"), "w": w})

    return graph.select("data", "weights").mapInPandas(run, "src long, dst long, w float")


def read_csr(spark: SparkSession, path: str) -> DataFrame:
    """Half-edges (src, dst, w, null where there are none) of what `write_csr` wrote.

    A task takes a piece of links with its weights, and the stretches of vertices that lie in it.
    """
    rows, size = spark.read.schema("part int, at long, data binary").parquet(path), PIECE
    n = struct.unpack("<I", rows.where("part = 0 and at = 0").first()["data"])[0]

    def numbers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at, data in zip(pdf["at"], pdf["data"], strict=True):
                end = np.frombuffer(data, dtype="<u8").astype("int64")
                yield pd.DataFrame({"src": (at - 4) // 8 + np.arange(len(end)), "hi": end})

    ends = rows.where((F.col("part") == 0) & (F.col("at") > 0) & (F.col("at") < 4 + 8 * n)).select("at", "data").mapInPandas(numbers, "src long, hi long")
    spans = ends.join(ends.select((F.col("src") + 1).alias("src"), F.col("hi").alias("lo")), "src", "left").withColumn("lo", F.coalesce("lo", F.lit(0))).where("hi > lo")
    spans = spans.withColumn("piece", F.explode(F.sequence(F.floor(F.col("lo") / size), F.floor((F.col("hi") - 1) / size))))
    links = rows.where((F.col("part") == 0) & (F.col("at") >= 4 + 8 * n)).select(F.floor((F.col("at") - 4 - 8 * n) / (4 * size)).alias("piece"), "data")
    weights = rows.where("part = 1").select(F.floor(F.col("at") / (4 * size)).alias("piece"), F.col("data").alias("weights"))

    def run(spans_: pd.DataFrame, links_: pd.DataFrame) -> pd.DataFrame:
        spans_, row = spans_.sort_values("lo"), links_.iloc[0]
        first = int(row["piece"]) * size
        dst = np.frombuffer(row["data"], dtype="<u4").astype("int64")
        times = np.minimum(spans_["hi"].to_numpy() - first, len(dst)) - np.maximum(spans_["lo"].to_numpy() - first, 0)
        w = pd.array(np.frombuffer(row["weights"], dtype="<f4"), dtype="Float32") if row["weights"] is not None else pd.array([None] * len(dst), dtype="Float32")
        return pd.DataFrame({"src": np.repeat(spans_["src"].to_numpy(), times), "dst": dst, "w": w})

    return spans.groupBy("piece").cogroup(links.join(weights, "piece", "left").groupBy("piece")).applyInPandas(run, "src long, dst long, w float")


def read_csr_files(spark: SparkSession, links: str, weights: str | None = None) -> DataFrame:
    """Half-edges of a binary file of links and, maybe, one of weights."""
    rows = spark.read.format("binaryFile").load(links).select(F.col("content").alias("data"))
    if weights:
        return parse_csr(rows.crossJoin(spark.read.format("binaryFile").load(weights).select(F.col("content").alias("weights"))))  # one row each
    return parse_csr(rows.withColumn("weights", F.lit(None).cast("binary")))


def read_adjacency(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """Edges of a file of numbers: (a header word,) n, m, n offsets, m targets."""
    numbers = _numbers(spark, path)
    numbers = numbers.withColumn("pos", F.col("pos") - 1) if header else numbers
    numbers = numbers.where("pos >= 0").withColumn("val", F.when(F.col("pos") >= 0, F.col("val").cast("long")))  # the header word is no number
    head = {r["pos"]: r["val"] for r in numbers.where("pos < 2").collect()}
    n, m = head[0], head[1]
    starts = numbers.where((F.col("pos") >= 2) & (F.col("pos") < 2 + n)).select((F.col("pos") - 2).alias("src"), F.col("val").alias("lo"))
    following = starts.select((F.col("src") - 1).alias("src"), F.col("lo").alias("hi"))
    spans = starts.join(following, "src", "left").withColumn("hi", F.coalesce("hi", F.lit(m)))
    targets = numbers.where(F.col("pos") >= 2 + n).select((F.col("pos") - 2 - n).alias("at"), F.col("val").alias("dst"))
    return spans.where("hi > lo").select("src", F.explode(F.sequence("lo", F.col("hi") - 1)).alias("at")).join(targets, "at").select("src", "dst")


def write_adjacency(vertices: DataFrame, edges: DataFrame, path: str) -> None:
    """A header word, n, m, the vertices' offsets and the targets, a number a line, in files that follow each other by name."""
    from ..operators.scans import scan

    degree = edges.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("k"))
    sizes = vertices.join(degree, "id", "left").select(F.col("id").alias("pos"), F.coalesce("k", F.lit(0)).alias("val"))
    zero = F.lit(0).cast("long")
    head = vertices.sparkSession.createDataFrame([(0, 0, 0, "AdjacencyGraph"), (0, 1, 0, str(vertices.count())), (0, 2, 0, str(edges.count()))], "part int, a long, b long, value string")
    starts = scan(sizes).select(F.lit(1).alias("part"), F.col("pos").alias("a"), zero.alias("b"), F.col("val").cast("string").alias("value"))
    targets = edges.select(F.lit(2).alias("part"), F.col("src").alias("a"), F.col("dst").alias("b"), F.col("dst").cast("string").alias("value"))
    head.unionByName(starts).unionByName(targets).orderBy("part", "a", "b").select("value").write.text(path)


def graph_lines(edges: DataFrame, reverse: bool = False) -> DataFrame:
    """(value): ``src: dst dst ...`` for each vertex with edges, or with ``reverse`` those that lead to it."""
    a, b = ("dst", "src") if reverse else ("src", "dst")
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(b)), lambda x: F.concat(F.lit(" "), x.cast("string"))), "")
    return edges.groupBy(a).agg(listed.alias("list")).orderBy(a).select(F.concat(F.col(a).cast("string"), F.lit(":"), "list").alias("value"))


def to_delta(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, degree, deltas): sorted neighbours as differences, the first from the vertex itself."""
    lists = edges.groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_list("dst")).alias("d"))
    delta = F.transform(F.col("d"), lambda x, i: F.when(i == 0, x - F.col("id")).otherwise(x - F.get("d", i - 1)))
    return vertices.join(lists, "id", "left").select("id", F.coalesce(F.size("d"), F.lit(0)).alias("degree"), F.coalesce(delta, F.array().cast("array<bigint>")).alias("deltas"))


def from_delta(lists: DataFrame, symmetric: bool = False) -> DataFrame:
    """Edges of (id, degree, deltas); ``symmetric`` adds the reverse of each."""
    sums = F.aggregate("deltas", F.struct(F.col("id").alias("at"), F.array().cast("array<bigint>").alias("out")), lambda acc, x: F.struct((acc["at"] + x).alias("at"), F.concat(acc["out"], F.array(acc["at"] + x)).alias("out")))["out"]
    edges = lists.select(F.col("id").alias("src"), F.explode(sums).alias("dst"))
    return edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))) if symmetric else edges


def write_delta(vertices: DataFrame, edges: DataFrame, path: str) -> None:
    """n, m, the degrees and the deltas, a number a line, in files that follow each other by name."""
    lists = to_delta(vertices, edges)
    spark = lists.sparkSession
    head = spark.createDataFrame([(0, 0, 0, str(vertices.count())), (0, 1, 0, str(edges.count()))], "part int, a long, b long, value string")
    sizes = lists.select(F.lit(1).alias("part"), F.col("id").alias("a"), F.lit(0).cast("long").alias("b"), F.col("degree").cast("string").alias("value"))
    body = lists.select(F.lit(2).alias("part"), F.col("id").alias("a"), F.posexplode("deltas").alias("b", "v")).select("part", "a", F.col("b").cast("long").alias("b"), F.col("v").cast("string").alias("value"))
    head.unionByName(sizes).unionByName(body).orderBy("part", "a", "b").select("value").write.text(path)


def read_delta(spark: SparkSession, path: str, symmetric: bool = False) -> DataFrame:
    """Edges of what `write_delta` wrote."""
    numbers = _numbers(spark, path).withColumn("val", F.col("val").cast("long"))
    n = numbers.where("pos = 0").first()["val"]
    sizes = numbers.where((F.col("pos") >= 2) & (F.col("pos") < 2 + n)).select((F.col("pos") - 2).alias("pos"), "val")
    from ..operators.scans import scan

    starts = sizes.withColumnRenamed("val", "degree").join(scan(sizes).withColumnRenamed("val", "lo"), "pos").where("degree > 0")
    body = numbers.where(F.col("pos") >= 2 + n).select((F.col("pos") - 2 - n).alias("at"), F.col("val").alias("delta"))
    rows = starts.select(F.col("pos").alias("id"), "lo", F.explode(F.sequence("lo", F.col("lo") + F.col("degree") - 1)).alias("at")).join(body, "at")
    lists = rows.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "delta"))), lambda x: x["delta"]).alias("deltas"))
    return from_delta(lists.select("id", F.size("deltas").alias("degree"), "deltas"), symmetric)


def community_lines(comm: DataFrame) -> DataFrame:
    """(value): a line for each community (id, comm), its members in order and a space after each."""
    members = F.array_join(F.array_sort(F.collect_list("id")).cast("array<string>"), " ")
    return comm.groupBy("comm").agg(F.concat(members, F.lit(" ")).alias("value")).orderBy("comm").select("value")


def read_partition(spark: SparkSession, path: str) -> DataFrame:
    """(id, comm) of lines ``node community``."""
    return spark.read.csv(path, sep=" ", schema="id long, comm long")


def singletons(vertices: DataFrame) -> DataFrame:
    """(id, comm): every vertex in a community of its own."""
    return vertices.select("id", F.col("id").alias("comm"))


def partition_lines(comm: DataFrame) -> DataFrame:
    return comm.orderBy("id").select(F.concat_ws(" ", "id", "comm").alias("value"))


def quotient_lines(edges: DataFrame, comm: DataFrame) -> DataFrame:
    """(value): ``commU commV`` for every half-edge."""
    a, b = comm.select(F.col("id").alias("src"), F.col("comm").alias("cs")), comm.select(F.col("id").alias("dst"), F.col("comm").alias("cd"))
    return edges.join(a, "src").join(b, "dst").orderBy("src", "dst").select(F.concat_ws(" ", "cs", "cd").alias("value"))


def read_hierarchy(spark: SparkSession, path: str) -> DataFrame:
    """(level, id, comm) of concatenated blocks of ``node community``; node 0 begins a level."""
    lines = renumber(_lines(spark, path)).select("pos", F.split("value", " ").alias("p")).select("pos", F.col("p")[0].cast("long").alias("id"), F.col("p")[1].cast("long").alias("comm"))
    from ..operators.scans import scan

    marks = scan(lines.select("pos", (F.col("id") == 0).cast("long").alias("val")), inclusive=True)
    return lines.join(marks, "pos").select((F.col("val") - 1).alias("level"), "id", "comm")


def read_features(spark: SparkSession, path: str) -> tuple[DataFrame, dict[str, str]]:
    """Rows (label, f0, f1, ...) of comma-separated bytes, and the features' kinds from the
    first line (`d` discrete, `i` continuous); the last column is the label. A value
    outside 0..255 is an error."""
    lines = _lines(spark, path)
    kinds = [x.strip() for x in lines.where("pos = 0").first()["value"].split(",")]
    parts = lines.where("pos > 0").select(F.transform(F.split("value", ","), lambda x: F.trim(x).try_cast("int")).alias("p"))
    if not parts.where(F.exists("p", lambda x: x.isNull() | ~x.between(0, 255)) | (F.size("p") != len(kinds))).isEmpty():
        raise ValueError(f"{path} has values outside 0..255")
    last = len(kinds) - 1
    return parts.select(F.col("p")[last].alias("label"), *(F.col("p")[i].alias(f"f{i}") for i in range(last))), {f"f{i}": k for i, k in enumerate(kinds[:last])}


def read_sparse_regression(spark: SparkSession, path: str, rows: int) -> tuple[DataFrame, DataFrame]:
    """Targets (row, y) and entries (row, col, val) of a file of numbers: ``rows`` targets,
    then pairs of a linear index (from 1, column by column) and a value."""
    numbers = _numbers(spark, path).withColumn("val", F.col("val").cast("double"))
    y = numbers.where(F.col("pos") < rows).select(F.col("pos").alias("row"), F.col("val").alias("y"))
    pairs = numbers.where(F.col("pos") >= rows).withColumn("k", F.floor((F.col("pos") - rows) / 2)).groupBy("k").agg(F.min_by("val", "pos").alias("i"), F.max_by("val", "pos").alias("v"))
    at = F.col("i").cast("long") - 1
    return y, pairs.select((at % rows).alias("row"), F.floor(at / rows).alias("col"), F.col("v").alias("val"))


def read_chars(spark: SparkSession, path: str, start: int = 0, end: int = 0) -> DataFrame:
    """(path, value): whole files as text, or their bytes from ``start`` to ``end`` (0: to the end)."""
    whole = spark.read.format("binaryFile").load(path)
    size = F.octet_length("content")
    part = F.substring("content", F.lit(start + 1), (F.lit(end) if end else size) - start)
    return whole.select("path", F.decode(part, "UTF-8").alias("value"))


def write_chars(rows: DataFrame, key: str, value: str, path: str) -> None:
    """The characters of ``value`` and a line feed, in a folder for each ``key`` (of one row each)."""
    rows.select(key, value).write.partitionBy(key).text(path)


def read_char_folders(spark: SparkSession, path: str, key: str, value: str) -> DataFrame:
    """(key, value) of what `write_chars` wrote."""
    return spark.read.text(path, wholetext=True).select(key, F.substring("value", F.lit(1), F.length("value") - 1).alias(value))


def read_commented_tsv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Tab-separated rows with a header; lines that begin with # are comments.

    Files of a folder follow each other by name, and the header is the first line of all of them that is
    neither blank nor a comment. A task keeps the first such line of each split that it reads."""
    kept = spark.read.text(path).select(F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_m"), "value")
    kept = kept.where("trim(value) <> '' and not startswith(value, '#')")
    placed = cut(kept, "lines")
    head = placed.groupBy("_file", "_start").agg(F.min("_m").alias("_m")).orderBy("_file", "_start").limit(1)  # one row
    rows = placed.join(F.broadcast(head), ["_file", "_start", "_m"], "left_anti")
    return rows.select(F.from_csv("value", schema, {"sep": "\t"}).alias("r")).select("r.*")


def scrape(lines: DataFrame, pattern: str, name: str) -> DataFrame:
    """(name): what the pattern's first group matches in the lines (value) that have it, as double."""
    return lines.select(F.regexp_extract("value", pattern, 1).alias("m")).where("m <> ''").select(F.col("m").cast("double").alias(name))


def convert_triples(spark: SparkSession, paths: list[str], out: str, weighted: bool = True) -> None:
    """Every file of triples as a Parquet of half-edges, parallel edges merged, at ``out``/<name>."""
    from ..operators.graphs import clean

    for path in paths:
        name = path.rstrip("/").rpartition("/")[2].removesuffix(".txt")
        clean(read_triples(spark, path, weighted)[1]).write.parquet(f"{out}/{name}")


def write_results(df: DataFrame, path: str, *order: str) -> None:
    """Comma-separated rows with a header, in one file and in order: for summaries."""
    df.orderBy(*order).coalesce(1).write.csv(path, header=True)
