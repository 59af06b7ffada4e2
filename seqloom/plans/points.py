"""Queries on points, boxes and learning."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..catalog import query
from ..operators import learning, spatial, sparse, zindex
from ..storage import cut
from .tables import table


def _points(spark, d):
    v = F.col("embedding")
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), *(F.floor(v[i] * 1000).cast("double").alias(a) for i, a in enumerate("xyz")))


_PTS = "WITH p AS (SELECT vec_id AS id, floor(embedding[1] * 1000::DOUBLE) AS x, floor(embedding[2] * 1000::DOUBLE) AS y, floor(embedding[3] * 1000::DOUBLE) AS z FROM embeddings) "
_D2 = "(a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z)"


_NEAREST = _PTS + f"SELECT id, CAST(rank AS INTEGER) AS rank, other, d2 FROM (SELECT a.id, b.id AS other, {_D2} AS d2, row_number() OVER (PARTITION BY a.id ORDER BY {_D2}, b.id) AS rank FROM p a JOIN p b ON a.id <> b.id) WHERE rank <= 10"


@query("nearest_neighbours", _NEAREST)
def _(spark, d):
    return spatial.nearest_neighbours(_points(spark, d), 10).select("id", "rank", "other", "d2")


@query("nearest_neighbours_indexed", _NEAREST)
def _(spark, d):
    return zindex.nearest(_points(spark, d), 10).found.select("id", "rank", "other", "d2")


@query("radius_pairs", _PTS + f"SELECT a.id, b.id AS other, {_D2} AS d2 FROM p a JOIN p b ON a.id <> b.id AND {_D2} < 2500")
def _(spark, d):
    return spatial.radius_pairs(_points(spark, d), 50.0)


def _z_sql(bits: int = 10) -> str:
    cell = ", ".join(f"least(CAST(floor(({a} - (SELECT min({a}) FROM p)) / (SELECT max({a}) - min({a}) FROM p) * {1 << bits}) AS BIGINT), {(1 << bits) - 1}) AS {a}" for a in "xyz")
    z = " + ".join(f"((({a} >> {b}) & 1) << {3 * b + j})" for j, a in enumerate("xyz") for b in range(bits))
    return _PTS.rstrip() + f", c AS (SELECT id, {cell} FROM p) SELECT id, {z} AS z FROM c"


@query("z_order", _z_sql())
def _(spark, d):
    return spatial.z_order(_points(spark, d)).select("id", "z")


@query("box_overlaps", _PTS.rstrip() + ", b AS (SELECT id, x, y, z, x + 30 + id % 40 AS hx, y + 30 + id % 40 AS hy, z + 30 + id % 40 AS hz FROM p) SELECT a.id AS i, b.id AS j FROM b a JOIN b ON a.id < b.id AND a.x < b.hx AND b.x < a.hx AND a.y < b.hy AND b.y < a.hy AND a.z < b.hz AND b.z < a.hz")
def _(spark, d):
    size = 30 + F.col("id") % 40
    boxes = _points(spark, d).select("id", *(c for a in "xyz" for c in (F.col(a).alias(f"{a}lo"), (F.col(a) + size).alias(f"{a}hi"))))
    return spatial.box_overlaps(boxes, 70.0)


_CROSS = lambda u, v: [f"({u}{i} * {v}{j} - {u}{j} * {v}{i})" for i, j in ((2, 3), (3, 1), (1, 2))]
_DOT = lambda u, v: "(" + " + ".join(f"{a} * {b}" for a, b in zip(u, v, strict=True)) + ")"


def _ray_sql() -> str:
    name = lambda x: [f"{x}{i}" for i in (1, 2, 3)]
    at = lambda x, k: ", ".join(f"embedding[{k + i}]::DOUBLE AS {x}{i}" for i in (1, 2, 3))
    minus = lambda x, y, z: ", ".join(f"{y}{i} - {z}{i} AS {x}{i}" for i in (1, 2, 3))
    named = lambda x, cols: ", ".join(f"{c} AS {x}{i}" for i, c in enumerate(cols, 1))
    return f"""WITH r AS (SELECT vec_id AS ray, {at("o", 0)}, {at("d", 3)} FROM embeddings), t AS (SELECT vec_id AS tri, {at("a", 6)}, {at("b", 9)}, {at("c", 12)} FROM embeddings),
 e AS (SELECT *, {minus("e", "b", "a")}, {minus("f", "c", "a")}, {minus("s", "o", "a")} FROM r, t), p AS (SELECT *, {named("p", _CROSS("d", "f"))}, {named("q", _CROSS("s", "e"))} FROM e),
 x AS (SELECT *, {_DOT(name("e"), name("p"))} AS det FROM p), h AS (SELECT ray, tri, {_DOT(name("s"), name("p"))} / det AS u, {_DOT(name("d"), name("q"))} / det AS v, {_DOT(name("f"), name("q"))} / det AS t FROM x WHERE abs(det) > 1e-12),
 n AS (SELECT ray, arg_min(tri, (t, tri)) AS tri, min(t) AS t FROM h WHERE u >= 0 AND v >= 0 AND u + v <= 1 AND t > 1e-12 GROUP BY 1)
 SELECT r.ray, coalesce(n.tri, -1) AS tri, coalesce(round(n.t, 6), -1.0) AS t FROM r LEFT JOIN n USING (ray)"""


@query("ray_cast", _ray_sql())
def _(spark, d):
    v = F.col("embedding")
    at = lambda i: F.array(*(v[i + j].cast("double") for j in range(3)))
    e = table(spark, d, "embeddings")
    rays = e.select(F.col("vec_id").alias("ray"), at(0).alias("o"), at(3).alias("d"))
    triangles = e.select(F.col("vec_id").alias("tri"), at(6).alias("a"), at(9).alias("b"), at(12).alias("c"))
    return spatial.ray_cast(rays, triangles).select("ray", F.coalesce("tri", F.lit(-1)).alias("tri"), F.coalesce(F.round("t", 6), F.lit(-1.0)).alias("t"))


@query("upper_hull", _PTS.rstrip() + """, q AS (SELECT x, max(y) AS y FROM p GROUP BY 1), h AS (SELECT * FROM q c WHERE NOT EXISTS (SELECT 1 FROM q a, q b WHERE a.x < c.x AND b.x > c.x AND (b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x) <= 0))
 SELECT (SELECT min(id) FROM p WHERE p.x = h.x AND p.y = h.y) AS id, x, y FROM h""")
def _(spark, d):
    return spatial.upper_hull(_points(spark, d))


@query("delaunay")
def _(spark, d):
    v = F.col("embedding")
    return spatial.delaunay(table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), v[0].alias("x"), v[1].alias("y")))


@query("linear_program", """WITH r AS (SELECT vec_id AS i, embedding[1]::DOUBLE AS a, embedding[2]::DOUBLE AS b, abs(embedding[3])::DOUBLE + 1.0 AS c FROM embeddings),
 v AS (SELECT (p.c * q.b - q.c * p.b) / (p.a * q.b - q.a * p.b) AS x, (p.a * q.c - q.a * p.c) / (p.a * q.b - q.a * p.b) AS y FROM r p JOIN r q ON p.i < q.i WHERE abs(p.a * q.b - q.a * p.b) > 1e-12),
 ok AS (SELECT x, y FROM v WHERE NOT EXISTS (SELECT 1 FROM r WHERE a * x + b * y > c + 1e-9)) SELECT round(x, 6) AS x, round(y, 6) AS y FROM ok ORDER BY x + 0.5 * y DESC LIMIT 1""")
def _(spark, d):
    v = F.col("embedding")
    rows = table(spark, d, "embeddings").select(v[0].cast("double").alias("a"), v[1].cast("double").alias("b"), (F.abs(v[2]) + 1.0).cast("double").alias("c"))
    return spark.createDataFrame([tuple(round(v, 6) for v in spatial.linear_program(rows, 1.0, 0.5))], "x double, y double")


#: A pair's force counts in these, a power of 2: dividing by it is exact.
_UNIT = 2.0**-46


def _force_sql(c: str) -> str:
    """The sum of pairs' forces in whole units, exact in any order; a million of it to the 5th place, downwards."""
    units = f"sum(CASE WHEN {_D2} > 0 THEN CAST(floor((1.0 + b.id % 3)::DOUBLE * (b.{c} - a.{c}) / (({_D2}) * sqrt({_D2})) / {_UNIT!r}::DOUBLE + 0.5) AS BIGINT) ELSE 0 END)"
    return f"floor(CAST({units} AS DOUBLE) * {_UNIT!r}::DOUBLE * 100000000000::DOUBLE) / 100000::DOUBLE AS f{c}"


@query("total_forces", _PTS + "SELECT a.id, " + ", ".join(map(_force_sql, "xyz")) + " FROM p a, p b WHERE a.id <> b.id GROUP BY a.id")
def _(spark, d):
    got = spatial.total_forces(_points(spark, d).withColumn("mass", F.lit(1.0) + F.col("id") % 3), unit=_UNIT)
    place = lambda c: F.floor(F.col(c).cast("double") * _UNIT * 1e11).cast("double") / 100_000.0
    return got.select("id", *(place(c).alias(c) for c in ("fx", "fy", "fz")))


@query("approximate_forces", _PTS + "SELECT id, true AS close FROM p")
def _(spark, d):
    """For every body, whether the force through the index is within a thousandth of the exact one."""
    bodies = _points(spark, d).withColumn("mass", F.lit(1.0) + F.col("id") % 3)
    exact = spatial.total_forces(bodies).select("id", *(F.col(f"f{a}").alias(f"e{a}") for a in "xyz"))
    both = cut(zindex.approximate_forces(bodies).found.join(exact, "id"), "forces")  # read twice
    off, size = (sum((F.pow(x(a), 2) for a in "xyz"), F.lit(0.0)) for x in (lambda a: F.col(f"f{a}") - F.col(f"e{a}"), lambda a: F.col(f"e{a}")))
    typical = both.agg(F.avg(F.sqrt(size)).alias("typical"))
    return both.withColumns({"off": F.sqrt(off), "size": F.sqrt(size)}).crossJoin(F.broadcast(typical)).select("id", (F.col("off") <= 1e-3 * F.greatest("size", "typical")).alias("close"))  # one row


def _vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"), "label")


@query("kmeans")
def _(spark, d):
    points = _vectors(spark, d)
    centers, _ = learning.kmeans(points, 10, max_rounds=None)
    return learning.assign(points, centers).select("id", "center")


@query("kmeans_assign", "SELECT id, CAST(arg_min(c, (round(d2, 9), c)) AS INTEGER) AS center FROM (SELECT e.vec_id AS id, f.label AS c, list_sum(list_transform(list_zip(e.embedding, f.embedding), lambda z: (z[1]::DOUBLE - z[2]) * (z[1]::DOUBLE - z[2]))) AS d2 FROM embeddings e, (SELECT label, arg_min(embedding, vec_id) AS embedding FROM embeddings GROUP BY 1) f) GROUP BY 1")
def _(spark, d):
    points = _vectors(spark, d)
    rows = points.groupBy("label").agg(F.min_by("vec", "id").alias("vec")).orderBy("label").collect()  # a row for each label
    got = learning.assign(points, np.array([r["vec"] for r in rows], dtype=float))
    labels = F.array(*(F.lit(r["label"]) for r in rows))
    return got.select("id", labels[F.col("center")].alias("center"))


def _features(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.least(F.floor(F.length("text") / 64), F.lit(255)).cast("int").alias("f0"), F.least(F.regexp_count("text", F.lit("!")), F.lit(255)).alias("f1"), F.pmod(F.ascii("lang"), F.lit(256)).alias("f2"), F.least(F.regexp_count("text", F.lit("\n")), F.lit(255)).alias("f3"))
    return docs.join(table(spark, d, "labels").select("doc_id", F.col("quality").alias("label")), "doc_id")


@query("decision_tree")
def _(spark, d):
    rows = _features(spark, d)
    nodes = learning.decision_tree(rows, {"f0": "i", "f1": "i", "f2": "d", "f3": "i"}, "label", max_depth=6)
    return learning.classify(rows, nodes).select("doc_id", "label", "predicted")


@query("lasso")
def _(spark, d):
    rows = table(spark, d, "lineitem").select("l_quantity", F.col("l_discount"), F.col("l_tax"), (F.col("l_extendedprice") / 1000).alias("y"))
    w = learning.lasso(rows, ["l_quantity", "l_discount", "l_tax"], "y", 10.0)
    return spark.createDataFrame([(i, round(float(x), 6)) for i, x in enumerate(w)], "feature int, weight double")


@query("lasso_path", "SELECT CAST(s AS INTEGER) AS step, col, true AS holds FROM (SELECT DISTINCT l_partkey AS col FROM lineitem), range(4) r(s)")
def _(spark, d):
    """Orders' prices from the quantities of their parts: whether every part's condition holds at every penalty."""
    entries = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("row"), F.col("l_partkey").alias("col"), F.col("l_quantity").cast("double").alias("val"))
    targets = table(spark, d, "orders").select(F.col("o_orderkey").alias("row"), (F.col("o_totalprice") / 10_000).cast("double").alias("y"))
    return sparse.conditions(entries, targets, sparse.lasso_path(entries, targets, steps=4, ratio=0.3))
