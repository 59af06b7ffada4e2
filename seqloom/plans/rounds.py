"""Queries of operators that work in rounds: stepping, switching, speculation, covers, forests.

Their SQL finds the same by keyed recursion.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import query
from ..operators import covers, forests, frontier, speculation, stepping
from .tables import EDGES, both_ways, part_graph, table, whole_graph

_EDGES = EDGES.rstrip()
WHOLE = _EDGES + ", k AS (SELECT row_number() OVER (ORDER BY src, dst) - 1 AS eid, src, dst, (src * 31 + dst * 17) % 97 AS w FROM e) "

DISTANCES = _EDGES + """, x AS (SELECT src, dst, (least(src, dst) * 7 + greatest(src, dst) * 13) % 50 + 1 AS w FROM h), r(id, dist) USING KEY (id) AS (SELECT CAST(1 AS BIGINT), CAST(0 AS BIGINT) UNION
 SELECT x.dst, min(r.dist + w) FROM r JOIN x ON x.src = r.id LEFT JOIN recurring.r o ON o.id = x.dst GROUP BY x.dst, o.dist HAVING o.dist IS NULL OR min(r.dist + w) < o.dist) SELECT id, dist FROM r"""

LEVELS = _EDGES + """, r(id, dist) USING KEY (id) AS (SELECT CAST(1 AS BIGINT), 0 UNION
 SELECT DISTINCT h.dst, r.dist + 1 FROM r JOIN h ON h.src = r.id LEFT JOIN recurring.r o ON o.id = h.dst WHERE o.id IS NULL), b AS (SELECT id, dist FROM r) """

COMPONENTS = _EDGES + """, c(id, comp) USING KEY (id) AS (SELECT p_partkey, p_partkey FROM part UNION
 SELECT h.src, min(w.comp) FROM c w JOIN h ON h.dst = w.id JOIN recurring.c own ON own.id = h.src GROUP BY h.src, own.comp HAVING min(w.comp) < own.comp) SELECT id, comp FROM c"""

INDEPENDENT = _EDGES + """, s(id, chosen) USING KEY (id) AS (SELECT p_partkey, CAST(NULL AS BOOLEAN) FROM part UNION
 SELECT u.id, NOT coalesce(bool_or(w.chosen), false) FROM recurring.s u LEFT JOIN e ON e.dst = u.id LEFT JOIN recurring.s w ON w.id = e.src
 WHERE u.chosen IS NULL GROUP BY u.id HAVING bool_or(w.chosen) OR count(e.src) = count(w.chosen)) """

MATCHING = WHOLE.rstrip() + """, m(eid, src, dst) USING KEY (eid) AS (SELECT CAST(-1 AS BIGINT), CAST(-1 AS BIGINT), CAST(-1 AS BIGINT) UNION
 (WITH t AS (SELECT src AS v FROM recurring.m UNION ALL SELECT dst FROM recurring.m), o AS (SELECT * FROM k WHERE src NOT IN (SELECT v FROM t) AND dst NOT IN (SELECT v FROM t)),
 l AS (SELECT v, min(eid) AS eid FROM (SELECT src AS v, eid FROM o UNION ALL SELECT dst, eid FROM o) GROUP BY v)
 SELECT o.eid, o.src, o.dst FROM o JOIN l a ON a.v = o.src AND a.eid = o.eid JOIN l b ON b.v = o.dst AND b.eid = o.eid)) """

CORES = _EDGES + """, c(id, core) USING KEY (id) AS (SELECT p_partkey, coalesce(d, 0) FROM part LEFT JOIN (SELECT src, count(*) AS d FROM h GROUP BY 1) ON src = p_partkey UNION
 SELECT id, max(least(c, r)) FROM (SELECT h.src AS id, w.core AS c, own.core AS was, row_number() OVER (PARTITION BY h.src ORDER BY w.core DESC) AS r FROM h JOIN recurring.c w ON w.id = h.dst JOIN recurring.c own ON own.id = h.src)
 GROUP BY id, was HAVING max(least(c, r)) < was) SELECT id, core FROM c"""

COLOURS = _EDGES + """, g AS (SELECT p_partkey AS id, coalesce(d, 0) AS d FROM part LEFT JOIN (SELECT src, count(*) AS d FROM h GROUP BY 1) ON src = p_partkey),
 p AS (SELECT h.src, h.dst FROM h JOIN g a ON a.id = h.src JOIN g b ON b.id = h.dst WHERE a.d > b.d OR (a.d = b.d AND a.id < b.id)),
 c(id, colour) USING KEY (id) AS (SELECT p_partkey, CAST(NULL AS INTEGER) FROM part UNION
 SELECT u.id, CAST(list_min(list_filter(range(count(*) + 1), lambda x: NOT coalesce(list_contains(list(w.colour), x), false))) AS INTEGER) FROM recurring.c u LEFT JOIN p ON p.dst = u.id LEFT JOIN recurring.c w ON w.id = p.src
 WHERE u.colour IS NULL GROUP BY u.id HAVING count(p.src) = count(w.colour)) SELECT id, colour FROM c"""

COVER = """WITH RECURSIVE s AS (SELECT DISTINCT l_suppkey AS "set", l_partkey AS element FROM lineitem), r("set", round) USING KEY ("set") AS (SELECT CAST(-1 AS BIGINT), -1 UNION
 (WITH g AS (SELECT element FROM s WHERE "set" IN (SELECT "set" FROM recurring.r)), o AS (SELECT * FROM s WHERE element NOT IN (SELECT element FROM g)), z AS (SELECT "set", count(*) AS k FROM o GROUP BY 1),
 b AS (SELECT element, arg_min("set", (-k, "set")) AS best FROM o JOIN z USING ("set") GROUP BY 1)
 SELECT o."set", (SELECT max(round) FROM recurring.r) + 1 FROM o JOIN b USING (element) GROUP BY 1 HAVING bool_and(o."set" = best))) SELECT "set", round FROM r WHERE round >= 0"""

#: Vertices of one label take their least edge to another label (which is in the forest, whatever the
#: label covers), and the label of its other end where that is smaller.
_FOREST = """ f(t, id, comp) USING KEY (t, id) AS (SELECT 0, p_partkey, p_partkey FROM part UNION
 (WITH l AS (SELECT id, comp FROM recurring.f WHERE t = 0), x AS (SELECT w, eid, a.comp AS ca, b.comp AS cb FROM k JOIN l a ON a.id = src JOIN l b ON b.id = dst WHERE a.comp <> b.comp),
 b AS (SELECT c, arg_min(eid, (w, eid)) AS eid, arg_min(o, (w, eid)) AS o FROM (SELECT w, eid, ca AS c, cb AS o FROM x UNION ALL SELECT w, eid, cb, ca FROM x) GROUP BY c)
 SELECT 0, id, o FROM l JOIN b ON b.c = l.comp WHERE o < comp UNION ALL SELECT DISTINCT 1, eid, CAST(0 AS BIGINT) FROM b WHERE eid NOT IN (SELECT id FROM recurring.f WHERE t = 1)))
 SELECT {} FROM k WHERE eid IN (SELECT id FROM f WHERE t = 1)"""


def forest_sql(edges: str, columns: str) -> str:
    """The minimum spanning forest of the edges k (eid, src, dst, w)."""
    return f"{edges.rstrip()}," + _FOREST.format(columns)


def _one(spark):
    return spark.createDataFrame([(1,)], "id long")


@query("sssp_stepping", DISTANCES)
def _(spark, d):
    edges = part_graph(spark, d)[1]
    weighted = both_ways(edges).withColumn("w", F.pmod(F.least("src", "dst") * 7 + F.greatest("src", "dst") * 13, F.lit(50)) + 1)
    return stepping.delta_stepping(weighted, _one(spark)).paths.select("id", "dist")


@query("bfs_switching", LEVELS + "SELECT b.id, b.dist, min(CASE WHEN b.dist = 0 THEN b.id ELSE a.id END) AS parent FROM b JOIN h ON h.dst = b.id JOIN b a ON a.id = h.src AND (a.dist = b.dist - 1 OR b.dist = 0) GROUP BY 1, 2")
def _(spark, d):
    return frontier.search(both_ways(part_graph(spark, d)[1]), _one(spark)).found


@query("speculative_matching", MATCHING + "SELECT eid FROM m WHERE eid >= 0")
def _(spark, d):
    return speculation.matching(whole_graph(spark, d)[1]).committed.select(F.col("item").alias("eid"))


@query("speculative_independent_set", INDEPENDENT + "SELECT id FROM s WHERE chosen")
def _(spark, d):
    vertices, edges = part_graph(spark, d)
    return speculation.independent_set(vertices, edges).committed.select(F.col("item").alias("id"))


@query("speculative_forest", forest_sql(_EDGES + ", k AS (SELECT row_number() OVER (ORDER BY src, dst) - 1 AS eid, src, dst, 0 AS w FROM e)", "eid"))
def _(spark, d):
    return speculation.spanning_forest(*whole_graph(spark, d)).committed.select(F.col("item").alias("eid"))


@query("set_cover_bucketed", "SELECT DISTINCT l_partkey AS element, true AS covered FROM lineitem")
def _(spark, d):
    """Parts covered by orders: for each part, whether a chosen order has it."""
    sets = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("set"), F.col("l_partkey").alias("element"))
    chosen = covers.bucketed_cover(sets, epsilon=0.25).chosen.select("set", F.lit(True).alias("c"))
    return sets.join(chosen, "set", "left").groupBy("element").agg(F.coalesce(F.bool_or("c"), F.lit(False)).alias("covered"))


@query("filtered_forest", forest_sql(WHOLE, "eid, src, dst, w"))
def _(spark, d):
    """All edges of the part graph; passes go on down to 2,000 edges."""
    return forests.filtered_forest(*whole_graph(spark, d), least=2_000).forest
