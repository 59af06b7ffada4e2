"""Queries on graphs."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..catalog import query
from ..operators import community, graphs, ranking, structure, traversal
from ..sources import generators
from .rounds import COLOURS, COMPONENTS, CORES, COVER, DISTANCES, INDEPENDENT, LEVELS, MATCHING, forest_sql
from .tables import EDGES, LINKS, both_ways, link_graph, part_graph, table, whole_graph


@query("transpose", EDGES + "SELECT dst AS src, src AS dst FROM e")
def _(spark, d):
    return graphs.transpose(part_graph(spark, d)[1])


@query("symmetrize", EDGES + "SELECT src, dst FROM h")
def _(spark, d):
    return graphs.symmetrize(part_graph(spark, d)[1])


@query("num_vertices", EDGES + "SELECT max(greatest(src, dst)) + 1 AS n FROM e")
def _(spark, d):
    return graphs.num_vertices(part_graph(spark, d)[1])


@query("degrees", EDGES + "SELECT src AS id, count(*) AS degree FROM h GROUP BY 1")
def _(spark, d):
    return graphs.degrees(both_ways(part_graph(spark, d)[1])).select("id", "degree")


@query("graph_stats", EDGES + "SELECT count(*) AS n, CAST(sum(k) AS BIGINT) AS m, max(k) AS max_degree FROM (SELECT src, count(*) AS k FROM h GROUP BY 1)")
def _(spark, d):
    return graphs.stats(both_ways(part_graph(spark, d)[1]))


@query("normalized_matrix", EDGES + "SELECT e.src AS \"row\", e.dst AS col, round(1.0 / k, 9) AS val FROM e JOIN (SELECT dst, count(*) AS k FROM e GROUP BY 1) USING (dst)")
def _(spark, d):
    return graphs.normalized_matrix(part_graph(spark, d)[1]).select("row", "col", F.round("val", 9).alias("val"))


@query("clean_weighted", "SELECT l_suppkey AS src, l_partkey AS dst, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS w FROM lineitem GROUP BY 1, 2")
def _(spark, d):
    return graphs.clean(table(spark, d, "lineitem").select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst"), F.col("l_quantity").cast("long").alias("w")))


@query("renumber", EDGES.rstrip() + ", v AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS k FROM (SELECT DISTINCT src AS id FROM h)) SELECT a.k AS src, b.k AS dst FROM e JOIN v a ON a.id = src JOIN v b ON b.id = dst")
def _(spark, d):
    return graphs.renumber(part_graph(spark, d)[1])[0]


@query("check_symmetry", EDGES.rstrip() + ", g AS (SELECT src, dst FROM e UNION ALL SELECT dst, src FROM e WHERE (src + dst) % 3 = 0) SELECT count(*) AS missing FROM g WHERE NOT EXISTS (SELECT 1 FROM g r WHERE r.src = g.dst AND r.dst = g.src)")
def _(spark, d):
    """A third of the edges have their reverse."""
    edges = part_graph(spark, d)[1]
    back = edges.where((F.col("src") + F.col("dst")) % 3 == 0).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return graphs.check_symmetry(edges.unionByName(back)).agg(F.count(F.lit(1)).alias("missing"))


@query("adjacency", EDGES + "SELECT src AS id, string_agg(CAST(dst AS VARCHAR), ' ' ORDER BY dst) AS neighbours FROM h GROUP BY 1")
def _(spark, d):
    return graphs.adjacency(both_ways(part_graph(spark, d)[1])).select("id", F.array_join(F.col("neighbours").cast("array<string>"), " ").alias("neighbours"))


@query("edge_map", EDGES + "SELECT dst AS id, min(src) AS parent FROM h WHERE src IN (SELECT s_suppkey FROM supplier) AND dst NOT IN (SELECT s_suppkey FROM supplier) GROUP BY 1")
def _(spark, d):
    frontier = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"))
    return graphs.edge_map(both_ways(part_graph(spark, d)[1]), frontier, visited=frontier)


_TRIANGLES = EDGES + "SELECT {} FROM e x JOIN e y ON y.src = x.dst JOIN e z ON z.src = x.src AND z.dst = y.dst"


@query("triangle_count", _TRIANGLES.format("count(*) AS triangles"))
def _(spark, d):
    return graphs.triangles(part_graph(spark, d)[1]).agg(F.count(F.lit(1)).alias("triangles"))


@query("triangles_by_part", EDGES + "SELECT id, count(*) AS n FROM (SELECT unnest([x.src, x.dst, y.dst]) AS id FROM e x JOIN e y ON y.src = x.dst JOIN e z ON z.src = x.src AND z.dst = y.dst) GROUP BY 1")
def _(spark, d):
    found = graphs.triangles(part_graph(spark, d)[1])
    return found.select(F.explode(F.array("a", "b", "c")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("n"))


_BFS = LEVELS


def _one(spark):
    return spark.createDataFrame([(1,)], "id long")


@query("bfs", _BFS + "SELECT id, CAST(dist AS INTEGER) AS dist FROM b")
def _(spark, d):
    return traversal.bfs(both_ways(part_graph(spark, d)[1]), _one(spark)).select("id", "dist")


@query("bfs_parents", _BFS + "SELECT b.id, min(CASE WHEN b.dist = 0 THEN b.id ELSE a.id END) AS parent FROM b JOIN h ON h.dst = b.id JOIN b a ON a.id = h.src AND (a.dist = b.dist - 1 OR b.dist = 0) GROUP BY 1")
def _(spark, d):
    return traversal.bfs(both_ways(part_graph(spark, d)[1]), _one(spark)).select("id", "parent")


@query("bfs_by_distance", _BFS + "SELECT CAST(dist AS BIGINT) AS dist, count(*) AS n FROM b GROUP BY 1")
def _(spark, d):
    unit = both_ways(part_graph(spark, d)[1]).withColumn("w", F.lit(1).cast("long"))
    return traversal.by_distance(traversal.shortest_paths(unit, _one(spark)))


@query("sssp_weighted", DISTANCES)
def _(spark, d):
    vertices, edges = part_graph(spark, d)
    weighted = both_ways(edges).withColumn("w", F.pmod(F.least("src", "dst") * 7 + F.greatest("src", "dst") * 13, F.lit(50)) + 1)
    return traversal.shortest_paths(weighted, _one(spark)).select("id", "dist")


def _between_sql(deepest: int = 12) -> str:
    parts = [_BFS.rstrip(), ", p0 AS MATERIALIZED (SELECT id, CAST(1.0 AS DOUBLE) AS paths FROM b WHERE dist = 0)"]
    for k in range(1, deepest + 1):
        parts.append(f", p{k} AS MATERIALIZED (SELECT dst AS id, sum(paths) AS paths FROM p{k - 1} p JOIN h ON src = p.id JOIN b ON b.id = dst AND b.dist = {k} GROUP BY 1)")
    parts.append(f", q{deepest} AS MATERIALIZED (SELECT id, paths, CAST(0.0 AS DOUBLE) AS dep FROM p{deepest})")
    for k in range(deepest - 1, -1, -1):
        parts.append(f", q{k} AS MATERIALIZED (SELECT p.id, p.paths, coalesce(p.paths * sum((1 + q.dep) / q.paths), 0.0) AS dep FROM p{k} p LEFT JOIN (h JOIN q{k + 1} q ON q.id = dst) ON src = p.id GROUP BY p.id, p.paths)")
    rows = " UNION ALL ".join(f"SELECT id, CAST({k} AS INTEGER) AS dist, paths, round({'0.0' if k == 0 else 'dep'}, 6) AS dependency FROM q{k}" for k in range(deepest + 1))
    return "".join(parts) + " " + rows


@query("betweenness", _between_sql())
def _(spark, d):
    got = traversal.betweenness(both_ways(part_graph(spark, d)[1]), 1)
    return got.select("id", "dist", "paths", F.round("dependency", 6).alias("dependency"))


@query("low_diameter_decomposition")
def _(spark, d):
    vertices, edges = part_graph(spark, d)
    return traversal.low_diameter(both_ways(edges), vertices)


@query("le_lists")
def _(spark, d):
    vertices, edges = whole_graph(spark, d)
    return traversal.le_lists(both_ways(edges.select("src", "dst")), vertices)


def _rank_sql(k: int) -> str:
    parts = [EDGES.rstrip(), ", n AS (SELECT count(*) AS n FROM part), m AS (SELECT e.src AS r, e.dst AS c, 1.0 / k AS v FROM e JOIN (SELECT dst, count(*) AS k FROM e GROUP BY 1) USING (dst)), r0 AS (SELECT p_partkey AS id, CAST(1.0 AS DOUBLE) / n AS rank FROM part, n)"]
    for i in range(1, k + 1):
        parts.append(f", r{i} AS (SELECT p_partkey AS id, CAST(0.15 AS DOUBLE) / n + CAST(0.85 AS DOUBLE) * coalesce(g, 0) AS rank FROM part CROSS JOIN n LEFT JOIN (SELECT r, sum(CAST(v AS DOUBLE) * rank) AS g FROM m JOIN r{i - 1} ON id = c GROUP BY 1) ON r = p_partkey)")
    return "".join(parts) + f" SELECT id, round(rank, 9) AS rank FROM r{k}"


@query("pagerank_fixed", _rank_sql(5))
def _(spark, d):
    vertices, edges = part_graph(spark, d)
    return ranking.pagerank_fixed(vertices, edges, 5).select("id", F.round("rank", 9).alias("rank"))


@query("pagerank")
def _(spark, d):
    vertices, edges = part_graph(spark, d)
    return ranking.pagerank(vertices, edges)[0]


def _walk_sql(k: int) -> str:
    parts = [EDGES.rstrip(), ", n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM part), o AS (SELECT src AS s, CAST(count(*) AS DOUBLE) AS k FROM e GROUP BY 1), r0 AS (SELECT p_partkey AS id, 1.0 / n AS rank FROM part, n)"]
    for i in range(1, k + 1):
        parts.append(f", d{i} AS (SELECT coalesce(sum(rank), 0) AS d FROM r{i - 1} WHERE id NOT IN (SELECT s FROM o)), r{i} AS (SELECT p_partkey AS id, CAST(0.15 AS DOUBLE) / n + CAST(0.85 AS DOUBLE) * d / n + CAST(0.85 AS DOUBLE) * coalesce(g, 0) AS rank FROM part CROSS JOIN n CROSS JOIN d{i} LEFT JOIN (SELECT dst, sum(rank / k) AS g FROM e JOIN r{i - 1} ON id = src JOIN o ON s = src GROUP BY 1) ON dst = p_partkey)")
    return "".join(parts) + f" SELECT id, round(rank, 9) AS rank FROM r{k}"


@query("pagerank_rounds", _walk_sql(8))
def _(spark, d):
    vertices, edges = part_graph(spark, d)
    return ranking.pagerank(vertices, edges, eps=0.0, max_iterations=8)[0].select("id", F.round("rank", 9).alias("rank"))


@query("rank_difference", _walk_sql(8).rsplit(" SELECT ", 1)[0] + " SELECT round(avg(abs(a.rank - b.rank)), 12) AS average_difference, round(max(abs(a.rank - b.rank)), 12) AS largest_difference FROM r8 a JOIN r4 b USING (id)")
def _(spark, d):
    vertices, edges = part_graph(spark, d)
    late, early = (ranking.pagerank(vertices, edges, eps=0.0, max_iterations=k)[0] for k in (8, 4))
    return ranking.average_difference(late, early).select(F.round("average_difference", 12).alias("average_difference"), F.round("largest_difference", 12).alias("largest_difference"))


@query("matrix_vector", EDGES + "SELECT e.src AS pos, CAST(sum(e.dst % 10) AS DOUBLE) AS val FROM e GROUP BY 1")
def _(spark, d):
    vertices, edges = part_graph(spark, d)
    matrix = edges.select(F.col("src").alias("row"), F.col("dst").alias("col"), F.lit(1.0).alias("val"))
    return ranking.apply_matrix(matrix, vertices.select(F.col("id").alias("pos"), (F.col("id") % 10).cast("double").alias("val")))


@query("spectral_separator")
def _(spark, d):
    vertices, edges = part_graph(spark, d)
    return ranking.separator(vertices, both_ways(edges), 10)


@query("components", LINKS.rstrip() + ", c(id, comp) AS (SELECT p_partkey, p_partkey FROM part UNION SELECT kk.dst, c.comp FROM c JOIN kk ON kk.src = c.id) SELECT id, min(comp) AS comp FROM c GROUP BY 1")
def _(spark, d):
    vertices, edges = link_graph(spark, d)
    return structure.components(vertices, edges.select("src", "dst"))


@query("part_components", COMPONENTS)
def _(spark, d):
    vertices, edges = part_graph(spark, d)  # all edges; the recursive SQL is only quick on the links
    return structure.components(vertices, edges)


@query("spanning_forest", forest_sql(EDGES.rstrip() + ", k AS (SELECT src * 1000000000 + dst AS eid, src, dst, 0 AS w FROM e)", "eid, src, dst"))
def _(spark, d):
    vertices, edges = part_graph(spark, d)
    numbered = edges.withColumn("eid", F.col("src") * 1_000_000_000 + F.col("dst"))
    return structure.spanning_forest(vertices, numbered)


@query("minimum_spanning_forest", forest_sql(EDGES.rstrip() + ", k AS (SELECT src * 1000000000 + dst AS eid, src, dst, (src * 7 + dst * 13) % 50 AS w FROM e)", "eid, src, dst, w"))
def _(spark, d):
    vertices, edges = part_graph(spark, d)
    weighted = edges.withColumn("eid", F.col("src") * 1_000_000_000 + F.col("dst")).withColumn("w", F.pmod(F.col("src") * 7 + F.col("dst") * 13, F.lit(50)))
    return structure.minimum_forest(vertices, weighted)


@query("core_numbers", CORES)
def _(spark, d):
    return structure.core_numbers(*part_graph(spark, d))


@query("independent_set", INDEPENDENT + "SELECT id, chosen FROM s")
def _(spark, d):
    vertices, edges = whole_graph(spark, d)
    return structure.independent_set(vertices, edges)


@query("matching", MATCHING + "SELECT eid, src, dst FROM m WHERE eid >= 0")
def _(spark, d):
    return structure.matching(whole_graph(spark, d)[1])


@query("colouring", COLOURS)
def _(spark, d):
    vertices, edges = whole_graph(spark, d)
    return structure.colouring(vertices, edges)


@query("set_cover", COVER)
def _(spark, d):
    return structure.set_cover(table(spark, d, "lineitem").select(F.col("l_suppkey").alias("set"), F.col("l_partkey").alias("element")))


@query("max_flow", "SELECT CAST(sum(least(c, 2 * s)) AS BIGINT) AS flow FROM (SELECT c_nationkey AS n, count(*) AS c FROM customer GROUP BY 1) JOIN (SELECT s_nationkey AS n, count(*) AS s FROM supplier GROUP BY 1) USING (n)")
def _(spark, d):
    """From regions' customers to suppliers: a region gives as many as it has customers, a nation takes as many as twice its suppliers."""
    nation = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("n"), F.col("n_regionkey").cast("long").alias("r"))
    customers = table(spark, d, "customer").groupBy(F.col("c_nationkey").cast("long").alias("n")).count()
    suppliers = table(spark, d, "supplier").groupBy(F.col("s_nationkey").cast("long").alias("n")).count()
    arcs = nation.join(customers, "n").groupBy("r").agg(F.sum("count").alias("cap")).select(F.lit(-1).cast("long").alias("src"), (F.col("r") + 1000).alias("dst"), "cap")
    arcs = arcs.unionByName(nation.join(customers, "n").select((F.col("r") + 1000).alias("src"), F.col("n").alias("dst"), F.col("count").alias("cap")))
    arcs = arcs.unionByName(nation.join(suppliers, "n").select(F.col("n").alias("src"), F.lit(-2).cast("long").alias("dst"), (2 * F.col("count")).alias("cap")))
    return spark.createDataFrame([(structure.max_flow(arcs, -1, -2),)], "flow long")


def _weighted(spark, d):
    vertices, edges = part_graph(spark, d)
    return vertices, both_ways(edges).withColumn("w", F.lit(1.0)), vertices.select("id", (F.col("id") % 10).alias("comm"))


_WHOLE = EDGES.rstrip() + ", w AS (SELECT count(*) AS m2 FROM h), k AS (SELECT src AS id, count(*) AS k FROM h GROUP BY 1) "


@query("modularity", _WHOLE + "SELECT round(sum(i / m2 - (t / m2) * (t / m2)), 9) AS modularity FROM (SELECT src % 10 AS c, CAST(count(*) AS DOUBLE) AS t, CAST(count(*) FILTER (src % 10 = dst % 10) AS DOUBLE) AS i FROM h GROUP BY 1), w")
def _(spark, d):
    _, edges, comm = _weighted(spark, d)
    return community.modularity(edges, comm).select(F.round("modularity", 9).alias("modularity"))


@query("adjacent_quality", _WHOLE + "SELECT round(sum((1 - CAST(a.k AS DOUBLE) * b.k / m2) / m2), 9) AS quality FROM h JOIN k a ON a.id = src JOIN k b ON b.id = dst, w WHERE src % 10 = dst % 10")
def _(spark, d):
    _, edges, comm = _weighted(spark, d)
    return community.adjacent_quality(edges, comm).select(F.round("quality", 9).alias("quality"))


@query("neighbour_communities", EDGES + "SELECT id, comm, CAST(sum(w) AS DOUBLE) AS w FROM (SELECT src AS id, dst % 10 AS comm, 1 AS w FROM h UNION ALL SELECT p_partkey, p_partkey % 10, 0 FROM part) GROUP BY 1, 2")
def _(spark, d):
    _, edges, comm = _weighted(spark, d)
    return community.neighbour_communities(edges, comm)


@query("contraction", EDGES + "SELECT src % 10 AS src, dst % 10 AS dst, CAST(count(*) AS DOUBLE) AS w FROM h GROUP BY 1, 2")
def _(spark, d):
    _, edges, comm = _weighted(spark, d)
    return community.contract(edges, comm)


@query("communities_one_level")
def _(spark, d):
    vertices, edges = whole_graph(spark, d)
    half = both_ways(edges.select("src", "dst", (F.col("w") + 1.0).alias("w")))
    return community.one_level(half, vertices.select("id", F.col("id").alias("comm")))[0]


@query("communities_multi_level")
def _(spark, d):
    vertices, edges = whole_graph(spark, d)
    half = both_ways(edges.select("src", "dst", (F.col("w") + 1.0).alias("w")))
    return community.compose(community.multi_level(vertices, half)[0])


def _parts(spark, d) -> int:
    return table(spark, d, "part").count()


@query("generate_grid", "WITH n AS (SELECT CAST(floor(sqrt(count(*))) AS BIGINT) AS n FROM part) SELECT i AS src, (i // n + a) * n + i % n + b AS dst FROM n, generate_series(0, (SELECT n * n - 1 FROM n)) g(i), generate_series(-1, 1) x(a), generate_series(-1, 1) y(b) WHERE (a <> 0 OR b <> 0) AND i // n + a BETWEEN 0 AND n - 1 AND i % n + b BETWEEN 0 AND n - 1")
def _(spark, d):
    """About as many vertices as there are parts."""
    return generators.grid(spark, math.isqrt(_parts(spark, d)))


@query("generate_lattice", "WITH n AS (SELECT count(*) AS n FROM part) SELECT i AS src, i + k AS dst FROM n, generate_series(0, (SELECT n - 1 FROM n)) g(i), generate_series(1, 5) x(k) WHERE i + k < n")
def _(spark, d):
    return generators.watts_strogatz(spark, _parts(spark, d), 10, 0.0)


@query("generate_rmat")
def _(spark, d):
    """Twenty draws for each part."""
    n = _parts(spark, d)
    return generators.rmat(spark, 1 << max(1, (n - 1).bit_length()), 20 * n)


@query("generate_block_model")
def _(spark, d):
    n = _parts(spark, d)
    return generators.block_model(spark, n, 20, min(1.0, 100 / n), min(1.0, 4 / n))


@query("generate_uniform")
def _(spark, d):
    return generators.uniform_digraph(spark, _parts(spark, d), 8)


@query("generated_sizes", "SELECT 10 + (n - 5) * 3 AS preferential, n * 5 - 15 AS small_world, n * n > 0 AS block_model, n > 0 AS uniform, n > 0 AS rmat FROM (SELECT count(*) AS n FROM part)")
def _(spark, d):
    """Edges of graphs of as many vertices as there are parts: fixed by the parameters for the first two,
    within six standard deviations of the mean, or the draws, for the others."""
    n = _parts(spark, d)
    count = lambda df: df.select("src", "dst").distinct().count()
    inner = sum(len(range(b, n, 20)) * (len(range(b, n, 20)) - 1) / 2 for b in range(20))
    p_in, p_out = min(1.0, 100 / n), min(1.0, 4 / n)
    mean, most = p_in * inner + p_out * (n * (n - 1) / 2 - inner), lambda m: 6 * m**0.5
    got = (
        count(generators.barabasi_albert(spark, n, 5, 3)), count(generators.watts_strogatz(spark, n, 10, 0.1)), abs(count(generators.block_model(spark, n, 20, p_in, p_out)) - mean) < most(mean),
        abs(count(generators.uniform_digraph(spark, n, 8)) - 8 * n) < most(8 * n), 5 * n < count(generators.rmat(spark, 1 << max(1, (n - 1).bit_length()), 20 * n)) <= 20 * n,
    )
    return spark.createDataFrame([got], "preferential long, small_world long, block_model boolean, uniform boolean, rmat boolean")


@query("generate_preferential")
def _(spark, d):
    return generators.barabasi_albert(spark, _parts(spark, d), 5, 3)


@query("generate_small_world")
def _(spark, d):
    return generators.watts_strogatz(spark, _parts(spark, d), 10, 0.1)
