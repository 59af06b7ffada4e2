"""Operators against hand-computed cases and plain loops."""

import heapq
import itertools
import math
import struct
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.functions import numeric, text
from seqloom.operators import community, graphs, grouping, learning, ordered, ranking, scans, sorting, spatial, structure, traversal
from seqloom.sources import files, generators

PAIRS = [(3, 35), (1, 13), (3, 35), (2, 22), (2, 29), (3, 35), (2, 21), (2, 20), (1, 19), (2, 21), (1, 10)]


def seq(spark, values, kind="long"):
    return spark.createDataFrame(list(enumerate(values)), f"pos long, val {kind}")


def values(df):
    return [r["val"] for r in df.orderBy("pos").collect()]


@pytest.fixture()
def small_blocks(monkeypatch):
    monkeypatch.setattr(ordered, "BLOCK", 7)


@pytest.fixture()
def pairs(spark):
    return spark.createDataFrame([(i, k, v) for i, (k, v) in enumerate(PAIRS)], "pos long, k long, v long")


def test_groups(spark, pairs):
    assert {r["k"]: r["vals"] for r in grouping.group_by_key(pairs).collect()} == {1: [13, 19, 10], 2: [22, 29, 21, 20, 21], 3: [35, 35, 35]}
    assert {r["k"]: r["s"] for r in grouping.reduce_by_key(pairs, F.sum("v").alias("s")).collect()} == {1: 42, 2: 113, 3: 105}
    dense = grouping.by_index(spark, 4, pairs, F.sum("v"), F.lit(0).cast("long")).orderBy("k")
    assert [r["val"] for r in dense.collect()] == [0, 42, 113, 105]
    with pytest.raises(ValueError):
        grouping.by_index(spark, 3, pairs, F.sum("v"), F.lit(0))


def test_keyed_table(spark, pairs):
    t = grouping.KeyedTable.of(pairs)
    assert {r["k"]: r["v"] for r in t.df.collect()} == {1: 13, 2: 22, 3: 35}
    t = t.remove(spark.createDataFrame([(1,)], "k long")).insert(spark.createDataFrame([(0, 1, 99), (1, 2, 98)], "pos long, k long, v long"))
    assert {r["k"]: r["v"] for r in t.df.collect()} == {1: 99, 2: 22, 3: 35} and t.size() == 3
    assert t.find(spark.createDataFrame([(7,)], "k long")).first()["v"] is None


def test_rank_breaks_ties_by_position(spark):
    v = [0, 1, 0, 1, 2, 3, 2, 3, 4, 5, 4, 5, 6, 7, 6, 7, 8, 9, 8, 9]
    got = [r["rank"] for r in sorting.rank(seq(spark, v)).orderBy("pos").collect()]
    assert got == [0, 2, 1, 3, 4, 6, 5, 7, 8, 10, 9, 11, 12, 14, 13, 15, 16, 18, 17, 19]


def test_scans_across_blocks(spark, small_blocks):
    v = [(50021 * i + 61) % 1000 for i in range(100)]
    s = seq(spark, v).repartition(5)
    assert values(scans.scan(s)) == [0, *itertools.accumulate(v)][:-1]
    assert values(scans.scan(s, inclusive=True)) == list(itertools.accumulate(v))
    assert values(scans.scan(s, "max", True)) == list(itertools.accumulate(v, max))
    assert values(scans.scan(s, "min"))[0] is None
    assert scans.scan(s.limit(0)).count() == 0
    w = [x - 500 for x in v]
    best = max(sum(w[i:j]) for i in range(100) for j in range(i + 1, 101))
    assert scans.max_subsequence_sum(seq(spark, w)).first()["mcss"] == best
    assert scans.max_subsequence_sum(seq(spark, [-5, -2, -9])).first()["mcss"] == -2


def test_neighbours_across_blocks(spark, small_blocks):
    got = ordered.neighbours(seq(spark, range(30)), "val").orderBy("pos").collect()
    assert [r["prev_val"] for r in got] == [None, *range(29)] and [r["next_val"] for r in got] == [*range(1, 30), None]


def test_split_keeps_the_empty_last_piece(spark):
    s = seq(spark, [1] * 99)
    got = ordered.piece_sizes(s, F.col("pos") % 10 == 9).orderBy("piece").collect()
    assert [r["size"] for r in got] == [10] * 9 + [9]
    got = ordered.piece_sizes(seq(spark, [1] * 20), F.col("pos") % 10 == 9).orderBy("piece").collect()
    assert [r["size"] for r in got] == [10, 10, 0]


def test_searches(spark):
    s = seq(spark, [1, 2, 1, 2, 1])
    p = seq(spark, [1, 2, 1])
    assert ordered.search(s, p).first()["pos"] == 0 and ordered.search(s, p, last=True).first()["pos"] == 2
    assert ordered.search(s, p.limit(0)).first()["pos"] == 0 and ordered.search(s, p.limit(0), last=True).first()["pos"] == 5
    assert ordered.search(s, seq(spark, [3])).first()["pos"] == 5
    assert not ordered.lexicographical_compare(s, p).first()["result"] and ordered.lexicographical_compare(p, s).first()["result"]
    assert ordered.equal(s, s).first()["result"] and not ordered.equal(s, p).first()["result"] and ordered.equal(s.limit(0), s.limit(0)).first()["result"]
    assert ordered.quantifiers(s.limit(0), F.col("val") > 0).first().asDict() == {"count_if": 0, "all_of": True, "any_of": False, "none_of": True}
    assert ordered.adjacent_find(seq(spark, [1, 2, 2]), F.col("val") == F.col("next_val")).first()["pos"] == 1


def test_unique_is_adjacent_only(spark):
    assert values(grouping.unique(seq(spark, [1, 1, 2, 2, 1, 1, 3]))) == [1, 2, 1, 3]


def test_kth_smallest(spark):
    v = [(50021 * i + 61) % 4096 for i in range(500)]
    for k in (0, 17, 250, 499):
        assert sorting.kth_smallest(seq(spark, v), k).first()["val"] == sorted(v)[k]
    with pytest.raises(ValueError):
        sorting.kth_smallest(seq(spark, v), 500)


def test_texts(spark):
    t = spark.createDataFrame([("  The quick\tbrown fox  jumps\nover the lazy dog ",)], "t string")
    assert t.select(text.tokens("t").alias("w")).first()["w"] == ["The", "quick", "brown", "fox", "jumps", "over", "the", "lazy", "dog"]
    n = spark.createDataFrame([("-9223372036854775808",), ("+12ab",), ("x",), ("9223372036854775807 ",)], "t string").select(text.to_integer("t").alias("n"))
    assert [r["n"] for r in n.collect()] == [-(1 << 63), 12, None, (1 << 63) - 1]
    f = spark.createDataFrame([("3,5e-2z",), (".5",), ("-7",), ("",)], "t string").select(text.to_float("t").alias("n"))
    assert [r["n"] for r in f.collect()] == [0.035, 0.5, -7.0, None]
    d = spark.createDataFrame([("abc", "axc"), ("", "ab"), ("kitten", "sitting"), (None, "a")], "a string, b string").select(text.edit_distance(F.col("a"), F.col("b")).alias("d"))
    assert [r["d"] for r in d.collect()] == [2, 2, 5, None]
    o = spark.createDataFrame([("aaaa ana banana",)], "t string")
    assert o.select(text.find_all(F.col("t"), "ana").alias("x")).first()["x"] == [5, 10, 12]
    assert o.select(text.find_all(F.col("t"), "na ").alias("x")).first()["x"] == [6] and o.select(text.find_all(F.col("t"), "").alias("x")).first()["x"] == []


def test_suffixes(spark):
    word = "mississippi$abracadabra"
    s = seq(spark, [ord(c) for c in word])
    order = sorted(range(len(word)), key=lambda i: word[i:])
    found = text.suffix_array(s)
    assert [r["pos"] for r in found.orderBy("rank").collect()] == order
    shared = [len(list(itertools.takewhile(lambda p: p[0] == p[1], zip(word[a:], word[b:], strict=False)))) for a, b in itertools.pairwise(order)]
    assert [r["lcp"] for r in text.lcp(s, found).orderBy("rank").collect()] == shared
    r = text.longest_repeat(s).first()
    assert r["length"] == max(shared) and word[r["first"] :][: r["length"]] == word[r["second"] :][: r["length"]]
    assert text.contains(s, seq(spark, [ord(c) for c in "ssi"])).first()["pos"] == 2 and text.contains(s, seq(spark, [1])).first()["pos"] == -1


def test_cartesian_tree(spark):
    v = [4, 2, 7, 1, 3, 3, 5]
    got = {r["pos"]: r["parent"] for r in text.cartesian_tree(seq(spark, v)).collect()}
    assert got == {0: 1, 1: 3, 2: 1, 3: 3, 4: 3, 5: 4, 6: 5}


def test_huffman(spark):
    w = spark.createDataFrame([("a", 45), ("b", 13), ("c", 12), ("d", 16), ("e", 9), ("f", 5)], "symbol string, weight long")
    assert {r["symbol"]: r["length"] for r in text.huffman_lengths(w).collect()} == {"a": 1, "b": 3, "c": 3, "d": 3, "e": 4, "f": 4}


def test_numbers(spark):
    a, b = str(3**200), str(-(7**150))
    df = spark.createDataFrame([(a, b)], "a string, b string")
    r = df.select(numeric.big_add(F.col("a"), F.col("b")).alias("s"), numeric.big_multiply(F.col("a"), F.col("b")).alias("p"), numeric.big_subtract(F.col("a"), F.col("b")).alias("d")).first()
    assert (int(r["s"]), int(r["p"]), int(r["d"])) == (3**200 - 7**150, -(3**200) * 7**150, 3**200 + 7**150)
    x = np.random.default_rng(1).random(16)
    f = numeric.fft(seq(spark, x.tolist(), "double").withColumn("g", F.lit(1)), "g").orderBy("pos").collect()
    assert np.allclose([complex(r["re"], r["im"]) for r in f], np.fft.fft(x))
    assert [r["p"] for r in numeric.primes(spark, 30).orderBy("p").collect()] == [2, 3, 5, 7, 11, 13, 17, 19, 23, 29] and numeric.primes(spark, 1).count() == 0
    v = np.random.default_rng(2).integers(0, 50, 200).tolist()
    q = spark.createDataFrame([(0, 0, 199), (1, 5, 5), (2, 30, 160)], "q long, i long, j long")
    got = {r["q"]: r["pos"] for r in numeric.range_min(seq(spark, v), q, block=16).collect()}
    assert got == {k: min(range(i, j + 1), key=lambda t: (v[t], t)) for k, i, j in [(0, 0, 199), (1, 5, 5), (2, 30, 160)]}
    assert numeric.cycle_count(seq(spark, [1, 2, 0, 4, 3, 5])) == 3


# graphs


def graph(spark, n, edges):
    return spark.range(n), spark.createDataFrame([(i, a, b, w) for i, (a, b, w) in enumerate(edges)], "eid long, src long, dst long, w long")


def both(edges):
    return edges.select("src", "dst", "w").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))


@pytest.fixture(scope="module")
def random_graph(spark):
    rng = np.random.default_rng(5)
    e = sorted({(int(min(a, b)), int(max(a, b))) for a, b in rng.integers(0, 60, (130, 2)) if a != b})
    edges = [(a, b, int(rng.integers(1, 20))) for a, b in e]
    v, df = graph(spark, 60, edges)
    return edges, v, df.cache()


def neighbours_of(edges, n=60):
    out = {i: {} for i in range(n)}
    for a, b, w in edges:
        out[a][b] = out[b][a] = w
    return out


def dijkstra(adj, s):
    dist, queue = {}, [(0, s)]
    while queue:
        d, v = heapq.heappop(queue)
        if v not in dist:
            dist[v] = d
            for u, w in adj[v].items():
                heapq.heappush(queue, (d + w, u))
    return dist


def test_paths(spark, random_graph):
    edges, v, df = random_graph
    adj = neighbours_of(edges)
    source = spark.createDataFrame([(0,)], "id long")
    assert {r["id"]: r["dist"] for r in traversal.shortest_paths(both(df), source).collect()} == dijkstra(adj, 0)
    unit = dijkstra({k: dict.fromkeys(x, 1) for k, x in adj.items()}, 0)
    rows = traversal.bfs(both(df), source).collect()
    assert {r["id"]: r["dist"] for r in rows} == unit
    assert all(r["parent"] == (0 if r["id"] == 0 else min(u for u in adj[r["id"]] if unit[u] == r["dist"] - 1)) for r in rows)
    loop = spark.createDataFrame([(0, 1, 1), (1, 2, -3), (2, 0, 1)], "src long, dst long, w long")
    with pytest.raises(ValueError):
        traversal.shortest_paths(loop, source)


def test_betweenness(spark, random_graph):
    edges, v, df = random_graph
    adj = neighbours_of(edges)
    dist = dijkstra({k: dict.fromkeys(x, 1) for k, x in adj.items()}, 0)
    sigma, delta = Counter({0: 1.0}), Counter()
    order = sorted(dist, key=dist.get)
    for x in order:
        for u in adj[x]:
            if dist[u] == dist[x] + 1:
                sigma[u] += sigma[x]
    for x in reversed(order):
        for u in adj[x]:
            if dist[u] == dist[x] + 1:
                delta[x] += sigma[x] / sigma[u] * (1 + delta[u])
    for r in traversal.betweenness(both(df), 0).collect():
        assert r["paths"] == sigma[r["id"]] and math.isclose(r["dependency"], 0 if r["id"] == 0 else delta[r["id"]], abs_tol=1e-9)


def test_greedy_structures(spark, random_graph):
    edges, v, df = random_graph
    adj = neighbours_of(edges)
    chosen = set()
    for i in range(60):
        if not chosen & set(adj[i]):
            chosen.add(i)
    assert {r["id"] for r in structure.independent_set(v, df).where("chosen").collect()} == chosen
    used, matched = set(), set()
    for i, (a, b, _) in enumerate(edges):
        if a not in used and b not in used:
            matched.add(i)
            used |= {a, b}
    assert {r["eid"] for r in structure.matching(df).collect()} == matched
    colour = {}
    for i in sorted(range(60), key=lambda i: (-len(adj[i]), i)):
        taken = {colour[u] for u in adj[i] if u in colour}
        colour[i] = next(c for c in itertools.count() if c not in taken)
    assert {r["id"]: r["colour"] for r in structure.colouring(v, df).collect()} == colour
    left, core, k = {i: set(x) for i, x in adj.items()}, {}, 0
    while left:
        k = max(k, min(map(len, left.values())))
        i = min(left, key=lambda i: len(left[i]))
        core[i] = k
        for u in left.pop(i):
            left[u].discard(i)
    assert {r["id"]: r["core"] for r in structure.core_numbers(v, df).collect()} == core


def forest(edges, n=60):
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    out = set()
    for i in sorted(range(len(edges)), key=lambda i: (edges[i][2], i)):
        a, b = root(edges[i][0]), root(edges[i][1])
        if a != b:
            parent[max(a, b)] = min(a, b)
            out.add(i)
    return out, {i: root(i) for i in range(n)}


def test_forests_and_components(spark, random_graph):
    edges, v, df = random_graph
    true, comp = forest(edges)
    assert {r["eid"] for r in structure.minimum_forest(v, df).collect()} == true
    assert {r["eid"] for r in structure.spanning_forest(v, df.drop("w")).collect()} == forest([(a, b, 0) for a, b, _ in edges])[0]
    assert {r["id"]: r["comp"] for r in structure.components(v, df).collect()} == comp


def test_small_graphs(spark):
    _, k4 = graph(spark, 4, [(a, b, 1) for a, b in itertools.combinations(range(4), 2)])
    assert graphs.triangles(k4).count() == 4 and [r["core"] for r in structure.core_numbers(spark.range(4), k4).collect()] == [3] * 4
    v, two = graph(spark, 6, [(0, 1, 1), (1, 2, 1), (0, 2, 1), (3, 4, 1), (4, 5, 1), (3, 5, 1), (2, 3, 1)])
    comm = v.select("id", F.floor(F.col("id") / 3).alias("comm"))
    assert math.isclose(community.modularity(both(two), comm).first()[0], 5 / 14)
    for part in (2, 5, 20):  # the two vertices of degree 3 are in no part; three parts; one
        levels, q = community.multi_level(v, both(two), part=part)
        assert math.isclose(q, 5 / 14) and sorted(Counter(r["comm"] for r in community.compose(levels).collect()).values()) == [3, 3]
        assert community.level_sizes(levels)[-1] == 2
    inner = {(r["src"], r["dst"]): r["w"] for r in community.contract(both(two), comm).collect()}
    assert inner == {(0, 0): 6, (1, 1): 6, (0, 1): 1, (1, 0): 1}
    path = graph(spark, 4, [(0, 1, 1), (1, 2, 1), (2, 3, 1)])
    assert {r["id"] for r in structure.independent_set(*path).where("chosen").collect()} == {0, 2}


def test_communities_recover_blocks(spark):
    v = spark.range(200)
    half = both(generators.block_model(spark, 200, 4, 0.4, 0.01).withColumn("eid", F.lit(0)))
    planted = community.modularity(half, v.select("id", (F.col("id") % 4).alias("comm"))).first()[0]
    # vertices of more than 18 links are in no part; three parts; one
    for part in (18, half.count() // 3 + 1, community.PART):
        levels, q = community.multi_level(v, half, part=part)
        last = community.compose(levels)
        assert q > 0.9 * planted and math.isclose(q, community.modularity(half, last).first()[0], abs_tol=1e-9)
        assert last.count() == 200 == last.select("id").distinct().count()


def test_one_level_from_given_communities(spark):
    v, two = graph(spark, 7, [(0, 1, 1), (1, 2, 1), (0, 2, 1), (3, 4, 1), (4, 5, 1), (3, 5, 1), (2, 3, 1)])
    start = v.select("id", (F.when(F.col("id") < 3, 90).otherwise(F.col("id") + 50)).cast("long").alias("comm"))
    comm, q = community.one_level(both(two), start)
    got = {r["id"]: r["comm"] for r in comm.collect()}
    assert math.isclose(q, 5 / 14) and {got[i] for i in (0, 1, 2)} == {90} and len({got[i] for i in (3, 4, 5)}) == 1 and got[6] == 56
    alone, q = community.one_level(both(two).where("w < 0"), start)  # no links: nothing moves
    assert q == 0 and {r["id"]: r["comm"] for r in alone.collect()} == {r["id"]: r["comm"] for r in start.collect()}
    none, q = community.multi_level(v.where("id < 0"), both(two).where("w < 0"))
    assert q == 0 and community.compose(none).count() == 0


def test_average_difference(spark):
    a, b = (spark.createDataFrame(rows, "id long, rank double") for rows in ([(1, 0.5), (2, 0.5)], [(2, 0.25), (3, 0.75)]))
    got = ranking.average_difference(a, b).first()
    assert math.isclose(got[0], (0.5 + 0.25 + 0.75) / 3) and got[1] == 0.75
    assert ranking.average_difference(a, a).first()[0] == 0 and ranking.average_difference(a.limit(0), b.limit(0)).first()[0] is None


def test_pagerank(spark, random_graph):
    edges, v, _ = random_graph
    directed = spark.createDataFrame([(a, b) for a, b, _ in edges], "src long, dst long")
    out = Counter(a for a, _, _ in edges)
    rank = np.full(60, 1 / 60)
    for i in range(1, 101):
        new = np.full(60, 0.15 / 60 + 0.85 * sum(rank[x] for x in range(60) if not out[x]) / 60)
        for a, b, _ in edges:
            new[b] += 0.85 * rank[a] / out[a]
        done = np.abs(new - rank).sum() < 1e-6
        rank = new
        if done:
            break
    got, rounds = ranking.pagerank(v, directed)
    assert rounds == i and np.allclose([r["rank"] for r in got.orderBy("id").collect()], rank)
    side = ranking.separator(v, graphs.symmetrize(directed), 5).collect()
    assert 20 <= sum(r["side"] for r in side) <= 30 + 10


def test_flow_and_cover(spark):
    arcs = [(0, 1, 16), (0, 2, 13), (1, 2, 10), (2, 1, 4), (1, 3, 12), (3, 2, 9), (2, 4, 14), (4, 3, 7), (3, 5, 20), (4, 5, 4)]
    assert structure.max_flow(spark.createDataFrame(arcs, "src long, dst long, cap long"), 0, 5) == 23
    rng = np.random.default_rng(3)
    sets = spark.createDataFrame([(int(a), int(b)) for a, b in rng.integers(0, 40, (200, 2))], "set long, element long")
    cover = structure.set_cover(sets)
    assert sets.join(cover, "set").select("element").distinct().count() == sets.select("element").distinct().count()


def test_le_lists(spark, random_graph):
    edges, v, df = random_graph
    unit = {k: dict.fromkeys(x, 1) for k, x in neighbours_of(edges).items()}
    far = {u: dijkstra(unit, u) for u in range(60)}
    true = set()
    for x in range(60):
        best = math.inf
        for u in range(60):
            if far[u].get(x, math.inf) < best:
                best = far[u][x]
                true.add((x, u, best))
    assert {(r["id"], r["u"], r["dist"]) for r in traversal.le_lists(both(df), v).collect()} == true
    centers = {r["id"]: r["center"] for r in traversal.low_diameter(both(df), v).collect()}
    assert set(centers) == set(range(60)) and all(far[c].get(x) is not None for x, c in centers.items())


# points and learning


@pytest.fixture(scope="module")
def cloud():
    return np.random.default_rng(8).integers(0, 100, (80, 3)).astype(float)


def points_of(spark, x):
    return spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(x)], "id long, x double, y double, z double")


def test_near_points(spark, cloud):
    pts = points_of(spark, cloud)
    d2 = ((cloud[:, None] - cloud[None]) ** 2).sum(axis=2)
    true = {(i, j) for i in range(80) for j in range(80) if i != j and d2[i, j] < 400}
    assert {(r["id"], r["other"]) for r in spatial.radius_pairs(pts, 20.0).collect()} == true
    got = {}
    for r in spatial.nearest_neighbours(pts, 5).orderBy("id", "rank").collect():
        got.setdefault(r["id"], []).append(r["other"])
    assert got == {i: sorted((j for j in range(80) if j != i), key=lambda j: (d2[i, j], j))[:5] for i in range(80)}
    assert spatial.nearest_neighbours(points_of(spark, cloud[:3]), 5).count() == 6 and spatial.nearest_neighbours(points_of(spark, cloud[:1]), 5).count() == 0


def test_boxes_and_hull(spark, cloud):
    boxes = [(i, *(c for a in p for c in (float(a), float(a) + 5 + i % 20))) for i, p in enumerate(cloud)]
    df = spark.createDataFrame(boxes, "id long, xlo double, xhi double, ylo double, yhi double, zlo double, zhi double")
    true = {(a[0], b[0]) for a, b in itertools.combinations(boxes, 2) if all(a[k] < b[k + 1] and b[k] < a[k + 1] for k in (1, 3, 5))}
    assert {(r["i"], r["j"]) for r in spatial.box_overlaps(df, 25.0).collect()} == true
    hull = [(r["x"], r["y"]) for r in spatial.upper_hull(points_of(spark, cloud)).collect()]
    assert hull == sorted(hull) and all((bx - ax) * (c[1] - ay) - (by - ay) * (c[0] - ax) <= 1e-9 for (ax, ay), (bx, by) in itertools.pairwise(hull) for c in cloud if ax <= c[0] <= bx)


def test_rays_forces_and_programs(spark, cloud):
    rays = spark.createDataFrame([(0, [0.2, 0.2, -1.0], [0.0, 0.0, 1.0]), (1, [5.0, 5.0, -1.0], [0.0, 0.0, 1.0])], "ray long, o array<double>, d array<double>")
    tris = spark.createDataFrame([(7, [0.0, 0.0, 2.0], [1.0, 0.0, 2.0], [0.0, 1.0, 2.0]), (8, [0.0, 0.0, 1.0], [1.0, 0.0, 1.0], [0.0, 1.0, 1.0])], "tri long, a array<double>, b array<double>, c array<double>")
    assert [(r["ray"], r["tri"], r["t"]) for r in spatial.ray_cast(rays, tris).orderBy("ray").collect()] == [(0, 8, 2.0), (1, None, None)]
    got = spatial.total_forces(points_of(spark, cloud).withColumn("mass", F.lit(2.0)), block=16).orderBy("id").collect()
    d = cloud[None] - cloud[:, None]
    r2 = (d**2).sum(axis=2)
    true = (d * np.where(r2 > 0, 2 * np.maximum(r2, 1e-300) ** -1.5, 0)[:, :, None]).sum(axis=1)
    assert np.allclose([[r["fx"], r["fy"], r["fz"]] for r in got], true)
    rows = spark.createDataFrame([(1.0, 0.0, 4.0), (0.0, 2.0, 12.0), (3.0, 2.0, 18.0), (-1.0, 0.0, 0.0), (0.0, -1.0, 0.0)], "a double, b double, c double")
    assert np.allclose(spatial.linear_program(rows, 3.0, 5.0), (2, 6)) and spatial.linear_program(rows.where("c = 4"), 0.0, 1.0)[0] == math.inf


def test_delaunay(spark, cloud):
    pts = np.unique(cloud[:40, :2], axis=0) + np.random.default_rng(1).random((len(np.unique(cloud[:40, :2], axis=0)), 2)) * 0.01
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(pts)], "id long, x double, y double")
    mesh = [(r["a"], r["b"], r["c"]) for r in spatial.delaunay(df).collect()]
    for t in mesh:
        (ax, ay), (bx, by), (cx, cy) = pts[list(t)]
        m = np.linalg.solve([[bx - ax, by - ay], [cx - ax, cy - ay]], [(bx**2 - ax**2 + by**2 - ay**2) / 2, (cx**2 - ax**2 + cy**2 - ay**2) / 2])
        r2 = ((m - pts[t[0]]) ** 2).sum()
        assert (((pts - m) ** 2).sum(axis=1) >= r2 * (1 - 1e-7)).all()
    assert len(mesh) > len(pts)


def test_learning(spark):
    rng = np.random.default_rng(4)
    centers = np.array([[0, 0], [5, 5], [0, 5]])
    x = np.concatenate([c + rng.normal(size=(40, 2)) * 0.3 for c in centers])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>")
    found, _ = learning.kmeans(df, 3)
    assert np.allclose(sorted(map(tuple, found.round())), sorted(map(tuple, centers.astype(float))), atol=0.6)
    rows = spark.createDataFrame([(int(a), int(b), int((a > 100) != (b == 1))) for a, b in zip(rng.integers(0, 256, 400), rng.integers(0, 3, 400), strict=True)], "f0 int, f1 int, label int")
    nodes = learning.decision_tree(rows, {"f0": "i", "f1": "d"}, "label")
    assert learning.classify(rows, nodes).where("label <> predicted").count() <= 8
    y = spark.createDataFrame([(float(a), float(b), float(3.0 * a + 0.001 * b)) for a, b in rng.normal(size=(300, 2))], "a double, b double, y double")
    w = learning.lasso(y, ["a", "b"], "y", 20.0)
    assert 2.8 < w[0] < 3 and w[1] == 0


# files


def test_edge_lists(spark, tmp_path, random_graph):
    edges, v, df = random_graph
    files.write_edge_list(v, df, str(tmp_path / "g"))
    n, back = files.read_edge_list(spark, str(tmp_path / "g"), directed=True)
    assert n.count() == 60 and Counter(map(tuple, back.collect())) == Counter((a, b) for a, b, _ in edges)
    (tmp_path / "short.txt").write_text("3 2\n0 1\n")
    with pytest.raises(ValueError):
        files.read_edge_list(spark, str(tmp_path / "short.txt"))
    (tmp_path / "w.txt").write_text("0 1 0.5\n1 1 0.25\n")
    assert sorted(map(tuple, files.read_triples(spark, str(tmp_path / "w.txt"))[1].collect())) == [(0, 1, 0.5), (1, 0, 0.5), (1, 1, 0.25)]


def test_binary_and_delta(spark, tmp_path, random_graph):
    edges, v, df = random_graph
    half = both(df).select("src", "dst", F.col("w").cast("float").alias("w"))
    files.write_csr(v, half, str(tmp_path / "csr"))
    assert Counter(map(tuple, files.read_csr(spark, str(tmp_path / "csr")).collect())) == Counter(map(tuple, half.collect()))
    (tmp_path / "raw.bin").write_bytes(struct.pack("<I3Q3I", 3, 1, 2, 3, 1, 2, 0))
    assert sorted((r["src"], r["dst"]) for r in files.read_csr_files(spark, str(tmp_path / "raw.bin")).collect()) == [(0, 1), (1, 2), (2, 0)]
    files.write_delta(v, half.select("src", "dst"), str(tmp_path / "delta"))
    assert Counter(map(tuple, files.read_delta(spark, str(tmp_path / "delta")).collect())) == Counter(map(tuple, half.select("src", "dst").collect()))
    (tmp_path / "adj.txt").write_text("AdjacencyGraph\n3\n4\n0\n2\n2\n1\n2\n0\n1\n")
    assert sorted(map(tuple, files.read_adjacency(spark, str(tmp_path / "adj.txt")).collect())) == [(0, 1), (0, 2), (2, 0), (2, 1)]


def test_conversions_and_results(spark, tmp_path):
    (tmp_path / "a.txt").write_text("0 1 0.5\n0 1 0.25\n")
    files.convert_triples(spark, [str(tmp_path / "a.txt")], str(tmp_path / "out"))
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out" / "a")).collect())) == [(0, 1, 0.75), (1, 0, 0.75)]
    files.write_results(spark.createDataFrame([("b", 2), ("a", 1)], "graph string, n long"), str(tmp_path / "r"), "graph")
    assert files.read_chars(spark, str(next((tmp_path / "r").glob("*.csv")))).first()["value"] == "graph,n\na,1\nb,2\n"


def test_lower_bound(spark):
    got = ordered.lower_bound(seq(spark, [1, 3, 3, 7]), spark.createDataFrame([(k,) for k in (0, 1, 3, 3, 4, 9)], "key long")).collect()
    assert {r["key"]: r["pos"] for r in got} == {0: 0, 1: 0, 3: 1, 4: 3, 9: 4}


def test_other_files(spark, tmp_path):
    comm = spark.createDataFrame([(2, 0), (0, 0), (1, 5)], "id long, comm long")
    assert [r["value"] for r in files.community_lines(comm).collect()] == ["0 2 ", "1 "] and [r["value"] for r in files.partition_lines(comm).collect()] == ["0 0", "1 5", "2 0"]
    (tmp_path / "tree").write_text("0 0\n1 0\n2 1\n0 0\n1 0\n")
    assert sorted(map(tuple, files.read_hierarchy(spark, str(tmp_path / "tree")).collect())) == [(0, 0, 0), (0, 1, 0), (0, 2, 1), (1, 0, 0), (1, 1, 0)]
    (tmp_path / "f.csv").write_text("d,i,d\n1,200,0\n2,3,1\n")
    rows, kinds = files.read_features(spark, str(tmp_path / "f.csv"))
    assert kinds == {"f0": "d", "f1": "i"} and sorted(map(tuple, rows.collect())) == [(0, 1, 200), (1, 2, 3)]
    (tmp_path / "bad.csv").write_text("d,i\n1,256\n")
    with pytest.raises(ValueError):
        files.read_features(spark, str(tmp_path / "bad.csv"))
    (tmp_path / "m.txt").write_text("1.5 2.5\n1 9\n4 8\n")
    y, a = files.read_sparse_regression(spark, str(tmp_path / "m.txt"), 2)
    assert sorted(map(tuple, y.collect())) == [(0, 1.5), (1, 2.5)] and sorted(map(tuple, a.collect())) == [(0, 0, 9.0), (1, 1, 8.0)]
    (tmp_path / "t.txt").write_text("Words, words, words\nAnother line")
    assert files.read_chars(spark, str(tmp_path / "t.txt")).first()["value"] == "Words, words, words\nAnother line" and files.read_chars(spark, str(tmp_path / "t.txt"), 7, 12).first()["value"] == "words"
    (tmp_path / "s.tsv").write_text("# note\nname\tseconds\na\t1.5\n")
    assert [tuple(r) for r in files.read_commented_tsv(spark, str(tmp_path / "s.tsv"), "name string, seconds double").collect()] == [("a", 1.5)]


def test_generators(spark):
    assert generators.barabasi_albert(spark, 50, 5, 3).distinct().count() == 145 and generators.barabasi_albert(spark, 100, 10, 3).count() == 315
    assert generators.watts_strogatz(spark, 100, 10, 0.1).count() == 485 and generators.watts_strogatz(spark, 100, 10, 0.0, closed=True).count() == 500
    moved = {(min(r), max(r)) for r in map(tuple, generators.watts_strogatz(spark, 100, 10, 0.5).collect())}
    assert len(moved) == 485 and all(a != b for a, b in moved)
    assert abs(generators.uniform_digraph(spark, 400, 10).count() - 4000) < 400
    r = generators.rmat(spark, 256, 2000)
    assert r.count() == r.distinct().count() and r.where("src >= 256 or dst >= 256 or src = dst").isEmpty()
    b = generators.block_model(spark, 300, 3, 0.2, 0.02)
    inner, outer = b.where("src % 3 = dst % 3").count(), b.where("src % 3 <> dst % 3").count()
    assert abs(inner - 0.2 * 3 * 4950) < 300 and abs(outer - 0.02 * 30000) < 150 and b.where("w < 0.1 or w >= 1").isEmpty()


def test_rays_meet_the_first_of_all_triangles(spark):
    rng = np.random.default_rng(5)
    corner = rng.uniform(0, 10, (400, 3))
    tris = [(i, *(p.tolist() for p in (c, c + rng.uniform(-2, 2, 3), c + rng.uniform(-2, 2, 3)))) for i, c in enumerate(corner)]
    rays = [(i, rng.uniform(-3, 13, 3).tolist(), d) for i, d in enumerate([[1.0, 0.0, 0.0], [0.0, 0.0, -1.0]] + rng.normal(size=(150, 3)).tolist())]
    true = {}
    for ray, o, d in rays:
        hits = [(math.inf, None)]
        for tri, a, b, c in tris:
            m = np.array([-np.array(d), np.subtract(b, a), np.subtract(c, a)]).T
            t, u, w = np.linalg.solve(m, np.subtract(o, a))
            if u >= 0 and w >= 0 and u + w <= 1 and t > 1e-12:
                hits.append((t, tri))
        true[ray] = min(hits)[1]
    rays = spark.createDataFrame(rays, "ray long, o array<double>, d array<double>")
    tris = spark.createDataFrame(tris, "tri long, a array<double>, b array<double>, c array<double>")
    assert {r["ray"]: r["tri"] for r in spatial.ray_cast(rays, tris).collect()} == true and len(set(true.values())) > 30
    assert all(r["tri"] is None for r in spatial.ray_cast(rays, tris.limit(0)).collect())


def test_for_each_runs_on_every_row(spark):
    from seqloom.operators import ordered

    total = spark.sparkContext.accumulator(0)
    ordered.for_each(spark.range(1000), lambda rows: [total.add(r["id"]) for r in rows] and None)
    assert total.value == 999 * 500


def test_long_chains_settle(spark):
    """A fixpoint does not stop before its state is done."""
    from seqloom.operators import structure

    vertices, edges = spark.range(30), spark.range(29).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    assert {r["id"]: r["chosen"] for r in structure.independent_set(vertices, edges).collect()} == {i: i % 2 == 0 for i in range(30)}


def test_lines_are_numbered_over_splits_and_files(spark, tmp_path):
    """Files of many splits each are numbered as one sequence, in order of their names."""
    texts = {"b.txt": "".join(f"{i}  x{i}\n" for i in range(4000)), "a.txt": "first line\n\n  \nlast\r\n", "c.txt": "no end of line", "d.txt": ""}
    for name, value in texts.items():
        (tmp_path / name).write_bytes(value.encode())
    lines = [x for name in sorted(texts) for x in texts[name].replace("\r\n", "\n").splitlines()]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    try:
        got = files._lines(spark, str(tmp_path)).collect()
        assert sorted(map(tuple, got)) == [(i, x) for i, x in enumerate(lines) if x.strip()]
        numbers = files._numbers(spark, str(tmp_path)).collect()
        assert sorted(map(tuple, numbers)) == list(enumerate(w for x in lines for w in x.split()))
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 8
        edges = spark.createDataFrame([(i, (i * 7) % 500) for i in range(500)], "src long, dst long").where("src <> dst")
        for write, read in ((files.write_edge_list, lambda p: files.read_edge_list(spark, p, directed=True)[1]), (files.write_adjacency, lambda p: files.read_adjacency(spark, p))):
            path = str(tmp_path / write.__name__)
            write(spark.range(500), edges.repartition(6), path)
            assert sorted(map(tuple, read(path).collect())) == sorted(map(tuple, edges.collect()))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_communities_of_nothing(spark):
    nothing = spark.createDataFrame([], "src long, dst long, w double")
    levels, quality = community.multi_level(spark.range(0).select("id"), nothing)
    assert quality == 0.0 and community.compose(levels).count() == 0 and community.level_sizes(levels) == [0, 0]
