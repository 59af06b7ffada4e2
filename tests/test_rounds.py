"""Operators that work in rounds against plain loops, and against the operators whose results they share."""

import heapq
import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from seqloom.operators import covers, forests, frontier, speculation, stepping, structure, traversal


def graph(n, m, seed=1, most=30):
    rng = random.Random(seed)
    pairs = {tuple(sorted(rng.sample(range(n), 2))) for _ in range(m)}
    return [(i, a, b, rng.randrange(most)) for i, (a, b) in enumerate(sorted(pairs))]


def both(edges):
    return [(a, b, w) for _, a, b, w in edges] + [(b, a, w) for _, a, b, w in edges]


@pytest.fixture(scope="module")
def edges():
    return graph(120, 420)


@pytest.fixture(scope="module")
def frames(spark, edges):
    vertices = spark.range(125).select("id")
    return vertices, spark.createDataFrame(edges, "eid long, src long, dst long, w long").repartition(3)


# shortest paths by buckets


def dijkstra(arcs, sources):
    out, near = {}, defaultdict(list)
    for a, b, w in arcs:
        near[a].append((b, w))
    heap = [(0, s, s) for s in sources]
    heapq.heapify(heap)
    while heap:
        d, root, v = heapq.heappop(heap)
        if v in out:
            continue
        out[v] = (d, root)
        for b, w in near[v]:
            heapq.heappush(heap, (d + w, root, b))
    return out


def relaxations_in_rounds(arcs, sources):
    """How many edges are followed if in every round all changed vertices follow all of theirs."""
    near = defaultdict(list)
    for a, b, w in arcs:
        near[a].append((b, w))
    best, changed, n = {s: (0, s) for s in sources}, set(sources), 0
    while changed:
        found = {}
        for v in changed:
            n += len(near[v])
            for b, w in near[v]:
                found[b] = min(found.get(b, (math.inf, 0)), (best[v][0] + w, best[v][1]))
        changed = {b for b, x in found.items() if b not in best or x < best[b]}
        best.update({b: found[b] for b in changed})
    return n


def test_delta_stepping(spark, edges):
    arcs = [(a, b, w * 3) for a, b, w in both(edges)]
    df = spark.createDataFrame([*arcs, (None, 3, 1), (3, None, 1), (4, 5, None)], "src long, dst long, w long")
    sources = spark.createDataFrame([(0,), (7,), (7,), (None,)], "id long")
    got = stepping.delta_stepping(df, sources, delta=45)
    assert {r["id"]: (r["dist"], r["root"]) for r in got.paths.collect()} == dijkstra(arcs, [0, 7])
    assert 0 < got.relaxations < relaxations_in_rounds(arcs, [0, 7]) and got.buckets > 2
    plain = traversal.shortest_paths(df.dropna(), sources.dropna().distinct())
    assert set(map(tuple, plain.select("id", "dist", "root").collect())) == set(map(tuple, got.paths.select("id", "dist", "root").collect()))


def test_delta_stepping_of_doubles_zeros_and_nothing(spark):
    arcs = [(0, 1, 0.0), (1, 2, 0.0), (2, 0, 0.0), (2, 3, 0.5), (0, 3, 0.75), (3, 4, 2.5), (9, 8, 1.0)]
    df = spark.createDataFrame(arcs, "src long, dst long, w double")
    one = spark.createDataFrame([(0,)], "id long")
    for delta in (None, 100.0):
        got = stepping.delta_stepping(df, one, delta)
        assert {r["id"]: (r["dist"], r["root"]) for r in got.paths.collect()} == dijkstra(arcs, [0])
    assert stepping.delta_stepping(df, one.limit(0)).paths.count() == 0
    assert stepping.delta_stepping(df.limit(0), one).paths.count() == 1
    with pytest.raises(ValueError):
        stepping.delta_stepping(df.withColumn("w", -F.col("w")), one)


# direction switching


def test_words_and_blocks(spark):
    ids = [0, 1, 63, 64, 32_767, 32_768, 65_535, 1 << 40, -1, -64, -32_768, -32_769]
    other = [i + d for i in ids for d in (-2, 2, 64)]
    df = spark.createDataFrame([(i,) for i in ids + ids] + [(None,)], "id long")
    set_ = frontier.words(df)
    assert frontier.size(set_) == len(ids)
    asked = spark.createDataFrame([(i,) for i in {*ids, *other}] + [(None,)], "x long")
    maps = frontier.blocks(set_)
    assert {r["x"] for r in frontier.within(asked, "x", maps).collect()} == set(ids)
    assert {r["x"] for r in frontier.within(asked, "x", maps, there=False).collect()} == {*other, None} - set(ids)
    more = frontier.words(spark.createDataFrame([(5,), (0,)], "id long"))
    assert frontier.size(frontier.both(set_, more)) == len(ids) + 1


def test_search_in_both_directions(spark, edges, frames):
    arcs = spark.createDataFrame([(a, b) for a, b, _ in both(edges)], "src long, dst long")
    chain = spark.createDataFrame([x for i in range(300, 305) for x in ((i, i + 1), (i + 1, i))] + [(305, 0), (0, 305)], "src long, dst long")
    every, one = arcs.unionByName(chain), spark.createDataFrame([(300,)], "id long")
    want = set(map(tuple, traversal.bfs(every, one).select("id", "dist", "parent").collect()))
    got = frontier.search(every, one)
    assert set(map(tuple, got.found.collect())) == want
    assert {d for d, _ in got.directions} == {"push", "pull"}
    for share, direction in ((0.0, "pull"), (2.0, "push")):
        only = frontier.search(every, one, share=share)
        assert set(map(tuple, only.found.collect())) == want and {d for d, _ in only.directions} == {direction}
    assert frontier.search(every, one, max_depth=2).found.agg(F.max("dist")).first()[0] == 2
    assert frontier.search(every, one.limit(0)).found.count() == 0


# speculation


def in_order(claims):
    by = defaultdict(list)
    for c in claims:
        by[c[1], c[0]].append(c)
    taken, out = set(), set()
    for (_, item), own in sorted(by.items()):
        if not any(c[3] and c[2] in taken for c in own):
            out.add(item)
            taken |= {c[2] for c in own if c[4]}
    return out


def test_reserve_and_commit_is_trying_in_order(spark):
    for seed in range(2):
        rng = random.Random(seed)
        claims = []
        for i in range(80):
            p = rng.randrange(25)  # priorities tie
            claims.append((i, p, rng.randrange(40), True, rng.random() < 0.5))
            claims += [(i, p, r, rng.random() < 0.6, rng.random() < 0.6) for r in rng.sample(range(40), 2)]
        claims += [(i, 3, 40, True, True) for i in range(200, 240)]  # a resource that many want
        df = spark.createDataFrame(claims, "item long, priority int, resource long, needs boolean, takes boolean")
        got = speculation.reserve(df)
        assert {r["item"] for r in got.committed.collect()} == in_order(claims)
    assert speculation.reserve(df.limit(0)).committed.count() == 0


def test_speculative_matching_set_and_forest(spark, frames):
    vertices, df = frames
    got = speculation.matching(df).committed
    assert {r["item"] for r in got.collect()} == {r["eid"] for r in structure.matching(df).collect()}
    first = speculation.independent_set(vertices, df)
    assert {r["item"] for r in first.committed.collect()} == {r["id"] for r in structure.independent_set(vertices, df).where("chosen").collect()}
    forest = speculation.spanning_forest(vertices, df)
    assert {r["item"] for r in forest.committed.collect()} == {r["eid"] for r in structure.spanning_forest(vertices, df).collect()}


def test_hash_priorities_settle_a_path_in_few_rounds(spark):
    n = 300
    path = spark.range(n - 1).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    got = speculation.independent_set(spark.range(n), path, seed=3)
    chosen = {r["item"] for r in got.committed.collect()}
    assert got.rounds <= 12  # in order of id it takes 150
    assert all(not (i in chosen and i + 1 in chosen) for i in range(n)) and all({i - 1, i, i + 1} & chosen for i in range(n))


# covers


def test_bucketed_cover(spark):
    rng = random.Random(6)
    sets = {f"s{i}": {rng.randrange(400) if rng.random() < 0.5 else rng.randrange(30) for _ in range(rng.choice([1, 2, 5, 20, 60]))} for i in range(250)}
    rows = [(s, e) for s, xs in sets.items() for e in xs]
    df = spark.createDataFrame(rows + rows[:50] + [(None, 1), ("s1", None)], "set string, element long")
    every = set().union(*sets.values())
    left, greedy = set(every), 0
    while left:
        left -= sets[max(sets, key=lambda s: len(sets[s] & left))]
        greedy += 1
    for epsilon in (0.1, 0.5):
        got = covers.bucketed_cover(df, epsilon)
        chosen = [r["set"] for r in got.chosen.orderBy("round").collect()]
        assert len(chosen) == len(set(chosen)) and set().union(*(sets[s] for s in chosen)) == every
        assert len(chosen) <= (1 + epsilon) ** 2 * 1.1 * greedy and len(chosen) <= got.bound * greedy
        assert got.rounds < len(chosen)  # many are chosen at once
        steps = {r["bucket"] for r in got.chosen.collect()}
        assert max(steps) == math.floor(math.log(max(map(len, sets.values())), 1 + epsilon) + 1e-9)
    assert covers.bucketed_cover(df.limit(0)).chosen.count() == 0
    with pytest.raises(ValueError):
        covers.bucketed_cover(df, 0)


# forests


def kruskal(n, edges):
    root, out = list(range(n)), set()

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for e, a, b, _ in sorted(edges, key=lambda x: (x[3], x[0])):
        x, y = find(a), find(b)
        if x != y:
            root[x] = y
            out.add(e)
    return out


def test_filtered_forest(spark, edges, frames):
    vertices, df = frames
    dense = graph(60, 1500, seed=4, most=4)  # few weights: many ties
    for n, es, least in ((125, edges, 150), (60, dense, 100)):
        got = forests.filtered_forest(spark.range(n), spark.createDataFrame(es, "eid long, src long, dst long, w long"), least=least)
        assert {r["eid"] for r in got.forest.collect()} == kruskal(n, es)
        assert all(tuple(r) in set(es) for r in got.forest.collect())
        assert len(got.passes) > 1 and sum(map(sum, got.passes)) == len(es)  # an edge is solved or dropped, once
    light, by_map, _ = map(sum, zip(*got.passes))
    assert by_map > light  # most edges never meet a label
    assert forests.filtered_forest(vertices, df.limit(0)).forest.count() == 0
    assert {r["eid"] for r in forests.filtered_forest(vertices, df).forest.collect()} == {r["eid"] for r in structure.minimum_forest(vertices, df).collect()}
