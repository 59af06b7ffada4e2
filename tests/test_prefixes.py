"""Operators that work through prefixes of an order give what trying one by one gives, in few steps."""

import random

from seqloom.operators import prefixes, speculation


def test_matching_of_a_path_takes_as_many_rounds_as_prefixes(spark):
    n = 600
    path = spark.range(n - 1).selectExpr("id AS eid", "id AS src", "id + 1 AS dst")
    got = speculation.matching(path)
    assert sorted(r["item"] for r in got.committed.collect()) == list(range(0, n - 1, 2)) and got.rounds == 1  # it took 300


def test_claims_are_cut_into_prefixes(spark):
    rng = random.Random(3)
    claims = [(i, rng.randrange(30), r, rng.random() < 0.7, rng.random() < 0.6) for i in range(300) for r in [*rng.sample(range(120), 3), None]]
    free, true = set(), set()
    for p, i in sorted({(c[1], c[0]) for c in claims}):
        own = [c for c in claims if c[:2] == (i, p)]
        if not any(c[3] and c[2] in free for c in own):
            true.add((i, p))
            free |= {c[2] for c in own if c[4] and c[2] is not None}
    df = spark.createDataFrame(claims, "item long, priority int, resource long, needs boolean, takes boolean")
    got, rounds = prefixes.in_order(df, 100)
    assert {(r["item"], r["priority"]) for r in got.collect()} == true and rounds > 5


def test_colours_of_several_prefixes(spark):
    rng = random.Random(4)
    pairs = {tuple(sorted(rng.sample(range(80), 2))) for _ in range(600)} | {(i, i + 1) for i in range(100, 250)}
    near = {i: set() for i in range(260)}
    for a, b in pairs:
        near[a].add(b)
        near[b].add(a)
    colour = {}
    for i in sorted(near, key=lambda i: (-len(near[i]), i)):
        used = {colour.get(j) for j in near[i]}
        colour[i] = next(c for c in range(len(near)) if c not in used)
    edges = spark.createDataFrame([(a, b) if rng.random() < 0.5 else (b, a) for a, b in pairs] + [(3, 3)], "src long, dst long")
    for size in (100, 10_000):
        assert {r["id"]: r["colour"] for r in prefixes.first_free(spark.range(260), edges, size).collect()} == colour
    assert {r["colour"] for r in prefixes.first_free(spark.range(5), edges.limit(0)).collect()} == {0}
    assert prefixes.first_free(spark.range(0), edges).count() == 0


def test_forest_of_a_path_needs_few_jobs_and_rounds_give_the_same(spark):
    from seqloom.operators import forests, structure

    def jobs():
        return spark.sparkContext._jsc.sc().statusStore().jobsList(None).size()

    rng = random.Random(5)
    edges = [(i, i, i + 1, i % 7) for i in range(400)] + [(400 + i, *rng.sample(range(500), 2), rng.randrange(50)) for i in range(900)]
    df, up, true = spark.createDataFrame(edges, "eid long, src long, dst long, w long"), list(range(500)), set()
    for w, e, a, b in sorted((w, e, a, b) for e, a, b, w in edges):
        while up[a] != a:
            a = up[a]
        while up[b] != b:
            b = up[b]
        if a != b:
            up[b] = a
            true.add(e)
    links = df.select("eid", "src", "dst", "w").withColumnsRenamed({"src": "ca", "dst": "cb"})
    for last in (0, 50, 10_000):
        eids, roots = structure.merge_least(links, last)
        assert {r["eid"] for r in eids.collect()} == true
        assert roots.select("root").distinct().count() == roots.count() - len(true)
    before = jobs()
    assert {r["eid"] for r in forests.filtered_forest(spark.range(500), df).forest.collect()} == true
    assert jobs() - before < 60  # it took several times as many
