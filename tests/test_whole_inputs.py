"""Queries without SQL work on all edges and triangles of their tables, not on a thinned part."""

from collections import defaultdict

import pytest

from seqloom import catalog
from seqloom.plans import tables

QUERIES = catalog.queries()


@pytest.fixture(scope="module")
def graph(spark, sf):
    vertices, edges = tables.part_graph(spark, sf)
    near = defaultdict(set)
    for r in edges.collect():
        near[r["src"]].add(r["dst"])
        near[r["dst"]].add(r["src"])
    return sorted(r["id"] for r in vertices.collect()), near


def test_part_components(spark, sf, graph):
    ids, near = graph
    comp = {}
    for i in ids:
        todo = [] if i in comp else [i]
        while todo:
            x = todo.pop()
            if x not in comp:
                comp[x] = i
                todo += near[x]
    assert {r["id"]: r["comp"] for r in QUERIES["part_components"](spark, sf).collect()} == comp


def test_independent_set(spark, sf, graph):
    ids, near = graph
    chosen = set()
    for i in ids:
        if not near[i] & chosen:
            chosen.add(i)
    assert {r["id"] for r in QUERIES["independent_set"](spark, sf).collect() if r["chosen"]} == chosen


def test_colouring(spark, sf, graph):
    ids, near = graph
    colour = {}
    for i in sorted(ids, key=lambda i: (-len(near[i]), i)):
        used = {colour.get(j) for j in near[i]}
        colour[i] = next(c for c in range(len(ids)) if c not in used)
    assert {r["id"]: r["colour"] for r in QUERIES["colouring"](spark, sf).collect()} == colour and max(colour.values()) > 2


def test_matching(spark, sf, graph):
    ids, near = graph
    free, chosen = set(ids), []
    for a, b in sorted((a, b) for a in ids for b in near[a] if a < b):  # the order of eid
        if a in free and b in free:
            chosen.append((a, b))
            free -= {a, b}
    assert sorted((r["src"], r["dst"]) for r in QUERIES["matching"](spark, sf).collect()) == chosen


def test_ray_cast_takes_all_triangles(spark, sf):
    labels = {r["vec_id"]: r["label"] for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    hit = {labels[r["tri"]] for r in QUERIES["ray_cast"](spark, sf).collect() if r["tri"] >= 0}
    assert len(hit) > 1
