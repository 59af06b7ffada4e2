"""Cartesian trees of several blocks against a walk with a stack."""

import random

from seqloom.functions import text


def parents(val):
    out, stack = list(range(len(val))), []
    for i, v in enumerate(val):
        last = None
        while stack and val[stack[-1]] > v:
            last = stack.pop()
        if last is not None:
            out[last] = i
        if stack:
            out[i] = stack[-1]
        stack.append(i)
    return out


def test_blocks(spark, monkeypatch):
    rng = random.Random(3)
    seqs = [[rng.randrange(4) for _ in range(40)], [rng.randrange(1000) for _ in range(61)], [*range(20), -1], [*range(20, 0, -1)]]
    monkeypatch.setattr(text, "BLOCK", 4)
    for val in seqs:
        tree = text.cartesian_tree(spark.createDataFrame(list(enumerate(val)), "pos long, val long"))
        got = {r["pos"]: r["parent"] for r in tree.collect()}
        assert got == dict(enumerate(parents(val)))
        plan = tree._jdf.queryExecution().toString()
        assert "Coalesce 1" not in plan  # no task walks the whole sequence
