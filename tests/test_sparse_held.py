"""More active columns than are gathered, of entries that one task holds or not."""

import numpy as np

from seqloom.operators import sparse

from .test_sparse import descent


def test_one_task_makes_all_passes(spark, monkeypatch):
    """Each pass was a job, however few the entries."""
    rng = np.random.default_rng(3)
    x = np.where(rng.random((200, 30)) < 0.1, 1 + rng.random(size=(200, 30)), 0.0)
    y = x @ rng.normal(0, 3, 30) + 0.1 * rng.normal(size=200)
    entries = spark.createDataFrame([(int(r), f"c{c}", float(x[r, c])) for r, c in zip(*np.nonzero(x))], "row long, col string, val double")
    targets = spark.createDataFrame([(i, float(v)) for i, v in enumerate(y)], "row long, y double")
    monkeypatch.setattr(sparse, "GATHER", 10)
    used = []
    solve = sparse._Spread.solve
    monkeypatch.setattr(sparse._Spread, "solve", lambda *a: used.append(1) or solve(*a))
    paths = {}
    for held in (sparse.HELD, 1):
        monkeypatch.setattr(sparse, "HELD", held)
        got = sparse.lasso_path(entries, targets, steps=3, ratio=0.1, batch=4)
        assert bool(used) == (held == 1)
        rows = got.weights.collect()
        for s, penalty in enumerate(got.penalties):
            w = np.zeros(30)
            for r in rows:
                if r["step"] == s:
                    w[int(r["col"][1:])] = r["weight"]
                    assert r["penalty"] == penalty
            assert np.abs(w - descent(x, y, penalty)).max() < 1e-6
        assert got.passes > 3 and sparse.conditions(entries, targets, got).where("not holds").count() == 0
        paths[held] = got.penalties
    assert paths[1] == paths[4_000_000]
    monkeypatch.setattr(sparse, "HELD", 4_000_000)
    ends = sparse.lasso_path(entries, targets, penalties=[20.0, 1.0, 0.0], batch=4)
    last = {s: {r["col"]: r["weight"] for r in ends.weights.collect() if r["step"] == s} for s in (1, 2)}
    assert last[1] == last[2] and len(last[1]) > 10
