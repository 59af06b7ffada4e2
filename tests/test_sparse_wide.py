"""More active columns than are gathered."""

import numpy as np

from seqloom.operators import sparse

from .test_sparse import descent


def test_columns_beyond_those_gathered(spark, monkeypatch):
    rng = np.random.default_rng(2)
    x = np.where(rng.random((200, 30)) < 0.1, 1 + rng.random(size=(200, 30)), 0.0)
    y = x @ rng.normal(0, 3, 30) + 0.1 * rng.normal(size=200)
    entries = spark.createDataFrame([(int(r), int(c), float(x[r, c])) for r, c in zip(*np.nonzero(x))], "row long, col long, val double")
    targets = spark.createDataFrame([(i, float(v)) for i, v in enumerate(y)], "row long, y double")
    monkeypatch.setattr(sparse, "GATHER", 10)
    got = sparse.lasso_path(entries, targets, steps=2, ratio=0.2, batch=4)
    rows = got.weights.collect()
    for s, penalty in enumerate(got.penalties):
        w = np.zeros(30)
        for r in rows:
            if r["step"] == s:
                w[r["col"]] = r["weight"]
        assert np.abs(w - descent(x, y, penalty)).max() < 1e-6
    assert len({r["col"] for r in rows if r["step"] == 1}) > 10  # more than would have raised an error
    assert sparse.conditions(entries, targets, got).where("not holds").count() == 0
