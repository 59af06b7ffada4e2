"""The path of sparse regression against coordinate descent on all columns, and its conditions in SQL."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from seqloom.operators import sparse


def descent(x, y, penalty):
    a, b, w = x.T @ x, x.T @ y, np.zeros(x.shape[1])
    for _ in range(5000):
        old = w.copy()
        for i in range(len(w)):
            if a[i, i] > 0:
                r = b[i] - a[i] @ w + a[i, i] * w[i]
                w[i] = np.sign(r) * max(abs(r) - penalty / 2, 0) / a[i, i]
        if np.abs(w - old).max() < 1e-13:
            break
    return w


@pytest.fixture(scope="module")
def made(spark):
    rng = np.random.default_rng(1)
    x = np.where(rng.random((200, 120)) < 0.1, rng.normal(size=(200, 120)), 0.0)
    x[:, 3] = 0
    true = np.zeros(120)
    true[:9] = rng.normal(0, 3, 9)
    y = x @ true + 0.1 * rng.normal(size=200)
    cells = [(int(r), int(c), float(x[r, c])) for r, c in zip(*np.nonzero(x))]
    halves = [(r, c, v / 2) for r, c, v in cells[:40]] * 2 + cells[40:]  # entries of one place add up
    entries = spark.createDataFrame([*halves, (500, 1, 2.0), (None, 1, 1.0), (1, None, 1.0), (1, 1, None)], "row long, col long, val double")
    targets = spark.createDataFrame([*[(i, float(v)) for i, v in enumerate(y)], (900, None)], "row long, y double")
    return x, y, entries, targets


def test_path(spark, made):
    x, y, entries, targets = made
    got = sparse.lasso_path(entries, targets, steps=4, ratio=0.02, batch=8)
    rows = got.weights.collect()
    assert got.penalties == sorted(got.penalties, reverse=True) and len(got.penalties) == 4
    for s, penalty in enumerate(got.penalties):
        w = np.zeros(120)
        for r in rows:
            if r["step"] == s:
                w[r["col"]] = r["weight"]
        assert np.abs(w - descent(x, y, penalty)).max() < 1e-6
    assert got.gathered < 120 * 120 / 2  # columns without weights meet no others
    assert sparse.conditions(entries, targets, got).where("not holds").count() == 0
    con = duckdb.connect()
    con.register("e", entries.toPandas())
    con.register("t", targets.toPandas())
    con.register("w", got.weights.toPandas())
    con.register("p", pd.DataFrame({"step": range(4), "penalty": got.penalties}))
    worst = con.execute("""WITH x AS (SELECT CAST("row" AS BIGINT) AS r, CAST(col AS BIGINT) AS col, sum(val) AS val FROM e JOIN t USING ("row") WHERE y IS NOT NULL AND col IS NOT NULL AND val IS NOT NULL GROUP BY 1, 2),
 f AS (SELECT step, r, sum(val * weight) AS fit FROM x JOIN w ON w.col = x.col GROUP BY 1, 2), l AS (SELECT p.step, penalty, t."row" AS r, y - coalesce(fit, 0) AS l FROM t CROSS JOIN p LEFT JOIN f ON f.r = t."row" AND f.step = p.step WHERE y IS NOT NULL),
 g AS (SELECT step, penalty, col, 2 * sum(val * l) AS g FROM x JOIN l USING (r) GROUP BY 1, 2, 3)
 SELECT max(CASE WHEN weight IS NULL THEN abs(g) - g.penalty ELSE abs(g - sign(weight) * g.penalty) END / g.penalty) FROM g LEFT JOIN w ON w.step = g.step AND w.col = g.col""").fetchone()[0]
    assert worst < 1e-6


def test_edges(spark, made):
    x, y, entries, targets = made
    few = sparse.lasso_path(entries, targets, penalties=[1e9, 5.0])
    assert {r["step"] for r in few.weights.collect()} == {1}
    assert sparse.lasso_path(entries.limit(0), targets, steps=2).weights.count() == 0
    with pytest.raises(ValueError):
        sparse.lasso_path(entries, targets, penalties=[0.01], most_active=10)
