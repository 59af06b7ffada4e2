"""User-defined folds against plain loops, with hot keys, nulls and odd partitions."""

import random
from collections import defaultdict
from functools import reduce

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.operators import monoids


def kadane(values):
    best = now = 0
    for v in values:
        now = max(0, now + v)
        best = max(best, now)
    return best


def longest(flags):
    best = now = 0
    for f in flags:
        now = now + 1 if f else 0
        best = max(best, now)
    return best


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(1)
    out = [("hot" if rng.random() < 0.9 else rng.choice(["a", "b", "", None]), i, rng.randint(-9, 9), rng.random() < 0.8) for i in range(6000)]
    rng.shuffle(out)
    return out


def by_key(rows):
    out = defaultdict(list)
    for r in sorted(rows, key=lambda r: r[1]):
        out[r[0]].append(r)
    return out


def test_reduce_runs_keeps_the_order():
    join = lambda a, b: (np.array([x + y for x, y in zip(a[0], b[0])], dtype=object),)
    for lengths in ([1], [5], [1, 2, 3, 4, 7, 8, 9], [100, 1, 1, 33]):
        words = [chr(97 + i % 26) for i in range(sum(lengths))]
        first = np.cumsum([0, *lengths[:-1]])
        got = monoids.reduce_runs((np.array(words, dtype=object),), first, join)[0].tolist()
        assert got == ["".join(words[a : a + n]) for a, n in zip(first, lengths)]
    assert len(monoids.reduce_runs((np.zeros(0),), np.zeros(0, dtype=int), join)[0]) == 0


def test_ordered_fold_with_a_hot_key(spark, rows, monkeypatch):
    df = spark.createDataFrame(rows, "k string, i long, v long, f boolean").repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        both = monoids.pair(monoids.maximal_subarray(), monoids.longest_run(), slice(0, 1), slice(1, 2))
        parts = monoids.partials(df, ["k"], both, ["v", "f"], ["i"]).groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("rows").alias("most")).collect()
        hot = next(r for r in parts if r["k"] == "hot")
        assert hot["n"] >= 8 and hot["most"] < 1500  # the hot key's 5,400 rows are cut into ranges
        want = {k: (sum(r[2] for r in g), kadane(r[2] for r in g), longest(r[3] for r in g)) for k, g in by_key(rows).items()}
        for fan in (2, 3, 64):  # trees of four levels, three and one
            monkeypatch.setattr(monoids, "FAN", fan)
            got = monoids.fold(df, ["k"], both, ["v", "f"], ["i"])
            assert {r["k"]: (r["total"], r["best"], r["longest"]) for r in got.collect()} == want
            assert "collect_list" not in got._jdf.queryExecution().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_fold_that_is_not_commutative(spark, rows):
    df = spark.createDataFrame(rows, "k string, i long, v long, f boolean").withColumn("m", F.col("v") + 11)
    got = monoids.fold(df, ["k"], monoids.affine(997), ["m", "i"], ["i"]).collect()
    then = lambda f, g: (g[0] * f[0] % 997, (g[0] * f[1] + g[1]) % 997)
    assert {r["k"]: (r["slope"], r["shift"]) for r in got} == {k: reduce(then, [((r[2] + 11) % 997, r[1] % 997) for r in g]) for k, g in by_key(rows).items()}
    with pytest.raises(ValueError):
        monoids.fold(df, ["k"], monoids.affine(997), ["m", "i"])


def test_commutative_fold_without_order(spark, rows, monkeypatch):
    df = spark.createDataFrame([(r[0], float(r[2])) for r in rows] + [("one", 3.0), ("nan", float("nan")), ("none", None)], "k string, v double").repartition(5)
    for held in (1 << 18, 3):  # with 3, tasks pass on states early
        monkeypatch.setattr(monoids, "HELD", held)
        got = {r["k"]: (r["largest"], r["second"]) for r in monoids.fold(df.where("not isnan(v) or v is null"), ["k"], monoids.two_largest(), ["v"]).collect()}
        want = {k: tuple(sorted({float(r[2]) for r in g}, reverse=True)[:2]) for k, g in by_key(rows).items()}
        assert got == {**want, "one": (3.0, float("-inf"))}
    plan = monoids.partials(df, ["k"], monoids.two_largest(), ["v"])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "rangepartitioning" not in plan


def test_fold_of_all_rows_nulls_and_empty_tables(spark, rows):
    df = spark.createDataFrame([(r[1], r[2]) for r in rows] + [(99_999, None)], "i long, v long").repartition(6)
    assert monoids.fold(df, [], monoids.maximal_subarray(), ["v"], ["i"]).first()["best"] == kadane(r[2] for r in sorted(rows, key=lambda r: r[1]))
    assert tuple(monoids.fold(df.limit(0), [], monoids.maximal_subarray(), ["v"], ["i"]).first()) == (0, 0, 0, 0)
    assert monoids.fold(df.limit(0), ["i"], monoids.maximal_subarray(), ["v"], ["i"]).count() == 0
    keyed = spark.createDataFrame([(None, 1, 1.5, 4), (None, 2, 1.5, 5), (float("nan"), 1, None, 1), (float("nan"), 2, None, 1)], "part double, up int, n double, v long")
    got = monoids.fold(keyed, ["part", "n"], monoids.maximal_subarray(), ["v"], ["up"]).collect()
    assert sorted(r["best"] for r in got) == [2, 9]  # NaN and null are keys of their own
