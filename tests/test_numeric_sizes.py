"""Primes and range minima at more than one segment or block."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.functions import numeric


@pytest.mark.parametrize("n", [4, 9, 25, 48, 49, 50, 121, 2_000])
def test_primes_by_segments(spark, n):
    df = numeric.primes(spark, n, segment=7)
    assert sorted(r["p"] for r in df.collect()) == [x for x in range(2, n + 1) if all(x % y for y in range(2, int(x**0.5) + 1))]


def test_primes_are_not_sent_around(spark):
    """Multiples were a table as long as n, which a join broadcast."""
    plan = numeric.primes(spark, 100_000)._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftAnti" not in plan and "explode" not in plan


def test_range_min_of_all_widths(spark):
    v = np.random.default_rng(3).integers(0, 9, 150).tolist()
    seq = spark.createDataFrame(list(enumerate(v)), "pos long, val long")
    pairs = [(i, j) for i in range(-1, 151, 7) for j in range(i - 1, 154)]
    q = spark.createDataFrame([(k, i, j) for k, (i, j) in enumerate(pairs)] + [(-1, None, 4)], "q long, i long, j long")
    want = {k: min(range(max(i, 0), min(j, 149) + 1), key=lambda t: (v[t], t)) for k, (i, j) in enumerate(pairs) if max(i, 0) <= min(j, 149)}
    assert {r["q"]: r["pos"] for r in numeric.range_min(seq, q, block=4).collect()} == want
    assert numeric.range_min(seq.limit(0), q).count() == 0


def test_range_min_meets_few_elements(spark, monkeypatch):
    """Queries met all elements of their end blocks, 4,096 each: rows that come out of joins stay in proportion to queries."""
    n = 20_000
    seq = spark.range(n).select(F.col("id").alias("pos"), F.pmod(F.xxhash64("id"), F.lit(1000)).alias("val"))
    q = spark.range(n).select(F.col("id").alias("q"), F.col("id").alias("i"), F.least(F.col("id") + 5_000, F.lit(n - 1)).alias("j"))
    met = []
    union = numeric.reduce
    monkeypatch.setattr(numeric, "reduce", lambda f, parts: met.append(sum(p.count() for p in parts)) or union(f, parts))
    assert numeric.range_min(seq, q).count() == n
    assert met[0] < 6 * n


def test_cycles_by_contraction(spark, monkeypatch):
    rng = np.random.default_rng(6)
    to = np.concatenate([rng.permutation(300), [300, 302, 301]]).tolist()
    seen, want = set(), 0
    for i in range(len(to)):
        want += i not in seen
        while i not in seen:
            seen.add(i)
            i = to[i]
    left = []
    doubling = numeric._cycles_by_doubling
    monkeypatch.setattr(numeric, "_cycles_by_doubling", lambda df, n: left.append(n) or doubling(df, n))
    df = spark.createDataFrame(list(enumerate(to)), "pos long, val long")
    assert numeric.cycle_count(df, least=40) == want and left[0] <= 40
    assert numeric.cycle_count(df.limit(0)) == 0
