"""Shared prefix lengths come from the rounds that sorted the suffixes, after packed words."""

import random

import pytest

from seqloom.functions import text


@pytest.mark.parametrize("kinds", [1, 3, 5000])
def test_lengths_and_few_jobs(spark, kinds):
    rng = random.Random(kinds)
    part = [rng.randrange(kinds) for _ in range(90)]
    xs = part + [0] * 70 + part + [rng.randrange(kinds) for _ in range(40)] + part[:50]
    n = len(xs)
    order = sorted(range(n), key=lambda i: xs[i:])
    true = []
    for a, b in zip(order[1:], order):
        k = 0
        while max(a, b) + k < n and xs[a + k] == xs[b + k]:
            k += 1
        true.append((a, b, k))
    seq = spark.createDataFrame(list(enumerate(xs)), "pos long, val long")
    jobs = lambda: spark.sparkContext._jsc.sc().statusStore().jobsList(None).size()
    before = jobs()
    got = [(r["pos"], r["prev"], r["lcp"]) for r in text.lcp(seq).orderBy("rank").collect()]
    assert got == true
    assert kinds != 3 or jobs() - before < 90  # levels were built twice, from single values


def test_words_across_blocks(spark):
    n = text.BLOCK + 40
    xs = [i % 3 for i in range(n)]
    ranked = spark.range(n).selectExpr("id AS pos", "id % 3 AS rank")
    got = {r["pos"]: (r["hi"], r["lo"]) for r in text._words(ranked, 2, 16).where(f"pos > {n - 80}").collect()}
    pack = lambda i: sum((xs[i + k] + 1 if i + k < n else 0) << 2 * (15 - k) for k in range(16))
    assert got == {i: (pack(i), pack(i + 16)) for i in range(n - 79, n)}
