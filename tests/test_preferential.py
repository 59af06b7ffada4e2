"""A preferential graph is drawn in the tasks, not on the driver, and keeps its law."""

from collections import Counter

from seqloom.sources import generators


def test_preferential(spark, monkeypatch):
    sent = []
    made = spark.createDataFrame
    monkeypatch.setattr(spark, "createDataFrame", lambda rows, *a, **k: sent.append(len(rows)) or made(rows, *a, **k))
    n, m = 3_000, 3
    df = generators.barabasi_albert(spark, n, 5, m)
    edges = [(r["src"], r["dst"]) for r in df.collect()]
    assert max(sent) == 10  # it was all edges
    assert len(set(edges)) == len(edges) == 10 + (n - 5) * m and all(b < a for a, b in edges)
    assert sorted(edges) == sorted((r["src"], r["dst"]) for r in generators.barabasi_albert(spark, n, 5, m).repartition(3).collect())
    degree = Counter(x for e in edges for x in e)
    assert max(degree.values()) > 60  # ends drawn evenly among vertices give about 30
    share = sum(k >= 6 for k in degree.values()) / n  # 2 * 3 * 4 / (6 * 7 * 8) * (1 + ...) = 12 / 42
    assert abs(share - m * (m + 1) / 42) < 0.04
    for k, m0 in ((3, 2), (4, 0), (1, 1)):
        few = [(r["src"], r["dst"]) for r in generators.barabasi_albert(spark, 40, m0, k).collect()]
        assert Counter(a for a, _ in few) == {v: min(k, v) for v in range(1, 40)}
