"""Patterns that ask the same part of the index go to several groups."""

from pyspark.sql import functions as F

from seqloom.functions import patterns


def test_many_patterns_of_one_part_are_looked_up_in_shares(spark, monkeypatch):
    texts = [(i, "".join(chr(97 + (i * 7 + j * j) % 11) for j in range(60))) for i in range(20)]
    index = patterns.build(spark.createDataFrame(texts, "d long, t string"), "d", "t")
    assert len(index.bounds) == 1
    asked = sorted({t[a : a + k] for _, t in texts for a in range(0, 50, 5) for k in (2, 5, 40) if a + k <= 60})
    frame = spark.createDataFrame([(p,) for p in asked], "pattern string")
    want = {(p, d, at) for p in asked for d, t in texts for at in range(len(t)) if t.startswith(p, at)}
    for most in (patterns.ASKED, 10, 1):
        monkeypatch.setattr(patterns, "ASKED", most)
        sizes = patterns._search(index, frame, patterns.HEAD, lambda s, a, spans: a.groupby("part", as_index=False).size()[["size"]], "size long")
        shares = [r["size"] for r in sizes.collect()]
        assert sum(shares) == len(asked) and (len(shares) == 1) == (most == 65_536)
        got = [tuple(r) for r in patterns.find(index, frame).select("pattern", "doc", "at").collect()]
        assert len(got) == len(set(got)) and set(got) == want
        short = frame.where(F.length("pattern") <= patterns.HEAD)
        n = {r["pattern"]: r["n"] for r in patterns.intervals(index, short).collect()}
        assert n == {p: sum(w[0] == p for w in want) for p in asked if len(p) <= patterns.HEAD}
