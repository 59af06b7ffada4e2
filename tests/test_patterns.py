"""Patterns looked up in suffixes against str.find."""

import random

import pytest

from seqloom.functions import patterns


def places(texts, pattern):
    for d, t in texts:
        at = (t or "").find(pattern)
        while at >= 0 and pattern:
            yield d, at
            at = t.find(pattern, at + 1)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(1)
    made = ["".join(rng.choice("abé𝔘 ") for _ in range(rng.choice([1, 5, 80, 300]))) for _ in range(25)]
    return [(i, t) for i, t in enumerate(made)] + [(100, "a" * 700), (101, ""), (102, None), (103, "\x00\x7f￿\U0010ffff ends"), (104, "only once: " + "z" * 50)]


def test_find_and_intervals(spark, texts):
    df = spark.createDataFrame(texts, "d long, t string")
    asked = ["a", "b", "é", "𝔘", "ab", "ba é", "a" * 32, "a" * 33, "a" * 699, "a" * 701, "aaaaaaaab", "z" * 50, "once: zz", "nowhere", "\x00", "￿", "\U0010ffff", "\U0010ffff ends", "ends", texts[3][1], texts[4][1]]
    frame = spark.createDataFrame([(p,) for p in asked + asked[:3] + [None, ""]], "pattern string")
    want = {(p, d, at) for p in asked for d, at in places(texts, p)}
    for rows in (1 << 16, 40):  # one part, and so many that heads of one kind fill several
        index = patterns.build(df, "d", "t", rows=rows)
        assert index.bounds[-1][2] <= sum(len(t or "") for _, t in texts) and (len(index.bounds) > 10) == (rows == 40)
        got = [tuple(r) for r in patterns.find(index, frame).select("pattern", "doc", "at").collect()]
        assert len(got) == len(set(got)) and set(got) == want
        short = frame.where("length(pattern) <= 32")
        found = {r["pattern"]: (r["first"], r["n"]) for r in patterns.intervals(index, short).collect()}
        suffixes = sorted(t[i : i + 32].encode() for _, t in texts for i in range(len(t or "")))
        for p in asked:
            if len(p) <= 32:
                n = sum(s.startswith(p.encode()) for s in suffixes)
                first = next((k for k, s in enumerate(suffixes) if s.startswith(p.encode())), None)
                assert found.get(p) == ((first, n) if n else None)
    with pytest.raises(ValueError):
        patterns.intervals(index, frame)
    empty = patterns.build(df.limit(0), "d", "t")
    assert patterns.find(empty, frame).count() == 0 and patterns.find(index, frame.limit(0)).count() == 0
