"""A cover whose last rounds are done by one task."""

import numpy as np

from seqloom.operators import structure


def loops(pairs):
    open_, out, r = set(pairs), set(), 0
    while open_:
        size = {}
        for s, _ in open_:
            size[s] = size.get(s, 0) + 1
        best = {}
        for s, e in open_:
            best[e] = min(best.get(e, (0, "")), (-size[s], s))
        wins = {s for s in size if all(best[e][1] == s for x, e in open_ if x == s)}
        out |= {(s, r) for s in wins}
        open_ = {(s, e) for s, e in open_ if best[e][1] not in wins}
        r += 1
    return out, r


def test_cover_by_rounds_and_by_one_task(spark):
    """Every round was a job, however little was open."""
    rng = np.random.default_rng(5)
    pairs = [(f"s{a}", int(b)) for a, b in zip(rng.integers(0, 30, 300), rng.zipf(1.5, 300) % 60)]
    true, rounds = loops(pairs)
    assert rounds > 4
    sets = spark.createDataFrame([*pairs, (None, 1), ("s1", None)], "set string, element long")
    for last in (structure.LAST_PAIRS, len(set(pairs)) // 2, 0):
        got = structure.set_cover(sets, last=last)
        assert got.dtypes == [("set", "string"), ("round", "int")] and set(map(tuple, got.collect())) == true and got.count() == len(true)
    assert structure.set_cover(sets.limit(0)).count() == 0
