"""Products of packed matrices against those by joins, and what ranking exchanges."""

import numpy as np
from pyspark.sql import functions as F

from seqloom.operators import ranking


def test_tiles(spark, monkeypatch):
    monkeypatch.setattr(ranking, "PIECES", 1)
    rng = np.random.default_rng(4)
    ids = [*range(-3, 20), 65535, 65536, 70000, 1 << 40]
    at = [(int(ids[a]), int(ids[b])) for a, b in rng.integers(0, len(ids), (300, 2))]  # some twice
    entries = spark.createDataFrame([*at, (None, 1), (1, None)], "row long, col long")
    vector = spark.createDataFrame([(i, float(i % 7) - 2.5) for i in ids[:-4]], "pos long, val double")
    matrix = ranking.tiles(entries.repartition(5))
    got = {r["pos"]: r["val"] for r in ranking.apply_tiles(matrix, vector).collect()}
    want = {r["pos"]: r["val"] for r in ranking.apply_matrix(entries.withColumn("val", F.lit(1.0)), vector).where("pos is not null").collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert matrix[0].agg(F.sum(F.length("rows"))).first()[0] == 2 * len(at)  # two bytes an entry and side
