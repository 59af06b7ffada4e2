"""Results that must not depend on how many partitions there are, nor on the order of sums."""

from contextlib import contextmanager

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.operators import spatial


@contextmanager
def apart(spark, partitions=13):
    """Shuffles keep all their partitions, as on large tables."""
    conf = {"spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": str(partitions)}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_forces_of_many_blocks(spark):
    at = np.random.default_rng(4).integers(-300, 300, (60, 3)).astype(float)
    bodies = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(at)], "id long, x double, y double, z double").withColumn("mass", F.lit(1.0) + F.col("id") % 3)
    d = at[None, :, :] - at[:, None, :]
    r2 = (d**2).sum(axis=2)
    pairs = (1.0 + np.arange(60) % 3)[None, :, None] * d / np.where(r2 > 0, r2 * np.sqrt(r2), np.inf)[:, :, None]
    with apart(spark):
        got = np.array([[r["fx"], r["fy"], r["fz"]] for r in spatial.total_forces(bodies, block=8).orderBy("id").collect()])
        units = np.array([[r["fx"], r["fy"], r["fz"]] for r in spatial.total_forces(bodies, block=8, unit=2.0**-46).orderBy("id").collect()])
    assert got == pytest.approx(pairs.sum(axis=1), abs=1e-15)
    assert (units == np.floor(pairs * 2.0**46 + 0.5).astype(np.int64).sum(axis=1)).all()
