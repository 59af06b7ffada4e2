"""Set cover by buckets of size: nearly greedy, with many sets chosen at once."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import cut, shared_path


@dataclass(frozen=True)
class Cover:
    """chosen: (set, bucket, round). rounds: how many there were; bound: the least factor
    of the best cover that is guaranteed."""

    chosen: DataFrame
    rounds: int
    bound: float


def bucketed_cover(sets: DataFrame, epsilon: float = 0.1, seed: int = 1) -> Cover:
    """A cover of all elements of (set, element), within (1 + epsilon) ** 2 * (1 + ln(largest set)) of the smallest.

    Buckets go from the largest sets down: in bucket b are the sets that have
    (1 + epsilon) ** b or more open elements. In a round each open element goes to the
    first of its sets in the bucket in the order of a hash; a set that gets at least
    (1 + epsilon) ** (b - 1) of them is chosen, and all it has is covered. So chosen sets
    overlap little, and each covers nearly as much as the greedy choice would. The first set
    gets all its elements, so every round chooses one. Rows with nulls are left
    out, repeated rows count once. A round reads the sets that still have open elements; what it
    does to a frequent element is a minimum, taken before rows are shuffled.
    """
    if epsilon <= 0:
        raise ValueError("epsilon is above 0")
    spark, path, base = sets.sparkSession, shared_path(sets.sparkSession, "chosen"), 1 + epsilon
    kind = dict(sets.dtypes)["set"]
    schema = f"set {kind}, bucket int, round int"
    spark.createDataFrame([], schema).write.parquet(path)
    open_ = cut(sets.where("set is not null and element is not null").select("set", "element").distinct(), "open")
    rounds, most = 0, None
    while True:
        sizes = cut(open_.groupBy("set").agg(F.count(F.lit(1)).alias("k")), "sizes")
        largest = sizes.agg(F.max("k")).first()[0]
        if largest is None:
            break
        most = most or largest
        # the highest bucket that has a set; rounding must not lift it above the set
        b = math.floor(math.log(largest, base) + 1e-9)
        while base**b > largest:
            b -= 1
        rounds += 1
        active = sizes.where(F.col("k") >= base**b).select("set", F.xxhash64(F.lit(seed + rounds), "set").alias("h"))
        here = cut(open_.join(active, "set"), "active")
        owner = cut(here.groupBy("element").agg(F.min(F.struct("h", "set")).alias("o")).select("o.set"), "owners")
        new = cut(owner.groupBy("set").agg(F.count(F.lit(1)).alias("got")).where(F.col("got") >= base ** (b - 1)).select("set"), "new")
        new.select("set", F.lit(b).alias("bucket"), F.lit(rounds).alias("round")).write.mode("append").parquet(path)
        covered = cut(here.join(new, "set", "left_semi").select("element").distinct(), "covered")
        open_ = cut(open_.join(covered, "element", "left_anti"), "open")
    return Cover(spark.read.schema(schema).parquet(path), rounds, base * base * (1 + math.log(most)) if most else 1.0)
