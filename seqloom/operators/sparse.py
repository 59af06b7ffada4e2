"""Sparse regression on entries (row, col, val): a path of penalties, by active sets.

Columns are never paired with all columns: only those that may have a weight are, and of
those the products reach the driver (a square of at most GATHER). Whether any other
column would have one is a pass over the entries. With more active columns none are paired: all
columns move at once, a pass over the entries each time. With at most HELD entries one task holds them
and makes these passes; else each is a job, and weights stay on Spark.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import cut

#: Active columns whose products are gathered; more are solved by passes.
GATHER = 2_000
#: Columns whose weights are sent to the entries (16 bytes each) instead of being joined by an exchange.
SENT = 2_000_000
#: Entries (about 70 bytes each while they are read) that one task may hold to make all passes.
HELD = 4_000_000


@dataclass
class LassoPath:
    """weights: (step, penalty, col, weight) of the weights that are not 0. gathered: products of
    columns that reached the driver; passes: gradients of all columns that were computed."""

    weights: DataFrame | None = None
    penalties: list[float] = field(default_factory=list)
    gathered: int = 0
    passes: int = 0


class _Active:
    """The active columns, their products with each other and with the target."""

    def __init__(self, entries: DataFrame, most: int):
        self.entries, self.most, self.columns = entries, most, []
        self.gram, self.target = np.zeros((0, 0)), np.zeros(0)

    def add(self, new: dict[int, float]) -> int:
        """Adds columns with their products with the target; returns how many products were gathered."""
        if len(self.columns) + len(new) > self.most:
            raise ValueError(f"more than {self.most} columns are active at this penalty")
        self.columns += list(new)
        self.target = np.append(self.target, list(new.values()))
        place = {c: i for i, c in enumerate(self.columns)}
        spark, kind = self.entries.sparkSession, dict(self.entries.dtypes)["col"]
        frame = lambda cols: F.broadcast(spark.createDataFrame([(c,) for c in cols], f"col {kind}"))  # noqa: E731  at most ``most`` rows
        mine = self.entries.join(frame(new), "col").select("row", F.col("col").alias("a"), F.col("val").alias("x"))
        every = self.entries.join(frame(self.columns), "col").select("row", F.col("col").alias("b"), F.col("val").alias("y"))
        got = mine.join(every, "row").groupBy("a", "b").agg(F.sum(F.col("x") * F.col("y")).alias("p")).collect()
        gram = np.zeros((len(self.columns), len(self.columns)))
        gram[: len(self.gram), : len(self.gram)] = self.gram
        for r in got:
            gram[place[r["a"]], place[r["b"]]] = gram[place[r["b"]], place[r["a"]]] = r["p"]
        self.gram = gram
        return len(got)

    def solve(self, w: np.ndarray, penalty: float) -> np.ndarray:
        """Coordinates in turn, from ``w``, until none moves."""
        a, b, w = self.gram, self.target, np.append(w, np.zeros(len(self.columns) - len(w)))
        fits = a @ w
        for _ in range(100_000):
            moved = 0.0
            for i in np.flatnonzero(a.diagonal() > 0):
                r = b[i] - fits[i] + a[i, i] * w[i]
                new = math.copysign(max(abs(r) - penalty / 2, 0.0), r) / a[i, i]
                if new != w[i]:
                    moved = max(moved, abs(new - w[i]) * math.sqrt(a[i, i]))
                    fits += a[i] * (new - w[i])
                    w[i] = new
            if moved < 1e-13 * (1 + math.sqrt(max(b @ w, 0.0))):
                break
        return w


def gradients(entries: DataFrame, targets: DataFrame, weights: DataFrame, steps: DataFrame) -> DataFrame:
    """(step, col, gradient): of every column and step, twice its product with what the step's weights
    (step, col, weight) leave of the targets."""
    fits = entries.join(weights, "col").groupBy("step", "row").agg(F.sum(F.col("val") * F.col("weight")).alias("fit"))
    left = targets.crossJoin(F.broadcast(steps.select("step"))).join(fits, ["step", "row"], "left")  # a row for each penalty
    left = left.select("step", "row", (F.col("y") - F.coalesce("fit", F.lit(0.0))).alias("left"))
    return entries.join(left, "row").groupBy("step", "col").agg((2 * F.sum(F.col("val") * F.col("left"))).alias("gradient"))


def _off(gradient: Column, weight: Column, penalty: Column | float) -> Column:
    """How far a column is from its condition: the penalty with its weight's sign, or not above it without one."""
    return F.when(weight != 0, F.abs(gradient - F.signum(weight) * penalty)).otherwise(F.abs(gradient) - penalty)


class _Spread:
    """All columns at once. A column's step is the longest that is safe whatever the others do: their
    products are at most the diagonal of its entries times the sums of their rows. Steps are carried on
    with momentum, which starts again where it points uphill."""

    def __init__(self, own: DataFrame, goal: DataFrame, products: DataFrame):
        spark = own.sparkSession
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        # entries and targets stay dealt by row, so that a pass exchanges one sum for each column and part
        self.own = own.repartition(n, "row").persist()
        self.goal = goal.repartition(n, "row").persist()
        sums = self.own.groupBy("row").agg(F.sum(F.abs("val")).alias("s"))
        self.sizes = cut(self.own.join(sums, "row").groupBy("col").agg(F.sum(F.abs("val") * F.col("s")).alias("d")).join(products, "col", "left"), "sizes")
        self.few = self.sizes.count() <= SENT

    def solve(self, weights: DataFrame, penalty: float, tolerance: float) -> tuple[DataFrame, int]:
        """(col, weight) at the penalty, begun at ``weights`` (col, weight), and the passes taken."""
        start = F.coalesce("weight", F.lit(0.0))
        state = self.sizes.join(weights, "col", "left").select("col", "d", start.alias("z"), start.alias("w"))
        momentum, passes = 1.0, 0
        while True:
            passes += 1
            at = state.where("z <> 0").select("col", "z")
            fits = self.own.join(F.broadcast(at) if self.few else at, "col").groupBy("row").agg(F.sum(F.col("val") * F.col("z")).alias("fit"))
            left = self.goal.join(fits, "row", "left").select("row", (F.col("y") - F.coalesce("fit", F.lit(0.0))).alias("left"))
            g = self.own.join(left, "row").groupBy("col").agg((2 * F.sum(F.col("val") * F.col("left"))).alias("g"))
            to = F.col("z") * 2 * F.col("d") + F.col("g")
            new = F.signum(to) * F.greatest(F.abs(to) - penalty, F.lit(0.0)) / (2 * F.col("d"))
            moved = cut(state.join(g, "col").select("col", "d", "z", "w", "g", new.alias("new")), "moved")
            uphill = F.sum(F.col("d") * (F.col("z") - F.col("new")) * (F.col("new") - F.col("w")))
            off, up = moved.agg(F.max(_off(F.col("g"), F.col("z"), penalty)), uphill).first()
            if off is None or off <= penalty * tolerance:
                return moved.where("z <> 0").select("col", F.col("z").alias("weight")), passes
            further = (1 + math.sqrt(1 + 4 * momentum**2)) / 2
            carry, momentum = (0.0, 1.0) if up > 0 else ((momentum - 1) / further, further)
            state = moved.select("col", "d", (F.col("new") + carry * (F.col("new") - F.col("w"))).alias("z"), F.col("new").alias("w"))

    def close(self) -> None:
        self.own.unpersist()
        self.goal.unpersist()


def _solved(penalties: dict[int, float], start: dict, tolerance: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """What a task does with all entries (row, col, val, y): (step, col, weight, passes) at the penalties by step, falling,
    begun at the weights ``start`` by column, by the passes of `_Spread`; a row without col has a step's passes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [b for b in batches if b.num_rows]
        if not rows:
            return
        t = pa.Table.from_batches(rows)
        del rows
        kind = t.schema.field("col").type
        number = lambda c, names: pc.index_in(t[c], names).to_numpy().astype(np.int32)
        places, names = pc.unique(t["row"]), pc.unique(t["col"])
        r, c, val = number("row", places), number("col", names), t["val"].to_numpy()
        y = np.zeros(len(places))
        y[r] = t["y"].to_numpy()
        del t
        d = np.bincount(c, np.abs(val) * np.bincount(r, np.abs(val))[r])
        w = np.array([start.get(x, 0.0) for x in names.to_pylist()])
        for s, penalty in penalties.items():
            z, momentum, passes = w.copy(), 1.0, 0
            while True:
                passes += 1
                left = y - np.bincount(r, val * z[c])
                g = 2 * np.bincount(c, val * left[r])
                off = np.where(z != 0, np.abs(g - np.sign(z) * penalty), np.abs(g) - penalty).max()
                if off <= penalty * tolerance:
                    break
                to = z * 2 * d + g
                new = np.sign(to) * np.maximum(np.abs(to) - penalty, 0.0) / (2 * d)
                further = (1 + math.sqrt(1 + 4 * momentum**2)) / 2
                carry, momentum = (0.0, 1.0) if (d * (z - new) * (new - w)).sum() > 0 else ((momentum - 1) / further, further)
                z, w = new + carry * (new - w), new
            w = z
            at = np.flatnonzero(w)
            of = lambda x, n=len(at): pa.array(np.full(n, x, dtype=np.int32))
            yield pa.record_batch({"step": of(s, 1), "col": pa.nulls(1, kind), "weight": pa.nulls(1, pa.float64()), "passes": of(passes, 1)})
            yield pa.record_batch({"step": of(s), "col": names.take(pa.array(at)), "weight": pa.array(w[at]), "passes": pa.nulls(len(at), pa.int32())})

    return run


def lasso_path(entries: DataFrame, targets: DataFrame, steps: int = 8, ratio: float = 0.05, penalties: list[float] | None = None, most_active: int | None = None, batch: int = 64, tolerance: float = 1e-7) -> LassoPath:
    """For falling penalties, the weights w that minimise sum((x w - y)^2) + penalty * sum |w|
    over entries (row, col, val) and targets (row, y).

    Without ``penalties`` there are ``steps``, from just below the one at which all weights are 0
    down to ``ratio`` of it. A step starts from the weights of the one before, on the columns
    that were active and those whose gradient is near the new penalty; after that the
    ``batch`` columns that break the conditions most join, until none does (by ``tolerance``
    of the penalty): then the weights are the minimum over all columns. From the step on that would
    gather more than GATHER columns, all columns move at once (in one task, if there are at most HELD entries)
    until all conditions hold by the same tolerance. Entries of one place add up, rows without targets and nulls are left out. With
    ``most_active``, more active columns than that raise ValueError.
    """
    spark, out = entries.sparkSession, LassoPath()
    goal = cut(targets.dropna().select("row", F.col("y").cast("double").alias("y")), "targets")
    own = entries.dropna().join(goal.select("row"), "row", "left_semi").groupBy("row", "col").agg(F.sum(F.col("val").cast("double")).alias("val")).where("val <> 0")
    own = cut(own, "entries")
    kind = dict(own.dtypes)["col"]
    products = cut(own.join(goal, "row").groupBy("col").agg(F.sum(F.col("val") * F.col("y")).alias("p")), "products")
    top = products.agg(F.max(F.abs("p"))).first()[0] or 0.0
    falling = sorted(penalties, reverse=True) if penalties else [2 * top * 0.999 * ratio ** (s / max(1, steps - 1)) for s in range(steps)]
    active, w, before = _Active(own, most_active or GATHER), np.zeros(0), 2 * top
    schema, rows = f"step int, col {kind}, weight double", []
    one = spark.createDataFrame([(0,)], "step int")
    gradient = products.select("col", (2 * F.col("p")).alias("gradient"))
    spread, done, held = None, [], None
    for s, penalty in enumerate(falling):
        bound = 2 * penalty - before  # a column below it is not likely to get a weight
        while spread is None and (penalty > 0 or s == 0):
            rest = gradient.where(F.abs("gradient") > max(bound, 0.0))
            if active.columns:
                rest = rest.join(F.broadcast(spark.createDataFrame([(c,) for c in active.columns], f"col {kind}")), "col", "left_anti")
            found = rest.join(products, "col").orderBy(F.desc(F.abs("gradient")), "col").limit(batch).collect()
            if most_active is None and penalty > 0 and len(found) == batch and len(active.columns) + rest.count() > GATHER:
                if own.count() > HELD:
                    spread = _Spread(own, goal, products.select("col"))
                else:
                    now = {c: float(x) for c, x in zip(active.columns, w) if x}
                    ahead = {i: float(p) for i, p in enumerate(falling) if i >= s and p > 0}
                    held = cut(own.join(goal, "row").select("row", "col", "val", "y").repartition(1).mapInArrow(_solved(ahead, now, tolerance), f"step int, col {kind}, weight double, passes int"), "held")
                break
            if found:
                out.gathered += active.add({r["col"]: r["p"] for r in found})
            elif bound == penalty * (1 + tolerance):
                break
            w = active.solve(w, penalty)
            now = [(0, c, float(x)) for c, x in zip(active.columns, w) if x]
            gradient = cut(gradients(own, goal, spark.createDataFrame(now, schema), one).select("col", "gradient"), "gradient")
            out.passes += 1
            bound = penalty * (1 + tolerance)
        if held is not None:
            break
        if spread is not None:
            last = done[-1].select("col", "weight") if done else spark.createDataFrame([(c, float(x)) for c, x in zip(active.columns, w) if x], f"col {kind}, weight double")
            if penalty > 0:
                last, passes = spread.solve(last, penalty, tolerance)
                out.passes += passes
            done.append(last.select(F.lit(s).alias("step"), F.lit(float(penalty)).alias("penalty"), "col", "weight"))
        else:
            rows += [(s, float(penalty), c, float(x)) for c, x in zip(active.columns, w) if x]
        before = penalty
    if spread is not None:
        spread.close()
    if held is not None:
        out.passes += held.agg(F.coalesce(F.sum("passes"), F.lit(0))).first()[0]
        steps_of = {i: max(j for j in range(i + 1) if falling[j] > 0) for i in range(s, len(falling))}  # without a penalty a step keeps the weights before it
        solved = spark.createDataFrame([(i, j, float(falling[i])) for i, j in steps_of.items()], "to int, step int, penalty double")
        done.append(held.where("col is not null").join(F.broadcast(solved), "step").select(F.col("to").alias("step"), "penalty", "col", "weight"))
    out.weights = spark.createDataFrame(rows, f"step int, penalty double, col {kind}, weight double")
    for more in done:
        out.weights = out.weights.unionByName(more)
    out.penalties = falling
    return out


def conditions(entries: DataFrame, targets: DataFrame, path: LassoPath, tolerance: float = 1e-6) -> DataFrame:
    """(step, col, holds): whether a column's gradient is the penalty with its weight's sign, or not above it without one."""
    spark = entries.sparkSession
    steps = spark.createDataFrame(list(enumerate(path.penalties)), "step int, penalty double")
    own = entries.dropna().join(targets.dropna().select("row"), "row", "left_semi")
    g = gradients(own, targets.dropna(), path.weights.select("step", "col", "weight"), steps)
    joined = g.join(F.broadcast(steps), "step").join(path.weights.select("step", "col", "weight"), ["step", "col"], "left")
    off = _off(F.col("gradient"), F.col("weight"), F.col("penalty"))
    return joined.select("step", "col", (off <= tolerance * F.col("penalty")).alias("holds"))
