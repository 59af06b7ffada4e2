"""User-defined associative folds by key, combined where the rows are and then in a tree.

A monoid is written on numpy arrays: ``lift`` turns values into states, ``combine`` joins two
columns of states element by element. A task reduces the runs of each key that it
holds to one state a run, in log2(run) vector steps; partial states then meet in groups of FAN
neighbours, level by level. No row, group or task ever holds the values of a
key, whatever share of the rows it has.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..storage import cut

#: Partial states of a key that meet in one combination.
FAN = 64
#: States that a task of a commutative fold holds before it passes them on.
HELD = 1 << 18

State = tuple[np.ndarray, ...]


@dataclass(frozen=True)
class Monoid:
    """``state`` names the columns of a state with their types, ``zero`` is the neutral state.

    combine(lift(a), lift(b)) must be associative; where it is ``commutative`` as well, rows
    need no order and are not sorted.
    """

    state: str
    zero: tuple
    lift: Callable[..., State]
    combine: Callable[[State, State], State]
    commutative: bool = False

    @property
    def names(self) -> list[str]:
        return StructType.fromDDL(self.state).fieldNames()


def pair(a: Monoid, b: Monoid, on_a: slice = slice(None), on_b: slice = slice(None)) -> Monoid:
    """Both folds in one pass over the rows; ``on_a`` and ``on_b`` say which values each lifts."""
    k = len(a.zero)
    return Monoid(
        f"{a.state}, {b.state}", a.zero + b.zero, lambda *v: (*a.lift(*v[on_a]), *b.lift(*v[on_b])),
        lambda x, y: (*a.combine(x[:k], y[:k]), *b.combine(x[k:], y[k:])), a.commutative and b.commutative,
    )


def reduce_runs(state: State, first: np.ndarray, combine: Callable[[State, State], State]) -> State:
    """The states of the runs that begin at ``first`` (ascending, from 0), each folded from left to right."""
    size = len(state[0])
    length = np.diff(np.append(first, size))
    while len(length) and length.max() > 1:
        start = np.cumsum(length) - length
        place = np.arange(int(length.sum())) - np.repeat(start, length)
        left = np.flatnonzero(place % 2 == 0)
        has = np.repeat(length, length)[left] > place[left] + 1
        joined = combine(tuple(c[left[has]] for c in state), tuple(c[left[has] + 1] for c in state))
        out = []
        for c, new in zip(state, joined):
            kept = c[left]
            kept[has] = new
            out.append(kept)
        state, length = tuple(out), (length + 1) // 2
    return state


def _first_of_runs(columns: list[pa.ChunkedArray], n: int) -> np.ndarray:
    """Where the rows differ from the row before in any column; nulls equal nulls, NaN equals NaN."""
    new = np.zeros(max(n, 1) - 1, dtype=bool)
    for c in columns:
        a, b = c[1:], c[:-1]
        differ = pc.fill_null(pc.not_equal(a, b), True)
        same = pc.and_(pc.is_null(a, nan_is_null=pa.types.is_floating(c.type)), pc.is_null(b, nan_is_null=pa.types.is_floating(c.type)))
        new |= pc.and_not(differ, same).to_numpy(zero_copy_only=False).astype(bool)
    return np.flatnonzero(np.concatenate(([True], new))) if n else np.zeros(0, dtype=np.int64)


def _columns(table: pa.Table, names: list[str]) -> State:
    return tuple(table[c].to_numpy().copy() for c in names)


def _fold_task(keys: list[str], values: list[str], monoid: Monoid, lifted: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A task's rows, sorted by key and order, as one state a key; a key's state goes on over
    batches. Of a commutative fold rows need not be sorted: each batch is, by key, and
    states are held and joined until they are HELD."""
    names = monoid.names

    def reduced(table: pa.Table) -> pa.Table:
        first = _first_of_runs([table[k] for k in keys], len(table))
        got = reduce_runs(_columns(table, names), first, monoid.combine)
        return pa.table({**{k: table[k].take(pa.array(first)) for k in keys}, **dict(zip(names, got))}, schema=table.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, held, rows = TaskContext.get(), None, 0
        part = context.partitionId() if context else 0

        def out(table: pa.Table) -> Iterator[pa.RecordBatch]:
            for b in table.append_column("_part", pa.array(np.full(len(table), part, dtype=np.int64))).combine_chunks().to_batches():
                yield b

        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            if not lifted:
                state = monoid.lift(*_columns(table, values))
                fields = [table.schema.field(k) for k in keys] + [pa.field(n, pa.array(s).type) for n, s in zip(names, state)]
                table = pa.table({**{k: table[k] for k in keys}, **dict(zip(names, state))}, schema=pa.schema(fields))
            if monoid.commutative and keys:
                table = table.sort_by([(k, "ascending") for k in keys])
            table = reduced(table)
            rows += len(table)
            held = table if held is None else pa.concat_tables([held, table.cast(held.schema)])
            if monoid.commutative:
                if rows > HELD:
                    held = reduced(held.combine_chunks().sort_by([(k, "ascending") for k in keys]) if keys else held.combine_chunks())
                    rows = len(held)
                    if rows > HELD // 2:
                        yield from out(held)
                        held, rows = None, 0
            else:
                held = reduced(held.combine_chunks())
                if len(held) > 1:
                    yield from out(held.slice(0, len(held) - 1))
                held = held.slice(len(held) - 1)
        if held is not None and len(held):
            if monoid.commutative:
                held = reduced(held.combine_chunks().sort_by([(k, "ascending") for k in keys]) if keys else held.combine_chunks())
            yield from out(held)

    return run


def partials(rows: DataFrame, keys: list[str], monoid: Monoid, values: list[str], order: list[str] | None = None) -> DataFrame:
    """(keys, states, _part): one state for each key and task (a commutative fold may pass on more)."""
    own = rows.select(*keys, *values, *[c for c in order or [] if c not in keys and c not in values]).dropna(subset=values)
    if not monoid.commutative:
        if not order:
            raise ValueError("a fold that is not commutative needs an order")
        own = own.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    kinds = dict(rows.dtypes)
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), monoid.state, "_part long"])
    return own.mapInArrow(_fold_task(keys, values, monoid, lifted=False), schema)


def fold(rows: DataFrame, keys: list[str], monoid: Monoid, values: list[str], order: list[str] | None = None) -> DataFrame:
    """(keys, states): the fold of each key's values, in ``order`` (which must be total, unless
    the monoid is commutative).

    Rows with a null among ``values`` take no part, so a key of such rows only is not
    returned; null is a key. Ordered rows are range-partitioned by key and order: a
    hot key is cut into as many ranges as its share of rows fills, and its partial states are
    combined FAN at a time, in their order. Without ``keys`` the result is one row, the
    zero where there are no rows.
    """
    found = cut(partials(rows, keys, monoid, values, order), "partials")
    most = found.agg(F.max("_part")).first()[0]
    schema = ", ".join([*(f"`{k}` {dict(rows.dtypes)[k]}" for k in keys), monoid.state, "_part long"])
    while True:
        last = most is None or most < FAN
        # the parts of one combination follow each other; the last level has a single one
        group = F.floor(F.col("_part") / FAN).alias("_up")
        near = found.withColumn("_up", group).repartition(*keys, "_up").sortWithinPartitions(*keys, "_up", "_part")
        got = near.mapInArrow(_level_task(keys, monoid), schema)
        if last:
            break
        found, most = cut(got, "level"), most // FAN
    out = got.select(*keys, *monoid.names)
    if not keys:
        spark, schema = rows.sparkSession, StructType.fromDDL(monoid.state)
        zero = spark.createDataFrame([monoid.zero], schema)
        return out if most is not None else zero
    return out


def _level_task(keys: list[str], monoid: Monoid) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """One state for each (keys, up) of rows sorted by (keys, up, part)."""
    names = monoid.names

    def reduced(table: pa.Table) -> pa.Table:
        first = _first_of_runs([table[k] for k in [*keys, "_up"]], len(table))
        got = reduce_runs(_columns(table, names), first, monoid.combine)
        taken = {k: table[k].take(pa.array(first)) for k in [*keys, "_up", "_part"]}
        return pa.table({**taken, **dict(zip(names, got))}).select(table.column_names).cast(table.schema)

    def out(table: pa.Table) -> Iterator[pa.RecordBatch]:
        yield from table.select([*keys, *names, "_up"]).rename_columns([*keys, *names, "_part"]).combine_chunks().to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            held = reduced(table if held is None else pa.concat_tables([held, table]).combine_chunks())
            if len(held) > 1:
                yield from out(held.slice(0, len(held) - 1))
            held = held.slice(len(held) - 1)
        if held is not None and len(held):
            yield from out(held)

    return run


def maximal_subarray() -> Monoid:
    """The largest sum of consecutive values of one integer column (0 for none of them)."""

    def combine(a: State, b: State) -> State:
        return a[0] + b[0], np.maximum(a[1], a[0] + b[1]), np.maximum(b[2], b[0] + a[2]), np.maximum(np.maximum(a[3], b[3]), a[2] + b[1])

    def lift(v: np.ndarray) -> State:
        v = v.astype(np.int64)
        up = np.maximum(v, 0)
        return v, up, up.copy(), up.copy()

    return Monoid("total long, prefix long, suffix long, best long", (0, 0, 0, 0), lift, combine)


def longest_run() -> Monoid:
    """The longest run of consecutive rows whose boolean value holds."""

    def combine(a: State, b: State) -> State:
        return a[0] + b[0], np.where(a[1] == a[0], a[0] + b[1], a[1]), np.where(b[2] == b[0], b[0] + a[2], b[2]), np.maximum(np.maximum(a[3], b[3]), a[2] + b[1])

    def lift(v: np.ndarray) -> State:
        one = v.astype(np.int64)
        return np.ones(len(v), dtype=np.int64), one, one.copy(), one.copy()

    return Monoid("rows long, lead long, trail long, longest long", (0, 0, 0, 0), lift, combine)


def two_largest() -> Monoid:
    """The two largest different values of a numeric column; -infinity where there are not as many."""
    low = -np.inf

    def combine(a: State, b: State) -> State:
        first = np.maximum(a[0], b[0])
        rest = [np.where(x < first, x, low) for x in (a[0], a[1], b[0], b[1])]
        return first, np.maximum.reduce(rest)

    return Monoid("largest double, second double", (low, low), lambda v: (v.astype(np.float64), np.full(len(v), low)), combine, commutative=True)


def affine(modulus: int) -> Monoid:
    """The composition of maps x -> m * x + c, in order, modulo a number below 2**31."""

    def combine(f: State, g: State) -> State:
        return g[0] * f[0] % modulus, (g[0] * f[1] + g[1]) % modulus

    return Monoid("slope long, shift long", (1, 0), lambda m, c: (m.astype(np.int64) % modulus, c.astype(np.int64) % modulus), combine)
