"""Language-model scoring with a hierarchical Pitman-Yor model.

A word is drawn in two steps. First a symbol: one of the TABLE most frequent words, the
end, or RARE for all other words, from the restaurant of the word before it. Every word
of the corpus (and the end) has such a context restaurant, and all share one parent.
Then, for RARE, the word itself, from a restaurant of all other words, whose base gives
half its mass to words that training has not seen. Seating is sampled by Gibbs: a sweep
seats all customers of every dish anew, by drawing how many tables they take, which is
all that predictions depend on. Context restaurants are seated given the parent, the
parent given their tables, and the contexts again; predictive probabilities are
averaged over the last sweeps.

Counts are over all training texts. Occurrences of (word before, symbol) go, packed, to
buckets by the word before (for the CONTEXTS most frequent by the pair, as one of them
may hold a large share of all rows), are counted and seated there, and are scored
there; a bucket holds about BUCKET occurrences, so there are more of them in a larger
corpus. Words are told apart by 64-bit hashes, and what is drawn for a pair or a word
follows from its hash, so partitioning changes nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes, cut, groups, mix, mix_int, pieces, shared_path, word_hashes

#: Frequent words whose restaurants are split over buckets, and words that are symbols (their table is broadcast).
CONTEXTS, TABLE = 512, 131_072
#: Gibbs sweeps before the first sample, and samples.
BURN_IN, SAMPLES = 4, 8
STRENGTH, ROOT_DISCOUNT = 1.0, 0.5
#: Customers of a dish up to which the law of its tables is exact.
EXACT = 512
#: Words that a task gathers before it passes on their counts; occurrences that it packs at once; those of a bucket.
GATHER, PACK, BUCKET = 400_000, 400_000, 400_000
#: Bytes of packed buckets that a task reads.
SPLIT = 16 << 20
#: Texts that a worker gets at once, and bytes of them that it takes apart at once.
TEXTS, BLOCK = 1_000, 1 << 17
#: Sums of texts that a task gathers before it passes them on.
HELD = 500_000
#: The end as a context.
END = np.uint64(0)


def held_out(doc_id: str) -> Column:
    """crc32 of the id as text, mod 7, is 2; false for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 7 == 2, F.lit(False))


class Tables:
    """How many tables the n customers of a dish take, where a new table for the dish has
    the weight f and one of m customers m - d: P(t) is in proportion to f^t S(n, t), S
    being the generalised Stirling numbers."""

    def __init__(self, d: float, most: int = EXACT):
        self.d, self.most = d, most
        self.log = [np.empty(0), np.zeros(1)]  # log S(n, 1..n)
        for n in range(1, most):
            old = self.log[-1]
            with np.errstate(divide="ignore"):
                stay = np.append(old + np.log(n - d * np.arange(1, n + 1)), -np.inf)
            self.log.append(np.logaddexp(stay, np.concatenate(([-np.inf], old))))

    def law(self, n: int, f: np.ndarray) -> np.ndarray:
        """Cumulative probabilities of 1..n tables, a row for each weight."""
        w = self.log[n][None, :] + np.arange(1, n + 1)[None, :] * np.log(f)[:, None]
        w = np.cumsum(np.exp(w - w.max(axis=1, keepdims=True)), axis=1)
        return w / w[:, -1:]

    def draw(self, n: np.ndarray, f: np.ndarray, u: np.ndarray) -> np.ndarray:
        """The tables at the quantiles ``u``, dish by dish; none without customers."""
        out = (n > 0).astype(np.int64)
        small = np.minimum(n, self.most)
        order = np.argsort(small, kind="stable")
        bounds = np.searchsorted(small[order], np.arange(2, self.most + 2))
        for k in range(len(bounds) - 1):
            at = order[bounds[k] : bounds[k + 1]]
            for own in np.array_split(at, len(at) // 1024 + 1) if len(at) else ():
                out[own] = 1 + (self.law(k + 2, f[own]) < u[own, None]).sum(axis=1)
        large = np.flatnonzero(n > self.most)
        if len(large):
            mean, sd = self._saddle(n[large].astype(float), f[large])
            # few tables: their law has come to its limit by EXACT customers
            many = mean > 8
            at = large[many]
            # the mean is above the saddle point by about this much
            off = sd[many] ** 2 / mean[many]
            out[at] = np.clip(np.rint(mean[many] + off + sd[many] * _normal_quantile(u[at])), 1, n[at])
        return out

    def _saddle(self, n: np.ndarray, f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Mean and deviation of the tables of many customers, by the saddle point: tables
        are a Poisson number of sizes with the generating function 1 - (1 - z)^d, given
        that the sizes add up to n."""
        d, lo, hi = self.d, np.full(len(n), -60.0), np.zeros(len(n))
        for _ in range(80):  # y = log(1 - x), where f x (1 - x)^(d - 1) = n
            y = (lo + hi) / 2
            over = f * -np.expm1(y) * np.exp((d - 1) * y) > n
            lo, hi = np.where(over, y, lo), np.where(over, hi, y)
        y = (lo + hi) / 2
        x, phi = -np.expm1(y), -np.expm1(d * y)
        mean = f / d * phi
        second = (x * d * np.exp((d - 1) * y) + x * x * d * (1 - d) * np.exp((d - 2) * y)) / phi
        return mean, np.sqrt(np.maximum(mean * (1 - (n / mean) ** 2 / second), 0.0))


def _normal_quantile(u: np.ndarray) -> np.ndarray:
    grid = np.linspace(-6, 6, 4001)
    at = 0.5 * (1 + np.array([math.erf(x / math.sqrt(2)) for x in grid]))
    return np.interp(u, at, grid)


def discount(once: int, twice: int, none: float) -> float:
    """The discount that once- and twice-seen dishes suggest."""
    return float(np.clip(once / (once + 2 * twice) if once else none, 0.1, 0.95))


def parent_of(dishes: np.ndarray, turn: int, seed: int = 5) -> np.ndarray:
    """The parent's probabilities, after a sweep that seats its customers, one for each
    table below; its base is even."""
    size, rng = len(dishes), np.random.default_rng([seed, turn])
    above, at_root = Tables(ROOT_DISCOUNT), np.minimum(dishes, 1)
    for _ in range(BURN_IN):
        new = (STRENGTH + ROOT_DISCOUNT * at_root.sum()) / size
        at_root = above.draw(dishes, np.full(size, new), rng.random(size))
    new = (STRENGTH + ROOT_DISCOUNT * at_root.sum()) / size
    return (dishes - ROOT_DISCOUNT * at_root + new) / (STRENGTH + dishes.sum())


def seat(seats: Tables, u: np.ndarray, f: np.ndarray, c: np.ndarray, code: np.ndarray, given: np.ndarray, parent: np.ndarray, turn: int, sweeps: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """After each sweep the tables of each pair and of each context. Pairs (u, f) have c
    customers and draw by their ``code``; ``given`` has the tables that contexts had a turn
    ago whose pairs are not all here, and -1 for the others."""
    here = given < 0
    below = np.where(here, np.bincount(u, weights=np.minimum(c, 1), minlength=len(given)), given)
    several = np.flatnonzero(c > 1)
    t = np.minimum(c, 1)
    for i in range(sweeps):
        at = several
        x = mix(code[at] ^ np.uint64(mix_int(64 * turn + i + 1))) / 2.0**64
        t = t.copy()
        t[at] = seats.draw(c[at], (STRENGTH + seats.d * below[u[at]]) * parent[f[at]], x)
        below = np.where(here, np.bincount(u, weights=t, minlength=len(given)), given)
        yield t, below


def rare_weight(counts: np.ndarray, words: np.ndarray, d: float, share: float) -> float:
    """The weight of a new table for a word of the restaurant of rare words, each of which
    has ``share`` of the base: that which the expected tables of ``words`` words of each of
    ``counts`` customers give themselves."""
    seats, all_t = Tables(d), float(words.sum())
    for _ in range(30):
        f = (STRENGTH + d * all_t) * share
        laws = [seats.law(int(n), np.array([f]))[0] for n in np.minimum(counts, EXACT)]
        all_t = float(sum(k * (len(x) + 1 - x.sum()) for k, x in zip(words, laws, strict=True)))
    return (STRENGTH + d * all_t) * share


def _train(docs: DataFrame) -> DataFrame:
    return docs.where(~held_out("doc_id")).select("text")


def word_counts(train: DataFrame) -> DataFrame:
    """(h, c): hashes of words and their counts, ends not included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def passed() -> pa.RecordBatch:
            h, c = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c.astype(np.int64))], names=["h", "c"])

        for batch in pieces(batches):
            texts = as_bytes(batch.column(0))
            for a, b in groups(texts, BLOCK):
                h, _ = word_hashes(texts[a:b])
                held.append(h)
                size += len(h)
                if size >= GATHER:
                    yield passed()
                    held, size = [], 0
        if held:
            yield passed()

    return train.mapInArrow(run, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


def _symbols(h: np.ndarray, counts: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes and symbols of the texts' words with an end after each text: symbols are places in
    ``known``, one more for all other words, one more for the end."""
    at = np.clip(np.searchsorted(known, h), 0, max(len(known) - 1, 0))
    symbol = np.where(known[at] == h, at, len(known)) if len(known) else np.zeros(len(h), dtype=np.int64)
    ends = np.cumsum(counts + 1) - 1
    code, out = np.full(len(h) + len(counts), END), np.full(len(h) + len(counts), len(known) + 1)
    words = np.ones(len(out), dtype=bool)
    words[ends] = False
    code[words], out[words] = h, symbol
    return code, out


def _member(x: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Whether each is in ``of``, which is in order."""
    return of[np.clip(np.searchsorted(of, x), 0, len(of) - 1)] == x


def _each(rows: pa.RecordBatch | pa.Table) -> Iterator[dict]:
    """Rows one by one: they are large."""
    for j in range(rows.num_rows):
        yield rows.slice(j, 1).to_pylist()[0]
    pa.default_memory_pool().release_unused()


def occurrences(own: DataFrame, known, hot, buckets: int, kind: str) -> DataFrame:
    """All occurrences of (word before, symbol) by bucket, a row for each bucket, and a row for
    each batch of texts with their ids; own is (doc_id, key, held, text).

    A bucket's contexts ``u`` have ``k`` pairs each, with symbols ``s`` in order, ``c``
    customers in training and ``m`` occurrences. Of an occurrence ``at`` is twice the text's
    place in its batch, one more for a held-out text, below the batch's place in ``batches``
    (from bit 16).
    """
    names = ["bucket", "batch", "u", "k", "s", "at", "c", "m", "batches", "docs", "keys"]
    schema = f"bucket long, batch long, u binary, k binary, s binary, at binary, c binary, m binary, batches binary, docs array<{kind}>, keys array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known_, hot_ = known.value, hot.value
        held, docs, keys, size, serial = [], [], [], 0, TaskContext.get().partitionId() << 32

        def passed() -> pa.RecordBatch:
            u, s, at = (np.concatenate([x[j] for x in held]) for j in range(3))
            held.clear()
            b = mix(np.where(_member(u, hot_), u ^ mix(s.astype(np.uint64) + np.uint64(1)), u))
            b = (b % np.uint64(buckets)).astype(np.int32)
            order = np.lexsort((u, b))
            u, s, at, b = u[order], s[order], at[order], b[order]
            del order
            first = np.flatnonzero(np.concatenate(([True], b[1:] != b[:-1])))
            out = [[] for _ in names]
            for x, y in zip(first, [*first[1:], len(b)], strict=True):
                new = np.flatnonzero(np.concatenate(([True], u[x + 1 : y] != u[x : y - 1])))
                run_ = (int(b[x]), serial, u[x:y][new].tobytes(), np.diff([*new, y - x]).astype("<u4").tobytes(), np.ascontiguousarray(s[x:y].view(np.uint8).reshape(-1, 4)[:, :3]).tobytes(), at[x:y].tobytes(), *[None] * 5)
                for column, value in zip(out, run_, strict=True):
                    column.append(value)
            for column, value in zip(out, (-1 - serial % 61, serial, *[None] * 6, np.int64(serial).tobytes(), docs, keys), strict=True):
                column.append(value)
            return pa.RecordBatch.from_arrays([pa.array(x, type=t) for x, t in zip(out, types, strict=True)], names=names)

        types = [pa.int64(), pa.int64(), *[pa.binary()] * 7, None, pa.list_(pa.int64())]
        for batch in pieces(batches):
            types[9] = pa.list_(batch.schema.field(0).type)
            texts, ids, key, apart = as_bytes(batch.column(3)), batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_numpy(zero_copy_only=False)
            for a, b in groups(texts, BLOCK):
                h, n = word_hashes(texts[a:b])
                code, s = _symbols(h, n, known_)
                place = np.arange(len(docs), len(docs) + b - a) * 2 + apart[a:b]
                held.append((np.concatenate(([END], code[:-1])), s.astype("<u4"), np.repeat(place.astype("<u2"), n + 1)))
                docs, keys, size = docs + ids[a:b], keys + key[a:b], size + len(s)
                if size >= PACK or len(docs) >= 32_000:
                    yield passed()
                    held, docs, keys, size, serial = [], [], [], 0, serial + 1
                    pa.default_memory_pool().release_unused()
        if held:
            yield passed()

    def merge(rows: pa.Table) -> pa.Table:
        if rows["bucket"][0].as_py() < 0:
            return rows
        got = [[], [], [], []]
        for j, r in enumerate(_each(rows.select(["batch", "u", "k", "s", "at"]))):
            three = np.frombuffer(r["s"], dtype=np.uint8).reshape(-1, 3).astype(np.int64)
            got[0].append(np.repeat(np.frombuffer(r["u"], dtype="<u8"), np.frombuffer(r["k"], dtype="<u4")))
            got[1].append((three[:, 0] + (three[:, 1] << 8) + (three[:, 2] << 16)).astype("<u4"))
            got[2].append(np.frombuffer(r["at"], dtype="<u2").astype("<u8") + np.uint64(j << 16))
            got[3].append(r["batch"])
        u, s, at = (np.concatenate(x) for x in got[:3])
        order = np.lexsort((s, u))
        u, s, at = u[order], s[order], at[order]
        pair = np.flatnonzero(np.concatenate(([True], (u[1:] != u[:-1]) | (s[1:] != s[:-1]))))
        c = np.add.reduceat((at & np.uint64(1)) == 0, pair, dtype=np.int64).astype("<u4")
        m, u, s = np.diff([*pair, len(u)]).astype("<u4"), u[pair], s[pair]
        new = np.flatnonzero(np.concatenate(([True], u[1:] != u[:-1])))
        at = at if len(got[3]) > 65_536 else at.astype("<u4")
        packed = (u[new].tobytes(), np.diff([*new, len(u)]).astype("<u4").tobytes(), s.tobytes(), at.tobytes(), c.tobytes(), m.tobytes(), np.array(got[3], dtype="<i8").tobytes())
        columns = [rows["bucket"].slice(0, 1), rows["batch"].slice(0, 1), *(pa.array([x], type=pa.binary()) for x in packed), pa.array([None], type=rows.schema.field("docs").type), pa.array([None], type=pa.list_(pa.int64()))]
        return pa.table(columns, names=names)

    return own.mapInArrow(run, schema).groupBy("bucket").applyInArrow(merge, schema)


def _bucket(row: dict, hot: np.ndarray) -> tuple:
    """A bucket's contexts, their place among ``hot`` or -1, and its pairs' contexts, symbols,
    customers and codes."""
    codes, k, s, c = (np.frombuffer(row[x], dtype=t) for x, t in (("u", "<u8"), ("k", "<u4"), ("s", "<u4"), ("c", "<u4")))
    u = np.repeat(np.arange(len(codes)), k)
    place = np.where(_member(codes, hot), np.searchsorted(hot, codes), -1)
    return codes, place, u, s.astype(np.int64), c.astype(np.int64), mix(codes[u] ^ mix(s.astype(np.uint64) + np.uint64(1)))


def tables_below(packed: DataFrame, hot, state=None, sweeps: int = 0, keep: int = 0) -> dict[int, np.ndarray]:
    """Sums over all context restaurants after a turn of sweeps (without a state: where each
    dish has one table): 0, tables by symbol; 1, tables by frequent context; 2, dishes of one
    customer and of two. With ``keep``, 1 alone, after each of that many last sweeps of the
    next turn, one sweep's behind the other's. TABLE + 8 * CONTEXTS + 12 rows at most reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot_, seats = hot.value, Tables(state.value[0]) if state else None
        for batch in batches:
            for row in _each(batch):
                _, place, u, s, c, code = _bucket(row, hot_)
                if keep:
                    own = place[u] >= 0
                    u, s, c, code = u[own], s[own], c[own], code[own]
                t, by_sweep = np.minimum(c, 1), []
                if state:
                    _, parent, below = state.value
                    by_sweep = [t for t, _ in seat(seats, u, s, c, code, np.where(place >= 0, below[place], -1.0), parent, 2 if keep else 1, sweeps)][-max(keep, 1) :]
                    t = by_sweep[-1]
                frequent = place[u] >= 0
                by_hot = [np.bincount(place[u][frequent], weights=x[frequent], minlength=len(hot_)) for x in (by_sweep if keep else [t])]
                sums = [np.empty(0), np.concatenate(by_hot)] if keep else [np.bincount(s, weights=t), by_hot[0], np.array([(c == 1).sum(), (c == 2).sum()])]
                for which, x in enumerate(sums):
                    i = np.flatnonzero(x)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), which)), pa.array(i), pa.array(x[i].astype(np.int64))], names=["which", "i", "n"])

    rows = packed.where("bucket >= 0").select("u", "k", "s", "c").mapInArrow(run, "which long, i long, n long").groupBy("which", "i").agg(F.sum("n").alias("n")).toPandas()
    return {w: rows[rows["which"] == w] for w in range(3)}


def context_scores(packed: DataFrame, hot, state) -> DataFrame:
    """(doc_id, key, x): the sum of log10 of the averaged predictive probabilities of a text's symbols."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        d, parent, below, arrived_hot, totals = state.value
        seats, held = Tables(d), {}

        def passed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held)), pa.array([x.astype("<f8").tobytes() for x in held.values()], type=pa.binary())], names=["batch", "x"])

        for batch in batches:
            for row in _each(batch):
                codes, place, u, s, c, code = _bucket(row, hot.value)
                arrived = np.where(place >= 0, arrived_hot[place], np.bincount(u, weights=c, minlength=len(codes)))
                p = np.zeros(len(u))
                for i, (t, tables) in enumerate(seat(seats, u, s, c, code, np.where(place >= 0, below[place], -1.0), parent, 2, BURN_IN + SAMPLES)):
                    if i >= BURN_IN:
                        tables = np.where(place >= 0, totals[i - BURN_IN][place], tables)
                        p += (c - d * t + (STRENGTH + d * tables[u]) * parent[s]) / (STRENGTH + arrived[u])
                p = np.log10(p / SAMPLES)
                m = np.frombuffer(row["m"], dtype="<u4")
                at = np.frombuffer(row["at"], dtype="<u4" if len(row["at"]) == 4 * m.sum(dtype=np.int64) else "<u8")
                batch_no, text = (at >> 16).astype(np.int64), ((at & 65535) >> 1).astype(np.int64)
                order = np.argsort(batch_no, kind="stable")
                bounds = np.searchsorted(batch_no[order], np.arange(len(row["batches"]) // 8 + 1))
                value = np.repeat(p, m)
                for one, x, y in zip(np.frombuffer(row["batches"], dtype="<i8").tolist(), bounds, bounds[1:], strict=False):
                    sums = np.bincount(text[order[x:y]], weights=value[order[x:y]])
                    if one in held and len(held[one]) >= len(sums):
                        held[one][: len(sums)] += sums
                    else:
                        sums[: len(held.get(one, ()))] += held.get(one, 0.0)
                        held[one] = sums
                if sum(map(len, held.values())) > HELD:
                    yield passed()
                    held.clear()
        if held:
            yield passed()

    def add(rows: pa.Table) -> pa.Table:
        texts, sums = None, np.zeros(65_536)
        for r in _each(rows):
            if r["keys"] is not None:
                texts = rows.schema.field("docs").type, r["docs"], r["keys"]
            else:
                sums[: len(r["x"]) // 8] += np.frombuffer(r["x"], dtype="<f8")
        kind, docs, keys = texts
        return pa.table([pa.array(docs, type=kind.value_type), pa.array(keys, type=pa.int64()), pa.array(sums[: len(docs)])], names=["doc_id", "key", "x"])

    sums = packed.where("bucket >= 0").select("u", "k", "s", "c", "m", "at", "batches").mapInArrow(run, "batch long, x binary")
    texts = packed.where("bucket < 0").select("batch", "docs", "keys")
    kind = texts.schema["docs"].dataType.elementType.simpleString()
    return sums.unionByName(texts, allowMissingColumns=True).groupBy("batch").applyInArrow(add, f"doc_id {kind}, key long, x double")


def rare_tables(words: DataFrame, discount: float, fresh: float) -> DataFrame:
    """words (h, c) with t: the tables of each word in the restaurant of rare words, averaged
    over SAMPLES draws that follow from the word's hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seats = Tables(discount)
        laws = [np.empty(0), *(seats.law(n, np.array([fresh]))[0] for n in range(1, EXACT + 1))]
        for batch in batches:
            h = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            n = np.minimum(batch.column(1).to_numpy(zero_copy_only=False), EXACT)
            t = np.ones(len(n))
            order = np.argsort(n, kind="stable")
            bounds = np.searchsorted(n[order], np.arange(2, EXACT + 2))
            for k in range(len(bounds) - 1):
                own = order[bounds[k] : bounds[k + 1]]
                if len(own):
                    u = [mix(h[own] ^ np.uint64(mix_int(s + 1))) / 2.0**64 for s in range(SAMPLES)]
                    t[own] = np.mean([1 + np.searchsorted(laws[k + 2], x) for x in u], axis=0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(t)], names=["h", "c", "t"])

    return words.select("h", "c").mapInArrow(run, "h long, c long, t double")


@contextmanager
def _settings(spark: SparkSession, values: dict[str, int]) -> Iterator[None]:
    """The session's settings while jobs run."""
    before = {name: spark.conf.get(name) for name in values}
    for name, value in values.items():
        spark.conf.set(name, str(value))
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def _small_splits(spark: SparkSession):
    """Buckets are large rows: while their jobs run, a task reads SPLIT bytes of them, and few
    at once; they go to its worker one by one."""
    return _settings(spark, {"spark.sql.files.maxPartitionBytes": SPLIT, "spark.sql.parquet.columnarReaderBatchSize": 8, "spark.sql.execution.arrow.maxRecordsPerBatch": 1})


def _few_texts(spark: SparkSession):
    """While jobs over texts run, a worker gets TEXTS of them at once."""
    return _settings(spark, {"spark.sql.execution.arrow.maxRecordsPerBatch": TEXTS})


def score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", contexts: int = CONTEXTS, table: int = TABLE, bucket: int = BUCKET) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 of the
    text's probability) and perplexity (by token), one row for each row.

    Tokens are words ``[^\\x20\\x09-\\x0D]+`` with A-Z as a-z, then one end. Words that
    training has not seen are one event together, in base_score as in score. A null
    text counts as empty (its end alone is scored); a row with a null id is learned
    from. Repeated rows are learned from and scored each. Without training texts all
    symbols are alike. An empty table gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    train = _train(own)
    with _few_texts(spark):
        counts = cut(word_counts(train), "counts")
    ends = train.select(F.lit(1)).count()
    sums = counts.agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("k"), F.count_if(F.col("c") == 1).alias("one"), F.count_if(F.col("c") == 2).alias("two")).first()
    n_words, n_types, once, twice = sums["n"] or 0, sums["k"], sums["one"], sums["two"]
    total, types = n_words + ends, n_types + (ends > 0)
    top = counts.orderBy(F.desc("c"), "h").limit(table).toPandas()  # ``table`` rows at most
    top["code"] = top["h"].to_numpy(dtype=np.int64).view(np.uint64)
    rare_n, rare_types = int(n_words - top["c"].sum()), int(n_types - len(top))
    rare = counts.where(F.lit(False))
    if rare_types:
        last = top.iloc[-1] if len(top) else None
        rare = counts if last is None else counts.where((F.col("c") < int(last["c"])) | ((F.col("c") == int(last["c"])) & (F.col("h") > int(last["h"]))))

    # the context restaurants
    frequent = top.head(contexts).sort_values("code")
    hot_codes = np.concatenate(([END], frequent["code"].to_numpy()))  # a word's hash is not END but by chance
    arrived = np.concatenate(([ends], frequent["c"].to_numpy())).astype(float)
    top = top.sort_values("code")
    spark_ = spark.sparkContext
    known, hot = spark_.broadcast(top["code"].to_numpy()), spark_.broadcast(hot_codes)
    kind = own.schema["doc_id"].dataType.simpleString()
    keyed = own.select("doc_id", F.xxhash64("text").alias("key"), held_out("doc_id").alias("held"), "text")
    pairs = occurrences(keyed, known, hot, 1 + int(total) // bucket, kind)
    path = shared_path(spark, "pairs")
    with _few_texts(spark):
        pairs.write.parquet(path)
    packed = spark.read.schema(pairs.schema).parquet(path)
    size = len(top) + 2

    def dense(rows, n: int) -> np.ndarray:
        out = np.zeros(n, dtype=np.int64)
        out[rows["i"].to_numpy(dtype=np.int64)] = rows["n"]
        return out

    with _small_splits(spark):
        start = tables_below(packed, hot)
        one, two = dense(start[2], 2)
        d_pairs = discount(one, two, 0.1)
        wide = len(hot_codes)
        state = spark_.broadcast((d_pairs, parent_of(dense(start[0], size), 0), dense(start[1], wide).astype(float)))
        seated = tables_below(packed, hot, state, BURN_IN)
        again = (d_pairs, parent_of(dense(seated[0], size), 1), dense(seated[1], wide).astype(float))
        totals = tables_below(packed, hot, spark_.broadcast(again), BURN_IN + SAMPLES, SAMPLES)
        state = spark_.broadcast((*again, arrived, dense(totals[1], wide * SAMPLES).reshape(SAMPLES, wide)))
        scored = context_scores(packed, hot, state)
        path = shared_path(spark, "context")
        scored.write.parquet(path)
        by_context = spark.read.schema(scored.schema).parquet(path)

    # the restaurant of the other words
    d = discount(once, twice, 0.5)
    unseen = 0.5
    shared = (1 - unseen) / max(rare_types, 1)
    sizes = rare.groupBy(F.least("c", F.lit(EXACT)).alias("n")).agg(F.count(F.lit(1)).alias("k")).orderBy("n").toPandas()  # EXACT rows at most
    words = cut(rare_tables(rare, d, rare_weight(sizes["n"].to_numpy(), sizes["k"].to_numpy(dtype=float), d, shared)), "words")
    rare_t = words.agg(F.sum("t")).first()[0] or 0.0
    scale, fresh = STRENGTH + rare_n, STRENGTH + d * rare_t
    p_unseen = float(np.log10(fresh * (unseen if rare_types else 1.0) / scale))
    model = spark_.broadcast((top["code"].to_numpy(), top["c"].to_numpy(dtype=np.int64)))
    log_all = float(np.log10(total + types + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table_h, table_c = model.value
        names = ["doc_id", "key", "h", "m", "n_tokens", "n_known", "base"]
        for batch in pieces(batches):
            texts, doc, keys = as_bytes(batch.column(1)), batch.column(0), batch.column(2).to_numpy(zero_copy_only=False)
            for a, b in groups(texts, BLOCK):
                h, n = word_hashes(texts[a:b])
                at = np.clip(np.searchsorted(table_h, h), 0, max(len(table_h) - 1, 0))
                seen = table_h[at] == h if len(table_h) else np.zeros(len(h), dtype=bool)
                word_first = np.concatenate(([0], np.cumsum(n)))
                sums = [np.concatenate(([0], np.cumsum(x))) for x in (seen, np.where(seen, np.log10(table_c[at] + 1.0), 0.0) if len(table_h) else np.zeros(len(h)))]
                got = [x[word_first[1:]] - x[word_first[:-1]] for x in sums]
                k = b - a
                ids_ = doc.slice(a, k)
                zeros = np.zeros(k, dtype=np.int64)
                yield pa.RecordBatch.from_arrays(
                    [ids_, pa.array(keys[a:b]), pa.array(keys[a:b]), pa.array(zeros), pa.array(n + 1), pa.array(got[0].astype(np.int64) + (ends > 0)), pa.array(got[1] + float(np.log10(ends + 1)))], names=names
                )
                # words outside the table go to their counts, one row for each text and word
                text = np.repeat(np.arange(k), n)[~seen]
                rest = h[~seen]
                if len(rest):
                    order = np.lexsort((rest, text))
                    text, rest = text[order], rest[order]
                    new = np.flatnonzero(np.concatenate(([True], (text[1:] != text[:-1]) | (rest[1:] != rest[:-1]))))
                    times = np.diff(np.concatenate((new, [len(text)])))
                    text, rest = text[new], rest[new]
                    none = np.zeros(len(text), dtype=np.int64)
                    yield pa.RecordBatch.from_arrays([ids_.take(pa.array(text)), pa.array(keys[a:b][text]), pa.array(rest.view(np.int64)), pa.array(times), pa.array(none), pa.array(none), pa.array(none.astype(float))], names=names)

    rows = own.select("doc_id", "text", F.xxhash64("text").alias("key")).mapInArrow(run, f"doc_id {kind}, key long, h long, m long, n_tokens long, n_known long, base double")
    # the text's own row has m = 0 and meets no word
    met = rows.join(words.withColumnRenamed("h", "_h"), (F.col("h") == F.col("_h")) & (F.col("m") > 0), "left")
    p = F.when(F.col("c").isNull(), F.lit(p_unseen)).otherwise(F.log10((F.col("c") - d * F.col("t") + fresh * shared) / scale))
    met = met.select(
        "doc_id", "key", (F.col("m") == 0).cast("long").alias("copies"), F.col("n_tokens").alias("n"), (F.col("n_known") + F.when(F.col("c") > 0, F.col("m")).otherwise(0)).alias("k"),
        (F.col("base") + F.col("m") * F.log10(F.coalesce("c", F.lit(0)) + 1.0)).alias("b"), F.when(F.col("m") > 0, F.col("m") * p).otherwise(0.0).alias("s"),
    )
    zero = F.lit(0).cast("long")
    met = met.unionByName(by_context.select("doc_id", "key", zero.alias("copies"), zero.alias("n"), zero.alias("k"), F.lit(0.0).alias("b"), F.col("x").alias("s")))
    with _few_texts(spark):
        by_text = cut(met.groupBy("doc_id", "key").agg(*(F.sum(x).alias(x) for x in ("copies", "n", "k", "b", "s"))), "texts")
    by_text = by_text.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    n = (F.col("n") / F.col("copies")).cast("long")
    return by_text.select(
        F.col("doc_id").alias(doc_id), held_out("doc_id").alias("held_out"), n.alias("n_tokens"), (F.col("k") / F.col("copies")).cast("long").alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("b") / F.col("copies") - n * log_all).alias("base_score"), (F.col("s") / F.col("copies")).alias("score"), F.pow(F.lit(10.0), -F.col("s") / F.col("n")).alias("perplexity"),
    )
