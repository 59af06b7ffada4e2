"""What the text operators share: reading texts from Arrow batches, hashing words
without a Python loop, and cutting lineage through the shared folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: ASCII white space: the space and the characters 9 to 13.
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_SAME = np.arange(256, dtype=np.uint8)
_LOWER = _SAME.copy()
_LOWER[65:91] += 32
#: Bytes that are hashed at once; longer texts are cut at white space.
BLOCK_BYTES = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_WORD = (1 << 64) - 1
_powers = {"up": np.ones(1, dtype=np.uint64), "down": np.ones(1, dtype=np.uint64)}


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the driver and all executors share; where none is
    set, in a new temporary folder in local mode, and an error on a cluster."""
    conf = spark.conf.get("spark.checkpoint.dir", None)
    if not conf:
        jsc = spark.sparkContext._jsc.sc()
        if not jsc.getCheckpointDir().isDefined():
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="seqloom-"))
        conf = jsc.getCheckpointDir().get()
    return f"{conf.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again: the lineage
    ends there, and a lost executor costs no recomputation."""
    path = shared_path(df.sparkSession, name)
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def as_bytes(column) -> list[bytes]:
    """An Arrow string column as UTF-8; null is the empty text."""
    return [x if x is not None else b"" for x in column.cast("large_binary").to_pylist()]


def pieces(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Batches in slices of few rows, so that a worker holds little beside the batch."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def mix_int(x: int) -> int:
    """``mix`` of one Python integer."""
    return int(mix(np.array([x & _WORD], dtype=np.uint64))[0])


def _power(kind: str, n: int) -> np.ndarray:
    have = _powers[kind]
    if len(have) < n:
        base = _BASE if kind == "up" else pow(_BASE, -1, 1 << 64)
        more = np.full(max(n, 1 << 16), base, dtype=np.uint64)
        more[0] = 1
        have = np.cumprod(more)
        if n <= 4 * BLOCK_BYTES:
            _powers[kind] = have
    return have[:n]


def _piece(data: bytes, fold: bool) -> tuple[np.ndarray, np.ndarray]:
    buf = np.frombuffer(data, dtype=np.uint8)
    inner = ~SPACE[buf]
    edge = np.flatnonzero(inner[1:] != inner[:-1]) + 1
    bounds = np.concatenate(([0] if len(inner) and inner[0] else [], edge, [len(inner)] if len(inner) and inner[-1] else [])).astype(np.int64)
    start, end = bounds[::2], bounds[1::2]
    if not len(start):
        return start, np.empty(0, dtype=np.uint64)
    total = np.zeros(len(buf) + 1, dtype=np.uint64)
    np.cumsum(((_LOWER if fold else _SAME)[buf].astype(np.uint64) + np.uint64(1)) * _power("up", len(buf)), out=total[1:])
    h = (total[end] - total[start]) * _power("down", len(buf))[start]
    return start, mix(h ^ ((end - start).astype(np.uint64) << np.uint64(40)))


def _long(data: bytes, fold: bool) -> np.ndarray:
    """Hashes of the words of a long text, a piece at a time."""
    found, at = [], 0
    while at < len(data):
        to = min(len(data), at + BLOCK_BYTES)
        if to < len(data):
            gap = np.flatnonzero(SPACE[np.frombuffer(data, dtype=np.uint8, count=to - at, offset=at)])
            if len(gap):
                to = at + int(gap[-1]) + 1
            else:  # a word that is longer than a piece
                while to < len(data) and not SPACE[data[to]]:
                    to += 1
        found.append(_piece(data[at:to], fold)[1])
        at = to
    return np.concatenate(found) if found else np.empty(0, dtype=np.uint64)


def word_hashes(texts: list[bytes], fold: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words ``[^\\x20\\x09-\\x0D]+`` of all texts, with ``fold`` A-Z
    taken as a-z, in order; and how many words each text has."""
    if len(texts) == 1:
        h = _long(texts[0], fold)
        return h, np.array([len(h)], dtype=np.int64)
    start, h = _piece(b"\n".join(texts), fold)
    first = np.cumsum([0] + [len(x) + 1 for x in texts])
    return h, np.diff(np.searchsorted(start, first))


def groups(texts: list[bytes], most: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``most`` bytes; a longer text has a range of its own."""
    at, size = 0, 0
    for i, x in enumerate(texts):
        if i > at and size + len(x) > most:
            yield at, i
            at, size = i, 0
        size += len(x) + 1
    if at < len(texts):
        yield at, len(texts)


class Kept:
    """A bounded cache of two generations: when the young one has ``most`` / 2 entries it
    becomes the old one, and what is asked for again moves back."""

    def __init__(self, most: int):
        self.most, self.young, self.old = most, {}, {}

    def get(self, key):
        got = self.young.get(key)
        if got is None and self.old:
            got = self.old.get(key)
            if got is not None:
                self.put(key, got)
        return got

    def put(self, key, value) -> None:
        if len(self.young) >= self.most // 2:
            self.old, self.young = self.young, {}
        self.young[key] = value
