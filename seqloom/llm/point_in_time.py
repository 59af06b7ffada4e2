"""Point-in-time join through persistent ordered trees.

A version is usable from the later of its event and its arrival until its expiry. Time is
cut into chunks; in each chunk of a source the versions that begin or end there are
edits of an ordered tree of the active ones. An edit copies the path from the root to
its key, so every moment keeps a root of its own, and a question binary-searches the
root of its moment and reads the largest key in it.

Versions are clipped to their chunks and of equal clippings the largest is kept before
the shuffle, so a chunk of any source holds at most CHUNK * (CHUNK + 1) / 2 of them, however
many rows the source has. What covers whole chunks goes to the nodes of a binary
hierarchy over the chunks, of which each keeps its largest version only.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Moments in a chunk.
CHUNK = 64


class PersistentTree:
    """An ordered tree over keys 0..n-1, in which ``edit`` puts a key in or takes it out and
    returns the root of the new version; all older roots stay as they were.

    Inner nodes split their range of keys in halves; node 0 is the empty subtree. ``top``
    is the largest key in a node's subtree, -1 where there is none.
    """

    def __init__(self, n: int):
        self.depth = max(1, int(n - 1).bit_length())
        self.left, self.right, self.top = [0], [0], [-1]

    def edit(self, root: int, key: int, there: bool) -> int:
        """Copies the path from ``root`` to ``key``."""
        path, at = [], root
        for d in range(self.depth - 1, -1, -1):
            up = (key >> d) & 1
            path.append((at, up))
            at = self.right[at] if up else self.left[at]
        new = self._node(0, 0, key) if there else 0
        for at, up in reversed(path):
            a, b = (self.left[at], new) if up else (new, self.right[at])
            new = self._node(a, b, self.top[b] if b else self.top[a]) if a or b else 0
        return new

    def _node(self, left: int, right: int, top: int) -> int:
        self.left.append(left)
        self.right.append(right)
        self.top.append(top)
        return len(self.top) - 1


def answer(lo: np.ndarray, hi: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """For each moment asked, the largest k with lo[k] <= moment < hi[k], -1 if there is none."""
    if not len(lo):
        return np.full(len(asked), -1, dtype=np.int64)
    tree = PersistentTree(len(lo))
    edits = sorted([(t, 1, k) for k, t in enumerate(lo.tolist())] + [(t, 0, k) for k, t in enumerate(hi.tolist())])
    moments, roots, root = [], [], 0
    for t, there, k in edits:
        root = tree.edit(root, k, bool(there))
        if moments and moments[-1] == t:
            roots[-1] = root
        else:
            moments.append(t)
            roots.append(root)
    at = [bisect_right(moments, t) - 1 for t in asked.tolist()]
    return np.array([tree.top[roots[i]] if i >= 0 else -1 for i in at], dtype=np.int64)


def _answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (source, chunk), and within these versions by key, then questions;
    a group that may go on in the next batch is held until it ends."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([*held, batch]).combine_chunks()
        source, chunk = table["source"], table["chunk"]
        new = pc.or_(pc.not_equal(source[1:], source[:-1]), pc.not_equal(chunk[1:], chunk[:-1])).to_numpy().astype(bool) if len(table) > 1 else np.zeros(0, dtype=bool)
        bounds = np.flatnonzero(np.concatenate(([True], new)))
        yield from _answered(table, bounds)
        held = table.slice(int(bounds[-1])).to_batches()
    if held:
        table = pa.Table.from_batches(held).combine_chunks()
        yield from _answered(table, np.array([0, len(table)]))


def _answered(table: pa.Table, bounds: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The answers of the groups between consecutive bounds, as one batch."""
    lo, hi, chunk = (table[c].to_numpy() for c in ("lo", "hi", "chunk"))
    asked, best = [np.empty(0, dtype=np.int64)], [np.empty(0, dtype=np.int64)]
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        n = a + int(np.count_nonzero(hi[a:b] >= 0))
        if a < n < b:
            found = answer(lo[a:n], hi[a:n], lo[n:b])
            hit = np.flatnonzero(found >= 0)
            asked.append(n + hit)
            best.append(a + found[hit])
    q, k = np.concatenate(asked), np.concatenate(best)
    if len(q):
        yield pa.RecordBatch.from_arrays([table["source"].take(pa.array(q)).combine_chunks(), pa.array(chunk[q] * CHUNK + lo[q]), table["best"].take(pa.array(k)).combine_chunks()], names=["source", "t", "best"])


def _node(level: int, node: Column) -> Column:
    return F.struct(F.lit(level).alias("level"), node.cast("long").alias("node"))


def _dyadic(first: Column, end: Column, levels: int) -> Column:
    """The nodes (level, node) that make up the chunks from ``first`` up to before ``end``."""
    out = []
    for k in range(levels):
        a, b = F.ceil(first / F.lit(1 << k)), F.floor(end / F.lit(1 << k))
        if k == levels - 1:  # the highest level takes all that is left
            out.append(F.when(a < b, F.transform(F.sequence(a, b - 1), lambda x: _node(levels - 1, x))))
        else:
            out.append(F.when((a < b) & (F.pmod(a, F.lit(2)) == 1), F.array(_node(k, a))))
            out.append(F.when((a < b) & (F.pmod(b, F.lit(2)) == 1), F.array(_node(k, b - 1))))
    empty = F.array().cast("array<struct<level:int,node:bigint>>")
    return F.concat(*(F.coalesce(x, empty) for x in out))


def latest(versions: DataFrame, asked: DataFrame) -> DataFrame:
    """(source, t, best) of all questions (source, t) with a usable version: event <= t and
    arrival <= t < expiry.

    versions: source, event, arrival, expiry and ``key``, a struct; the largest key of the usable
    ones is the best. Times are whole numbers. Versions with nulls in source or times
    are never usable, nor is a question with a null answered.
    """
    start = F.greatest("event", "arrival")
    live = versions.where("source is not null and event is not null and arrival is not null and expiry is not null").select("source", start.alias("start"), "expiry", F.col("key").alias("best")).where("start < expiry")
    first, last = F.floor(F.col("start") / CHUNK), F.floor((F.col("expiry") - 1) / CHUNK)
    live = live.withColumns({"first": first, "last": last})
    span = live.agg(F.max(F.col("last") - F.col("first"))).first()[0]
    levels = max(1, min(20, int(span or 0).bit_length()))
    clipped = lambda chunk: F.struct(chunk.alias("chunk"), F.greatest(F.col("start") - chunk * CHUNK, F.lit(0)).alias("lo"), F.least(F.col("expiry") - chunk * CHUNK, F.lit(CHUNK)).alias("hi"))
    ends = F.when(F.col("first") == F.col("last"), F.array(clipped(F.col("first")))).otherwise(F.array(clipped(F.col("first")), clipped(F.col("last"))))
    parts = live.select("source", "best", F.explode(ends).alias("p")).groupBy("source", "p.chunk", "p.lo", "p.hi").agg(F.max("best").alias("best"))
    middle = live.where(F.col("last") - F.col("first") > 1).select("source", "best", F.explode(_dyadic(F.col("first") + 1, F.col("last"), levels)).alias("n"))
    nodes = cut(middle.groupBy("source", "n.level", "n.node").agg(F.max("best").alias("best")), "nodes")
    moments = cut(asked.where("source is not null and t is not null").select("source", "t").distinct(), "moments")
    chunks = moments.select("source", F.floor(F.col("t") / CHUNK).alias("chunk")).distinct()
    ups = chunks.select("source", "chunk", F.explode(F.array(*(F.struct(F.lit(k).alias("level"), F.floor(F.col("chunk") / F.lit(1 << k)).alias("node")) for k in range(levels)))).alias("n")).select("source", "chunk", "n.level", "n.node")
    cover = ups.join(nodes, ["source", "level", "node"]).groupBy("source", "chunk").agg(F.max("best").alias("best")).select("source", "chunk", F.lit(0).cast("long").alias("lo"), F.lit(CHUNK).cast("long").alias("hi"), "best")
    questions = moments.select("source", F.floor(F.col("t") / CHUNK).alias("chunk"), F.pmod("t", F.lit(CHUNK)).cast("long").alias("lo"), F.lit(-1).cast("long").alias("hi"), F.lit(None).cast(versions.schema["key"].dataType).alias("best"))
    parts = parts.select("source", "chunk", F.col("lo").cast("long").alias("lo"), F.col("hi").cast("long").alias("hi"), "best")
    rows = parts.unionByName(cover).unionByName(questions)
    order = ["source", "chunk", F.col("hi") < 0, "best", "lo"]
    kind = dict(versions.dtypes)
    return rows.repartition("source", "chunk").sortWithinPartitions(*order).mapInArrow(_answers, f"source {kind['source']}, t long, best {kind['key']}")


def drawn(doc_id: Column, k: int) -> Column:
    """The k-th group of eight digits of the hex sha256 of the decimal id, as a number."""
    return F.conv(F.substring(F.sha2(doc_id.cast("string"), 256), 8 * k + 1, 8), 16, 10).cast("long")


def versions_of(docs: DataFrame) -> DataFrame:
    """Every document as a version of its source, with its n_chars and lang."""
    a, b, c = (drawn(F.col("doc_id"), k) for k in range(3))
    event = F.pmod(a, F.lit(50000))
    timed = docs.select("source", event.alias("event"), (event - 60 + F.pmod(b, F.lit(600))).alias("arrival"), (event + F.pmod(c, F.lit(900))).alias("expiry"), "doc_id", "n_chars", "lang")
    return timed.select("source", "event", "arrival", "expiry", F.struct("event", "arrival", "doc_id", "n_chars", "lang").alias("key"))


def features_at(docs: DataFrame, labels: DataFrame, stale: int = 120) -> DataFrame:
    """doc_id, t, version_id, age, status, n_chars and lang of every label.

    A label asks about its document's source; where several documents have its id, about
    the smallest source; where none has, or the id is null (then t is null as well), or
    the source is, its status is none. Repeated labels have a row each. Of versions
    equal in event, arrival and doc_id the largest n_chars, then lang wins. Texts and
    other columns are not read. Tables may be empty.
    """
    found = docs.where("doc_id is not null and source is not null").groupBy("doc_id").agg(F.min("source").alias("source"))
    own = labels.select("doc_id")
    asked = own.where("doc_id is not null").join(cut(found, "sources"), "doc_id", "left").withColumn("t", F.pmod(drawn(F.col("doc_id"), 3), F.lit(50000)))
    asked = cut(asked, "asked")
    best = cut(latest(versions_of(docs), asked), "best")
    known = asked.where("source is not null").join(best, ["source", "t"], "left").select("doc_id", "t", "best")
    none = F.lit(None).cast(best.schema["best"].dataType).alias("best")
    rest = asked.where("source is null").select("doc_id", "t", none).unionByName(own.where("doc_id is null").select("doc_id", F.lit(None).cast("long").alias("t"), none))
    age = F.col("t") - F.col("best.event")
    status = F.when(F.col("best").isNull(), "none").when(age > stale, "stale").otherwise("fresh")
    fresh = lambda c: F.when(F.col("status") == "fresh", F.col(f"best.{c}")).alias(c)
    return known.unionByName(rest).withColumn("status", status).select("doc_id", "t", F.col("best.doc_id").alias("version_id"), age.alias("age"), "status", fresh("n_chars"), fresh("lang"))


def sql(stale: int = 120) -> str:
    """DuckDB SQL of ``features_at`` over documents and labels."""
    part = lambda k: f"('0x' || substr(sha256(CAST(doc_id AS VARCHAR)), {8 * k + 1}, 8))::BIGINT"
    return f"""WITH x AS (SELECT doc_id, source, n_chars, lang, {part(0)} % 50000 AS event, {part(1)} % 600 AS b, {part(2)} % 900 AS c FROM documents),
 v AS (SELECT doc_id AS version_id, source, n_chars, lang, event, event - 60 + b AS arrival, event + c AS expiry FROM x WHERE source IS NOT NULL AND doc_id IS NOT NULL),
 k AS (SELECT row_number() OVER () AS r, doc_id, {part(3)} % 50000 AS t FROM labels),
 q AS (SELECT k.*, s.source FROM k LEFT JOIN (SELECT doc_id, min(source) AS source FROM documents GROUP BY 1) s USING (doc_id)),
 w AS (SELECT r, event, version_id, n_chars, lang FROM q JOIN v ON v.source = q.source AND event <= t AND arrival <= t AND t < expiry
 QUALIFY row_number() OVER (PARTITION BY r ORDER BY event DESC, arrival DESC, version_id DESC, n_chars DESC NULLS LAST, lang DESC NULLS LAST) = 1)
 SELECT q.doc_id, t, version_id, t - event AS age, CASE WHEN event IS NULL THEN 'none' WHEN t - event > {stale} THEN 'stale' ELSE 'fresh' END AS status,
 CASE WHEN t - event <= {stale} THEN n_chars END AS n_chars, CASE WHEN t - event <= {stale} THEN lang END AS lang FROM q LEFT JOIN w USING (r)"""
