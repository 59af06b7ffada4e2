"""Importance resampling towards a target's distribution of hashed word runs.

Every task reads texts into a word trie of its own: a node is a run of words, and holds
the CRC state of the run and how often it occurred. Counts go to the runs' buckets, and
the tasks' bucket totals are added up. To score, the texts walk tries again whose
nodes hold the gain of their bucket. A trie that has grown to NODES nodes is emptied
into the totals and begun anew, so a task's memory does not grow with its texts.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLOCK_BYTES, as_bytes, cut, groups, pieces
from .ranks import numbered

#: Nodes at which a trie is emptied.
NODES = 1 << 18
#: A-Z become a-z; ASCII characters that are neither letters nor digits become spaces.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


class Trie(dict):
    """Word runs of a task as nodes; as a dictionary, the root's children by word.

    ``crc`` has the CRC-32 state of a node's run, from which its children's go on; ``held``
    the gain of its bucket, or the bucket where no gains are given.
    """

    def __init__(self, buckets: int, gains: np.ndarray | None = None):
        super().__init__()
        self.buckets, self.gains = buckets, gains
        self.crc, self.held = array("L"), array("q")
        self.deeper = _Deeper(self)

    def node(self, crc: int) -> int:
        self.crc.append(crc)
        bucket = crc % self.buckets
        self.held.append(bucket if self.gains is None else int(self.gains[bucket]))
        return len(self.crc) - 1

    def __missing__(self, word: bytes) -> int:
        """The root's child of a word not seen before."""
        got = self[word] = self.node(zlib.crc32(word))
        self.deeper.word[got] = word
        return got

    def walk(self, words: list[bytes], n: int) -> list[np.ndarray]:
        """For each length up to ``n``, the nodes of the runs that begin at each word, in order."""
        first = np.fromiter(map(self.__getitem__, words), dtype=np.int64, count=len(words))
        out = [first]
        for k in range(1, n):
            if len(first) <= k:
                break
            keys = (out[-1][: len(first) - k] << 32) | first[k:]
            out.append(np.fromiter(map(self.deeper.__getitem__, keys.tolist()), dtype=np.int64, count=len(keys)))
        return out

    def empty(self) -> None:
        self.clear()
        self.deeper.clear()
        self.deeper.word.clear()
        del self.crc[:], self.held[:]


class _Deeper(dict):
    """Children of other nodes, by (node, node of the word alone)."""

    def __init__(self, trie: Trie):
        super().__init__()
        self.trie, self.word = trie, {}

    def __missing__(self, key: int) -> int:
        got = self[key] = self.trie.node(zlib.crc32(b" " + self.word[key & 0xFFFFFFFF], self.trie.crc[key >> 32]))
        return got


def words_of(text: bytes) -> list[bytes]:
    """The words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of a text whose A-Z are lowered."""
    return text.translate(_TABLE).split()


def _stretches(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, about BLOCK_BYTES of them at a time."""
    at = 0
    while at < len(text):
        to = min(len(text), at + BLOCK_BYTES)
        while to < len(text) and _TABLE[text[to]] != 32:
            to += 1
        yield words_of(text[at:to])
        at = to


def _runs(trie: Trie, texts: list[bytes], n: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first text, end, nodes, texts of the nodes, words by text) by blocks of about BLOCK_BYTES."""
    for a, b in groups(texts):
        if b - a == 1:
            tail: list[bytes] = []
            for words in _stretches(texts[a]):
                levels = trie.walk(tail + words, n)
                # runs within the tail were counted with the stretch before
                nodes = [x if not tail else x[max(0, len(tail) - k) :] for k, x in enumerate(levels)]
                found = np.concatenate(nodes) if nodes else np.empty(0, dtype=np.int64)
                yield a, b, found, np.array([len(found)]), np.array([len(words)])
                tail = (tail + words)[max(0, len(tail) + len(words) - (n - 1)) :] if n > 1 else []
            continue
        split = [words_of(x) for x in texts[a:b]]
        sizes = np.array([len(x) for x in split], dtype=np.int64)
        if n == 1:
            yield a, b, trie.walk([w for x in split for w in x], 1)[0], sizes, sizes
            continue
        walked = [np.concatenate(trie.walk(x, n)) for x in split]
        yield a, b, np.concatenate(walked), np.array([len(x) for x in walked], dtype=np.int64), sizes


def totals(texts: DataFrame, text: str = "text", n: int = 1, buckets: int = 10_000) -> DataFrame:
    """(bucket, features): how many word runs of 1 to ``n`` words all texts have in each
    bucket (those with any), whole texts, repeats counted; a null text has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, counts, sums = Trie(buckets), np.zeros(0, dtype=np.int64), np.zeros(buckets, dtype=np.int64)

        def fold() -> None:
            if len(counts):
                np.add.at(sums, np.array(trie.held, dtype=np.int64), counts)
            trie.empty()

        for batch in pieces(batches):
            for _, _, nodes, _, _ in _runs(trie, as_bytes(batch.column(0)), n):
                here = np.bincount(nodes, minlength=len(trie.crc)).astype(np.int64)
                here[: len(counts)] += counts
                counts = here
                if len(trie.crc) > NODES:
                    fold()
                    counts = np.zeros(0, dtype=np.int64)
        fold()
        full = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), pa.array(sums[full], pa.int64())], names=["bucket", "features"])

    own = texts.select(F.col(text)).mapInArrow(run, "bucket int, features long")
    return own.groupBy("bucket").agg(F.sum("features").alias("features"))


def gains(source: DataFrame, target: DataFrame, buckets: int = 10_000) -> DataFrame:
    """(bucket, gain) of every bucket: a thousand times the log of how much more often the
    target has it than the source (each with one more in every bucket), floored."""
    every = source.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    s, t = source.select("bucket", F.col("features").alias("s")), target.select("bucket", F.col("features").alias("t"))
    all_ = s.agg(F.coalesce(F.sum("s"), F.lit(0)).alias("all_s")).crossJoin(F.broadcast(t.agg(F.coalesce(F.sum("t"), F.lit(0)).alias("all_t"))))  # one row each
    joined = every.join(s, "bucket", "left").join(t, "bucket", "left").fillna(0, ["s", "t"]).crossJoin(F.broadcast(all_))
    d = lambda c, more: F.col(c).cast("double") + more
    ratio = (d("t", 1) * d("all_s", buckets)) / (d("s", 1) * d("all_t", buckets))
    return joined.select("bucket", F.floor(1000 * F.log(ratio)).cast("long").alias("gain"))


def weigh(docs: DataFrame, carry: list[str], gain: list[int], text: str = "text", n: int = 1) -> DataFrame:
    """``carry``, n_words, n_features and weight of every row: the floored mean of its runs' gains (0 without runs)."""
    fields = docs.select(*carry).schema
    held = np.array(gain, dtype=np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(len(held), held)
        for batch in pieces(batches):
            texts = as_bytes(batch.column(len(carry)))
            words, features, total = (np.zeros(len(texts), dtype=np.int64) for _ in range(3))
            for a, b, nodes, sizes, n_words in _runs(trie, texts, n):
                upto = np.concatenate(([0], np.cumsum(np.frombuffer(trie.held, dtype=np.int64)[nodes]))) if len(nodes) else np.zeros(1, dtype=np.int64)
                ends = np.cumsum(sizes)
                words[a:b] += n_words
                features[a:b] += sizes
                total[a:b] += upto[ends] - upto[ends - sizes]
                if len(trie.crc) > NODES:
                    trie.empty()
            mean = np.where(features > 0, np.floor_divide(total, np.maximum(features, 1)), 0)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(carry)], pa.array(words), pa.array(features), pa.array(mean)], names=[*carry, "n_words", "n_features", "weight"])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    return docs.select(*carry, F.col(text)).mapInArrow(run, f"{kept}, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: int = 2024) -> Column:
    """A thousandfold Gumbel draw, floored, that follows from the id (a null id is as an empty one)."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(named, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def resample(docs: DataFrame, target: DataFrame, n: int = 1, buckets: int = 10_000, percent: int = 10, least_words: int = 20, doc_id: str = "doc_id", text: str = "text", seed: int = 2024) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every document.

    Of the documents with ``least_words`` words or more, ``percent`` of a hundred (rounded
    down) are drawn without replacement, as if by their weights: rank 1, 2, ... by score, ties
    to the smaller id, null ids last; of the rest, rank is null. A null text is as an
    empty one: no runs, weight 0. Rows of one id are scored each, and equal scores of one
    id come in order of weight and runs. Tables may be empty, and other columns are
    not looked at. A text is read a megabyte at a time. The buckets' totals (``buckets``
    rows) are all that the driver sees.
    """
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    source, goal = cut(totals(own, "text", n, buckets), "source"), cut(totals(target, text, n, buckets), "target")  # a row for each bucket
    found = gains(source, goal, buckets).orderBy("bucket").collect()
    scored = weigh(own, ["doc_id"], [r["gain"] for r in found], "text", n)
    scored = cut(scored.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), "scored")
    fit = scored.where(F.col("n_words") >= least_words)
    drawn = fit.count() * percent // 100
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.desc("weight"), F.desc("n_features"), F.desc("n_words")]
    ranked = numbered(fit, [], order, "rank").withColumn("rank", F.when(F.col("rank") < drawn, F.col("rank") + 1))
    rest = scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return ranked.unionByName(rest).select("doc_id", "n_features", "weight", "score", "rank")


def sql(buckets: int = 10_000, percent: int = 10, least_words: int = 20, seed: int = 2024) -> str:
    """DuckDB SQL of ``resample`` over documents and benchmark, for single words."""
    upper, lower = "".join(map(chr, range(65, 91))), "".join(map(chr, range(97, 123)))
    words = f"regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""WITH crc_table AS (SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS steps),
 d AS (SELECT doc_id, row_number() OVER () AS r, {words} AS ws FROM documents),
 dw AS (SELECT r, unnest(ws) AS w FROM d), bw AS (SELECT unnest({words}) AS w FROM benchmark),
 vocabulary AS (SELECT w, encode(w) AS bytes FROM (SELECT w FROM dw UNION SELECT w FROM bw)),
 b AS (SELECT w, xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, octet_length(bytes) + 1), lambda i: ('0x' || substr(hex(bytes), 2 * i - 1, 2))::BIGINT)),
 lambda c, x: xor(steps[(xor(c, x) & 255) + 1], c >> 8))) % {buckets} AS bucket FROM vocabulary, crc_table),
 s AS (SELECT bucket, count(*) AS s FROM dw JOIN b USING (w) GROUP BY 1), t AS (SELECT bucket, count(*) AS t FROM bw JOIN b USING (w) GROUP BY 1),
 g AS (SELECT bucket, CAST(floor(1000 * ln(((coalesce(t, 0)::DOUBLE + 1) * ((SELECT coalesce(sum(s), 0) FROM s)::DOUBLE + {buckets})) / ((coalesce(s, 0)::DOUBLE + 1) * ((SELECT coalesce(sum(t), 0) FROM t)::DOUBLE + {buckets})))) AS BIGINT) AS gain
 FROM (SELECT range AS bucket FROM range({buckets})) LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket)),
 m AS (SELECT r, sum(gain) AS total, count(*) AS k FROM dw JOIN b USING (w) JOIN g USING (bucket) GROUP BY 1),
 scored AS (SELECT r, doc_id, len(ws) AS n_features, coalesce(CAST(floor(total::DOUBLE / k) AS BIGINT), 0) AS weight,
 ('0x' || substr(sha256('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8))::BIGINT::DOUBLE AS h FROM d LEFT JOIN m USING (r)),
 f AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5) / 4294967296.0::DOUBLE))) AS BIGINT) AS score FROM scored),
 o AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS k, count(*) OVER () AS n FROM f WHERE n_features >= {least_words})
 SELECT doc_id, CAST(n_features AS BIGINT) AS n_features, weight, score, CAST(CASE WHEN k <= {percent} * n // 100 THEN k END AS BIGINT) AS "rank" FROM f LEFT JOIN o USING (r)"""
