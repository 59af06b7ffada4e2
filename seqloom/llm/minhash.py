"""Near-duplicate detection by one-permutation hashing with optimal densification.

Each document's shingles are hashed once; every bin keeps its smallest hash, and an
empty bin borrows from the first full one in a random order of its own. Bands of
bins make buckets. In a bucket, candidates form a star around its most connected
member; where a bucket still holds several components, further members become
centres until no two of its components are left untested. Sketches decide within that
join which of these pairs can be links at all, so it does not emit the others. Links
are confirmed on full shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import as_bytes, cut, groups, mix, pieces, word_hashes

#: A pair with a similarity of 0.8 shares no band with a probability of 5e-6 (0.738 ** 40).
BANDS, ROWS = 40, 6
BINS = BANDS * ROWS
#: Centres that a bucket of several components gets in the second round; eight times as many in each next one.
CENTRES = 1_024
#: Bins of a sketch and the bits it keeps of each (beside one that says whether it is empty).
#: A pair is no candidate if fewer bins are equal than a similar one has with a probability
#: of 3e-6 (ERRORS standard errors) or less; SLACK bins make up for few bins.
SKETCH, PLANES, ERRORS, SLACK = 512, 6, 4.5, 2
_rng = np.random.default_rng(97)
#: For each bin, the order in which it looks for a full one.
_PROBES = np.stack([_rng.permutation(BINS) for _ in range(BINS)]).astype(np.int16)


def shingle_sets(texts: list[bytes], k: int) -> Iterator[np.ndarray]:
    """For each text, the sorted distinct hashes of its shingles of ``k`` words; of
    fewer words, one hash of all; without words, none."""
    for a, b in groups(texts):
        h, counts = word_hashes(texts[a:b])
        if len(h) >= k:
            w = np.zeros(len(h) - k + 1, dtype=np.uint64)
            for i in range(k):
                w = mix(w * np.uint64(0x100000001B3) + h[i : i + len(w)] + np.uint64(1))
        at = 0
        for n in counts.tolist():
            if n >= k:
                yield np.unique(w[at : at + n - k + 1])
            elif n:
                one = np.full(1, n, dtype=np.uint64)
                for x in h[at : at + n]:
                    one = mix(one * np.uint64(0x9E3779B1) + x)
                yield one
            else:
                yield h[:0]
            at += n


def signature(s: np.ndarray) -> np.ndarray:
    """BINS minima of a sorted set, densified."""
    bins = ((s >> np.uint64(32)) * np.uint64(BINS)) >> np.uint64(32)
    first = np.flatnonzero(np.concatenate(([True], bins[1:] != bins[:-1])))
    out = np.zeros(BINS, dtype=np.uint64)
    full = np.zeros(BINS, dtype=bool)
    at = bins[first].astype(np.int64)
    out[at], full[at] = s[first], True
    empty = np.flatnonzero(~full)
    if len(empty):
        order = _PROBES[empty]
        out[empty] = out[order[np.arange(len(empty)), full[order].argmax(axis=1)]]
    return out


def sketch(s: np.ndarray) -> np.ndarray:
    """Bits of a sorted set's first hash in each of SKETCH bins: which bins are full, then PLANES bits of each."""
    bins = ((s >> np.uint64(32)) * np.uint64(SKETCH)) >> np.uint64(32)
    first = np.flatnonzero(np.concatenate(([True], bins[1:] != bins[:-1])))
    flags = np.zeros((PLANES + 1, SKETCH), dtype=bool)
    at = bins[first].astype(np.int64)
    flags[0, at] = True
    for p in range(PLANES):
        flags[p + 1, at] = (s[first] >> np.uint64(p)) & np.uint64(1)
    return np.packbits(flags, axis=1).view(np.int64).ravel()


def _alike(a: Column, b: Column, both: Column, percent: int) -> Column:
    """Whether two sketches leave a link possible; ``both`` is the sum of the sets' sizes.

    Of a pair at the limit j, bins are a sample without replacement of a union of
    both / (1 + j) hashes, of which j are shared.
    """
    words = SKETCH // 64
    either, equal = F.lit(0), F.lit(0)
    for w in range(words):
        full = a[w].bitwiseOR(b[w])
        differ = a[w].bitwiseXOR(b[w])
        for p in range(1, PLANES + 1):
            differ = differ.bitwiseOR(a[p * words + w].bitwiseXOR(b[p * words + w]))
        either = either + F.bit_count(full)
        equal = equal + F.bit_count(full.bitwiseAND(F.bitwise_not(differ)))
    j = percent / 100
    rest = F.greatest(1 - either * (1 + j) / both, F.lit(0.0))
    return equal + SLACK + ERRORS * F.sqrt(j * (1 - j) * either * rest) >= j * either


def _bands(sigs: np.ndarray) -> np.ndarray:
    own = sigs.reshape(len(sigs), BANDS, ROWS)
    h = np.arange(BANDS, dtype=np.uint64)[None, :] + np.zeros((len(sigs), 1), dtype=np.uint64)
    for r in range(ROWS):
        h = mix(h * np.uint64(0x100000001B3) + own[:, :, r])
    return h.view(np.int64)


def _list(flat: np.ndarray, sizes: list[int]) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pa.array(flat, pa.int64()))


def text_key(text: str) -> Column:
    """What tells texts of one id apart; null is as the empty text."""
    return F.xxhash64(F.coalesce(F.col(text), F.lit("")))


def sign(docs: DataFrame, doc: str, text: str, k: int) -> DataFrame:
    """doc, the text's key, n_shingles, a 128-bit digest of the set (d1, d2) and the bands (empty for an empty set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            sizes, d1, d2, sigs = [], [], [], []
            for s in shingle_sets(as_bytes(batch.column(1)), k):
                sizes.append(len(s))
                one, two = _digest(s) if len(s) else (0, 0)
                d1.append(one)
                d2.append(two)
                if len(s):
                    sigs.append(signature(s))
            bands = _bands(np.stack(sigs)).ravel() if sigs else np.empty(0, dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(sizes, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), _list(bands, [BANDS * (n > 0) for n in sizes])], names=["doc", "key", "n_shingles", "d1", "d2", "bands"]
            )

    kind = docs.schema[doc].dataType.simpleString()
    return docs.select(F.col(doc).alias("doc"), F.col(text).alias("text"), text_key(text).alias("key")).mapInArrow(run, f"doc {kind}, key long, n_shingles long, d1 long, d2 long, bands array<long>")


def _digest(s: np.ndarray) -> tuple[int, int]:
    """128 bits that tell sets apart."""
    return int(s.sum().view(np.int64)), int(mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum().view(np.int64))


def _sets(docs: DataFrame, doc: str, text: str, k: int, wanted: DataFrame, count: int) -> DataFrame:
    """rep, its set (sorted 64-bit hashes), sketch and bands for the classes (rep, d1, d2, of: a row's id and text key) in ``wanted``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            sets = list(shingle_sets(as_bytes(batch.column(1)), k))
            own = [i for i, (s, *d) in enumerate(zip(sets, batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)) if len(s) and _digest(s) == tuple(d)]
            sets = [sets[i] for i in own]
            sketches = [sketch(s) for s in sets]
            flat = np.concatenate(sketches) if sketches else np.empty(0, dtype=np.int64)
            bands = _bands(np.stack([signature(s) for s in sets])).ravel() if sets else flat
            columns = [batch.column(0).take(pa.array(own, pa.int64())), pa.array([s.tobytes() for s in sets], pa.binary()), _list(flat, [len(x) for x in sketches]), _list(bands, [BANDS] * len(sets))]
            yield pa.RecordBatch.from_arrays(columns, names=["rep", "set", "sketch", "bands"])

    wanted = wanted.select("rep", "d1", "d2", F.col("of.doc").alias("_id"), F.col("of.key").alias("_of"))
    wanted = F.broadcast(wanted) if count <= 500_000 else wanted  # 20 MB at most with ids that are numbers; beyond that the join shuffles
    own = docs.select(F.col(doc).alias("_doc"), F.col(text).alias("_text"), text_key(text).alias("_key"))
    own = own.join(wanted, F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_key") == F.col("_of"))).select("rep", "_text", "d1", "d2")
    return own.mapInArrow(run, "rep long, set binary, sketch array<long>, bands array<long>").dropDuplicates(["rep"])


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) with 100 * intersection >= percent * union."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            ok = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), dtype=np.uint64), np.frombuffer(y.as_buffer(), dtype=np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(ok)) for c in batch.columns[:2]], names=["a", "b"])

    kind = pairs.schema["a"].dataType.simpleString()
    left, right = (sets.select(F.col("rep").alias(x), F.col("set").alias(f"s{x}")) for x in "ab")
    return pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb").mapInArrow(run, f"a {kind}, b {kind}")


def components(links: DataFrame) -> DataFrame:
    """(node, comp) of every node of the links (a, b); comp is the smallest node of its component.

    Each round a node takes the smallest label among its neighbours' and its own, and
    then the label of that label, until nothing changes.
    """
    ends = F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("peer")), F.struct(F.col("b").alias("node"), F.col("a").alias("peer")))).alias("e")
    both = cut(links.where("a <> b").select(ends).select("e.*").distinct(), "links")
    labels = cut(both.groupBy("node").agg(F.min("peer").alias("m")).select("node", F.least("node", "m").alias("comp")), "labels")
    while True:
        near = both.join(labels.withColumnsRenamed({"node": "peer", "comp": "c"}), "peer").groupBy("node").agg(F.min("c").alias("c"))
        step = labels.join(near, "node").select("node", F.col("comp").alias("old"), F.least("comp", "c").alias("comp"))
        jump = step.select(F.col("node").alias("comp"), F.col("comp").alias("further"))
        new = cut(step.join(jump, "comp").select("node", "old", F.least("comp", "further").alias("comp")), "labels")
        labels = new.select("node", "comp")
        if new.where("old <> comp").isEmpty():
            return labels


def labelled(docs: DataFrame, doc: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """doc, the text's key (`text_key`), n_shingles, comp and first, one row for each row.

    comp is the component of the row's text, whatever its id, and null for a text without
    words; first is the smallest id in the component, null if none of its rows has one.
    Every distinct shingle set is a node of its own, so texts that share an id, and those
    without one, are linked as all others are.
    """
    own = docs.select(F.col(doc).alias("doc"), F.col(text).alias("text"))
    signed = cut(sign(own, "doc", "text", k), "signed")
    # one node for each set: equal sets need no pairs; its number is fixed once it is written
    row = F.struct(F.col("doc").isNull().alias("none"), "doc", "key")
    classes = signed.where("n_shingles > 0").groupBy("n_shingles", "d1", "d2").agg(F.min("doc").alias("first"), F.min(row).alias("of"), F.first("bands").alias("bands"))
    classes = cut(classes.withColumn("rep", F.monotonically_increasing_id()), "classes")
    rows = classes.select("rep", F.col("n_shingles").alias("n"), F.explode("bands").alias("bucket"))
    crowded = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    rows = cut(rows.join(crowded, "bucket"), "buckets")
    # a member's standing: how many documents it shares buckets with
    standing = rows.groupBy("rep").agg(F.sum("size").alias("standing"))
    wanted = cut(standing.join(classes.select("rep", "d1", "d2", "of"), "rep"), "standing")
    count = wanted.count()
    named = classes.select("rep", "first", F.col("n_shingles").alias("_n"), F.col("d1").alias("_1"), F.col("d2").alias("_2"))
    if count:
        sets = cut(_sets(own, "doc", "text", k, wanted, count), "sets")
        rows = cut(rows.select("bucket", "rep", "n").join(wanted.select("rep", "standing"), "rep"), "buckets")
        labels = _link(rows, sets, percent)
        named = named.join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
    else:
        named = named.withColumn("comp", F.col("rep"))
    named = cut(named.drop("rep"), "named")
    least = named.groupBy("comp").agg(F.min("first").alias("first"))
    named = named.drop("first").join(least, "comp")
    out = signed.join(named, (F.col("n_shingles") == F.col("_n")) & (F.col("d1") == F.col("_1")) & (F.col("d2") == F.col("_2")), "left")
    return out.select("doc", "key", "n_shingles", "comp", "first")


def near_duplicates(docs: DataFrame, doc: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """doc, n_shingles, component_id and kept, one row for each row.

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z as a-z. component_id is the smallest id
    that links reach, kept says whether it is the row's own. A text that is null or
    without words is linked with nothing. Repeated rows get the same component each.
    Texts that share an id are linked each by itself, so rows of one id can be in
    different components. A row with a null id takes part as others do, and is kept if no
    id is in its component. An empty table gives an empty result. Other columns are not read.
    """
    component = F.coalesce("first", "doc")
    return labelled(docs, doc, text, k, percent).select(F.col("doc").alias(doc), "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc")).alias("kept"))


def _link(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Components (node, comp) of the members of rows (bucket, rep, n, standing)."""
    alike = lambda a, b: (100 * F.least(a, b) >= percent * F.greatest(a, b))  # noqa: E731  sizes that allow a link
    best = F.max_by(F.struct("rep", "n"), F.struct(F.col("standing"), -F.col("rep"))).alias("hub")
    hubs = rows.groupBy("bucket").agg(best)
    pairs = rows.join(hubs, "bucket").where((F.col("rep") != F.col("hub.rep")) & alike(F.col("n"), F.col("hub.n")))
    ordered = lambda p, x, y: p.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).distinct()
    tested = cut(ordered(pairs, F.col("rep"), F.col("hub.rep")), "pairs")
    links = cut(_confirm(tested, sets, percent), "confirmed")
    used = hubs.select("bucket", F.col("hub.rep").alias("rep"))
    centres, labels = CENTRES, components(links)
    while True:
        now = rows.join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("comp", F.coalesce("comp", "rep"))
        now = now.join(used.withColumn("used", F.lit(True)), ["bucket", "rep"], "left").withColumn("open", F.col("used").isNull()).drop("used")
        # only buckets in which two components or more have members that have not been centres
        parts = now.groupBy("bucket", "comp").agg(F.count_if("open").alias("open"))
        left = parts.groupBy("bucket").agg(F.count(F.lit(1)).alias("parts"), F.count_if(F.col("open") > 0).alias("open_parts"), F.max_by("comp", F.struct("open", "comp")).alias("main"))
        now = now.join(left.where("parts > 1 and open_parts > 1").select("bucket", "main"), "bucket")
        now = cut(now.join(sets.select("rep", "sketch", "bands"), "rep"), "unsettled")
        if now.isEmpty():
            return labels
        # the component with most open members waits: once the others' members have all been centres, nothing is left to test
        order = Window.partitionBy("bucket").orderBy(F.desc("standing"), "rep")
        chosen = now.where(F.col("open") & (F.col("comp") != F.col("main"))).withColumn("r", F.row_number().over(order)).where(F.col("r") <= centres)
        chosen = cut(chosen.select(F.col("bucket").alias("hub_bucket"), F.col("comp").alias("hub_comp"), F.struct("rep", "n").alias("hub"), F.col("sketch").alias("hub_sketch"), F.col("bands").alias("hub_bands")), "centres")
        # a pair is tested in the first bucket that it shares, which is unsettled as long as the pair is
        first = F.array_intersect("bands", "hub_bands")[0] == F.col("bucket")
        fits = (F.col("comp") != F.col("hub_comp")) & alike(F.col("n"), F.col("hub.n")) & _alike(F.col("sketch"), F.col("hub_sketch"), F.col("n") + F.col("hub.n"), percent) & first
        met = now.join(chosen, (F.col("bucket") == F.col("hub_bucket")) & fits)
        pairs = cut(ordered(met, F.col("rep"), F.col("hub.rep")).join(tested, ["a", "b"], "left_anti"), "pairs")
        tested, used = tested.unionByName(pairs), used.unionByName(chosen.select(F.col("hub_bucket").alias("bucket"), F.col("hub.rep").alias("rep")))
        rows = now.select("bucket", "rep", "n", "standing")
        found = cut(_confirm(pairs, sets, percent), "confirmed")
        if not found.isEmpty():
            # new links join components of those before: a graph of as many links as are new
            names = labels.withColumnsRenamed({"node": "n", "comp": "c"})
            ends = found.join(names, F.col("a") == F.col("n"), "left").select(F.coalesce("c", "a").alias("x"), "b").join(names, F.col("b") == F.col("n"), "left").select(F.col("x").alias("a"), F.coalesce("c", "b").alias("b"))
            merged = components(cut(ends, "merged")).withColumnsRenamed({"node": "old", "comp": "new"})
            known = labels.unionByName(found.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(labels.select("node"), "node", "left_anti").select("node", F.col("node").alias("comp")))
            labels = cut(known.join(merged, F.col("comp") == F.col("old"), "left").select("node", F.coalesce("new", "comp").alias("comp")), "labels")
        centres *= 8
