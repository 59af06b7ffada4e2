"""Sharding, the point-in-time join and resampling against brute force, on whole small tables and odd rows."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from seqloom.llm import point_in_time, resampling, sharding
from seqloom.llm.queries import oracle_sql, queries
from seqloom.llm.ranks import numbered

TEXTS = [None, "", " \t\n", "one", "One tWo THREE 4", "é Ünï x y a.b-c", "word " * 30, "x" * 5000, "a b c " * 20000, "same text here", "same text here", None]
KIND = "doc_id long, text string, lang string, source string, n_chars long, shard string, key string, rank int, t string"


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "en" if i % 2 else None, None if i % 5 == 0 else f"s{i % 2}", i, "clash", "clash", 1, "clash") for i, t in enumerate(TEXTS)]
    rows += [rows[9], (None, "same text here", "en", "s1", None, "c", "c", 2, "c"), (3, "another of that id", "de", "s0", 7, "c", "c", 2, "c")]
    return spark.createDataFrame(rows, KIND)


@pytest.fixture(scope="module")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for name in ("documents", "labels", "benchmark"):
        c.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf}/{name}.parquet')")
    return c


def test_numbered(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None]), rng.randrange(50), i, rng.randrange(9)) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, x int, i int, w long").repartition(7)
    got = {r["i"]: r for r in numbered(df, ["g"], [F.desc("x"), F.col("i")], "n").collect()}
    sums = {r["i"]: r["n"] for r in numbered(df, ["g"], [F.desc("x"), F.col("i")], "n", weight="w").collect()}
    by = defaultdict(list)
    for g, x, i, w in sorted(rows, key=lambda r: (-r[1], r[2])):
        assert (got[i]["n"], sums[i]) == (len(by[g]), sum(by[g]))
        by[g].append(w)
    assert numbered(df.limit(0), [], [F.col("i")], "n").count() == 0


# sharding


def laws(rows, docs, k, law):
    """What every result has to keep to."""
    want = Counter((r["doc_id"], len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode())) for r in docs)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == want
    slots = defaultdict(list)
    for r in rows:
        assert r["law"] == law and r["grown_shard"] is None and 0 <= r["shard"] < k
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    counts = [len(slots[s]) for s in range(k)]
    if law == "rows":
        assert max(counts) - min(counts) <= 1
    return counts


def test_sharding_laws(spark, sf, odd, documents):
    for docs in (odd, odd.limit(0)):
        laws(sharding.shard(docs).collect(), docs.collect(), 16, "rows")
    once = odd.dropDuplicates(["doc_id", "text"]).cache()
    one, two = (Counter(map(tuple, sharding.shard(x, k=3).collect())) for x in (once, once.repartition(5)))
    assert one == two  # whatever the partitions; of repeated rows any may stand for the other
    got = queries()["op11_sharding"](spark, sf)
    assert got.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    rows = got.collect()
    laws(rows, documents.collect(), 16, "rows")
    groups = defaultdict(set)
    for r in rows:
        groups[r["text_crc32"], r["size"]].add(r["shard"])
    sizes = Counter((r["text_crc32"], r["size"]) for r in rows)
    assert [g for g, n in sizes.items() if 1 < n <= 6 and len(groups[g]) > 1] == []


def test_sharding_by_bytes(documents):
    rows = sharding.shard(documents, k=8, law="bytes").collect()
    laws(rows, documents.collect(), 8, "bytes")
    loads = Counter()
    for r in rows:
        loads[r["shard"]] += r["size"]
    largest = max(r["size"] for r in rows)
    assert max(loads.values()) - min(loads[s] for s in range(8)) <= 2 * largest


def test_sharding_spreads_a_hot_group_and_keeps_the_others(spark):
    rows = [(i, "hot") for i in range(1000)] + [(1000 + i, f"group {i // 5}") for i in range(1000)] + [(2000 + i, f"alone {i}") for i in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(9)
    got = sharding.shard(docs, k=16).collect()
    laws(got, docs.collect(), 16, "rows")
    where = defaultdict(set)
    text = dict(rows)
    for r in got:
        where[text[r["doc_id"]]].add(r["shard"])
    assert len(where["hot"]) <= 9  # 1000 of 3000 rows are 5.3 shards
    assert sum(len(s) > 1 for t, s in where.items() if t.startswith("group")) <= 10


def test_sharding_moves_towards_neighbours_of_overlapping_groups(spark):
    """Blocks of 40 documents with random links within and a few between: far fewer are cut than by chance."""
    rng = random.Random(5)
    blocks = [list(range(40 * b, 40 * b + 40)) for b in range(16)]
    links = []
    for b in blocks:
        links += [(d, f"{x}-{y}") for x, y in [rng.sample(b, 2) for _ in range(160)] for d in (x, y)]
    for _ in range(60):
        x, y = rng.sample(range(640), 2)
        links += [(x, f"{x}-{y}"), (y, f"{x}-{y}")]
    docs = spark.createDataFrame([(i, f"t{i}") for i in range(640)], "doc_id long, text string")
    got = {r["doc_id"]: r["shard"] for r in sharding.shard(docs, k=4, links=spark.createDataFrame(links, "doc_id long, grp string")).collect()}
    ends = defaultdict(set)
    for d, g in links:
        ends[g].add(got[d])
    cut = sum(len(s) > 1 for s in ends.values()) / len(ends)
    assert cut < 0.5  # 0.75 by chance
    assert max(Counter(got.values()).values()) - min(Counter(got.values()).values()) <= 1


def test_sharding_is_native():
    from pathlib import Path

    for m in (sharding,):
        source = Path(m.__file__).read_text()
        assert not any(x in source for x in ("mapIn", "applyIn", "udf", "pandas", "numpy", "pyarrow", ".rdd"))


# point in time


def truth(docs, labels):
    def draws(i):
        h = hashlib.sha256(str(i).encode()).hexdigest()
        return [int(h[8 * k : 8 * k + 8], 16) for k in range(4)]

    source, by = {}, defaultdict(list)
    for r in docs:
        if r["doc_id"] is None or r["source"] is None:
            continue
        source[r["doc_id"]] = min(source.get(r["doc_id"], r["source"]), r["source"])
        a, b, c, _ = draws(r["doc_id"])
        event = a % 50000
        by[r["source"]].append((event, event - 60 + b % 600, event + c % 900, r["doc_id"], r["n_chars"], r["lang"]))
    for r in labels:
        i = r["doc_id"]
        if i is None:
            yield None, None, None, None, "none", None, None
            continue
        t = draws(i)[3] % 50000
        use = [v for v in by[source.get(i)] if v[0] <= t and v[1] <= t < v[2]]
        if not use:
            yield i, t, None, None, "none", None, None
            continue
        best = max(use, key=lambda v: (v[0], v[1], v[3], v[4] is not None, v[4] or 0, v[5] is not None, v[5] or ""))
        age = t - best[0]
        yield i, t, best[3], age, "stale" if age > 120 else "fresh", *(best[4:] if age <= 120 else (None, None))


def test_point_in_time(spark, sf, odd, documents, con):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    mine = spark.createDataFrame([(i, "x") for i in [*range(14), 3, 3, None, None, 99]], "doc_id long, t string")
    many = documents.unionByName(spark.range(200, 6000).select(F.col("id").alias("doc_id"), F.lit("").alias("text"), F.lit("xx").alias("lang"), F.when(F.col("id") % 3 > 0, "src0").otherwise("src1").alias("source"), F.col("id").alias("n_chars")))
    asking = many.select("doc_id")
    for docs, asked in ((documents, labels), (odd, mine), (odd.limit(0), mine), (odd, mine.limit(0)), (many, asking)):
        got = point_in_time.features_at(docs, asked)
        assert Counter(map(tuple, got.collect())) == Counter(truth(docs.collect(), asked.collect()))
    got = queries()["op12_point_in_time"](spark, sf)
    want = con.execute(oracle_sql()["op12_point_in_time"])
    order = [c[0] for c in want.description]
    assert Counter(map(tuple, got.select(order).collect())) == Counter(want.fetchall())


def test_point_in_time_of_long_and_short_lives(spark):
    """Lives of one moment and of many chunks, before and after zero, with ties; one source holds most."""
    rng = random.Random(11)
    rows = []
    for i in range(900):
        event = rng.randrange(-3000, 9000)
        rows.append(("hot" if i % 3 else f"s{i % 7}", event, event + rng.choice([-50, 0, 0, 70]), event + rng.choice([0, 1, 2, 63, 64, 65, 500, 40_000]), i // 2))
    rows += [(None, 1, 1, 50, 1), ("hot", None, 1, 50, 1), ("hot", 1, 1, None, 1)]
    asked = [(rng.choice(["hot", "s0", "s1", "never", None]), rng.choice([None, *[rng.randrange(-4000, 60_000)] * 9])) for _ in range(600)]
    versions = spark.createDataFrame(rows, "source string, event long, arrival long, expiry long, i long").select("source", "event", "arrival", "expiry", F.struct("event", "arrival", "i").alias("key"))
    got = {(r["source"], r["t"]): tuple(r["best"]) for r in point_in_time.latest(versions, spark.createDataFrame(asked, "source string, t long")).collect()}
    want = {}
    for s, t in asked:
        use = [(r[1], r[2], r[4]) for r in rows if s is not None and t is not None and r[0] == s and None not in r and r[1] <= t and r[2] <= t < r[3]]
        if use:
            want[s, t] = max(use)
    assert got == want and len(want) > 100


def test_tree_keeps_its_older_versions():
    rng = random.Random(2)
    tree, there, roots = point_in_time.PersistentTree(37), set(), [(0, frozenset())]
    root = 0
    for _ in range(500):
        k = rng.randrange(37)
        there = there ^ {k}
        root = tree.edit(root, k, k in there)
        roots.append((root, frozenset(there)))
    assert all(tree.top[r] == max(s, default=-1) for r, s in roots)
    assert len(tree.top) <= 1 + 500 * (tree.depth + 1)  # an edit copies one path


def test_chunks_hold_few_versions_however_many_rows(spark):
    """50,000 versions of one source within 128 moments: the shuffle passes on at most CHUNK * (CHUNK + 1) / 2 a chunk."""
    n, seen = 50_000, []
    rows = spark.range(n).select(F.lit("hot").alias("source"), (F.col("id") % 128).alias("event"), (F.col("id") % 128).alias("arrival"), (F.col("id") % 128 + 1 + F.col("id") % 61).alias("expiry"), F.struct("id").alias("key"))
    asked = spark.range(200).select(F.lit("hot").alias("source"), F.col("id").alias("t"))
    best = {r["t"]: r["best"]["id"] for r in point_in_time.latest(rows, asked).collect()}
    for t in range(200):
        use = [i for i in range(n) if i % 128 <= t < i % 128 + 1 + i % 61]
        assert best.get(t) == max(use, default=None)
        seen.append(len(use))
    assert max(seen) > 5000


# resampling


def runs_of(text, n):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words, word = [], ""
    for c in lowered + " ":
        if ord(c) >= 128 or c.isdigit() or "a" <= c <= "z":
            word += c
        elif word:
            words.append(word)
            word = ""
    return words, [" ".join(words[i : i + k]) for k in range(1, n + 1) for i in range(len(words) - k + 1)]


def drawn(docs, target, n=1, buckets=10_000, percent=10, least=20):
    of = lambda x: zlib.crc32(x.encode()) % buckets
    s, t = (Counter(of(x) for d in rows for x in runs_of(d, n)[1]) for rows in ([r["text"] for r in docs], target))
    a, b = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log(((t[k] + 1) * (a + buckets)) / ((s[k] + 1) * (b + buckets)))) for k in range(buckets)]
    out = []
    for r in docs:
        words, runs = runs_of(r["text"], n)
        weight = sum(gain[of(x)] for x in runs) // len(runs) if runs else 0
        h = int(hashlib.sha256(f"2024:{'' if r['doc_id'] is None else r['doc_id']}".encode()).hexdigest()[:8], 16)
        out.append([r["doc_id"], len(runs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words)])
    fit = sorted((x for x in out if x[5] >= least), key=lambda x: (-x[3], x[0] is None, x[0] or 0, -x[2], -x[1]))
    for k, x in enumerate(fit[: percent * len(fit) // 100]):
        x[4] = k + 1
    return Counter(tuple(x[:5]) for x in out)


def test_resampling(spark, sf, odd, documents, con):
    target = [r["text"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    frame = spark.createDataFrame([(t, 1) for t in target] + [(None, 1)], "text string, rank int")
    for docs in (odd, documents, odd.limit(0)):
        for n, buckets, percent in ((1, 10_000, 10), (2, 97, 50), (3, 10_000, 100)):
            got = resampling.resample(docs, frame, n=n, buckets=buckets, percent=percent)
            assert Counter(map(tuple, got.collect())) == drawn(docs.collect(), target, n, buckets, percent)
    assert Counter(map(tuple, resampling.resample(odd, frame.limit(0)).collect())) == drawn(odd.collect(), [])
    want = con.execute(oracle_sql()["op13_resampling"])
    order = [c[0] for c in want.description]
    got = queries()["op13_resampling"](spark, sf).select(order)
    assert Counter(map(tuple, got.collect())) == Counter(want.fetchall())


def test_tries_are_emptied_and_long_texts_cut(spark, monkeypatch):
    rng = np.random.default_rng(4)
    texts = [" ".join(f"W{i}" for i in rng.integers(0, 400, n)) for n in (3000, 5, 0, 1, 900, 2500)]
    whole = [runs_of(t, 3)[1] for t in texts]
    for block, nodes in ((1 << 20, 1 << 18), (700, 50), (64, 10_000)):
        monkeypatch.setattr(resampling, "BLOCK_BYTES", block)
        monkeypatch.setattr("seqloom.llm.common.BLOCK_BYTES", block)
        trie, counts = resampling.Trie(5000), Counter()
        sizes = np.zeros(len(texts), dtype=int)
        for a, b, found, per, _ in resampling._runs(trie, [t.encode() for t in texts], 3):
            sizes[a:b] += per
            counts.update(trie.held[i] for i in found.tolist())
            if len(trie.crc) > nodes:
                trie.empty()
        assert sizes.tolist() == [len(x) for x in whole]
        assert counts == Counter(zlib.crc32(x.encode()) % 5000 for r in whole for x in r)


def test_drawn_documents_are_nearer_to_the_target(spark):
    rng = random.Random(8)
    docs = [(i, " ".join(rng.choice(["alpha", "beta", "gamma"] if i % 5 == 0 else ["delta", "epsilon", "zeta"]) for _ in range(40))) for i in range(500)]
    got = resampling.resample(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([("alpha beta gamma " * 30,)], "text string")).collect()
    chosen = [r["doc_id"] for r in got if r["rank"] is not None]
    assert len(chosen) == 50 and sum(i % 5 == 0 for i in chosen) > 35
