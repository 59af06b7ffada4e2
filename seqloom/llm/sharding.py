"""Shards by balanced label propagation.

Documents that share a group are linked. In each round a document looks at the
shards of its groups' members and wants to go where most of them are; moves are
admitted under quotas, so that no shard gets more than it may hold, with groups
that can be whole served first. Documents without links wait and fill what room is left,
so sizes come out even whatever the links are. All of it is DataFrame operations.

What passes between shards is counted in tables of at most shards * shards * CELLS rows,
whatever the input; the driver sees shards * shards numbers a round.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut
from .ranks import numbered

#: Moves to a shard are admitted by cells: by group size (powers of two), then by slots of groups, then of documents.
SIZES, SLOTS, PARTS = 24, 16, 64
CELLS = SIZES * SLOTS * PARTS


def _numbers(values: list[int]) -> Column:
    return F.array(*(F.lit(int(v)).cast("long") for v in values))


def _sums(df: DataFrame, keys: list[str]) -> dict[tuple, int]:
    """Sums of w by columns of shards: at most shards * shards rows."""
    return {tuple(r[k] for k in keys): r["w"] for r in df.groupBy(*keys).agg(F.sum("w").alias("w")).collect()}


def propagate(items: DataFrame, caps: list[int], rounds: int = 16, seed: int = 7) -> DataFrame:
    """(items, shard): linked documents moved towards their neighbours' shards.

    items: ``key`` (unique), ``w`` (what it counts against ``caps``) and ``groups``, an array
    of what it is linked by; each shard's sum of w comes out at its cap or
    little above (`settle` makes it exact). A document's groups are one array of its
    row, so hubs are groups of many documents, never rows of many groups. A first
    shard follows from the key's hash. Shards that were wanted by more than they could take
    and are nearly full are no targets, but in a round after one that moved nothing, where
    members may be exchanged; if that moves nothing either, it ends, or after ``rounds``.
    """
    k = len(caps)
    state = cut(items.withColumn("shard", F.pmod(F.xxhash64(F.lit(seed), "key"), F.lit(k)).cast("int")), "shards")
    loads = {s: w for (s,), w in _sums(state, ["shard"]).items()}
    quiet, unmet, draw = 0, set(), random.Random(seed)
    for r in range(rounds):
        room = [max(0, caps[s] - loads.get(s, 0)) for s in range(k)]
        closed = {s for s in unmet if room[s] * 8 < caps[s]} if not quiet else set()
        order = draw.sample(range(k), k)
        wants = cut(_wants(state, k, [s not in closed or len(closed) == k for s in range(k)], order, r), "wants")
        flows = _sums(wants.where("to is not null"), ["shard", "to"])
        # what leaves for a shard makes room for what comes from there
        most = [room[b] + sum(min(w, flows.get((b, a), 0)) for (a, to), w in flows.items() if to == b) for b in range(k)]
        limits, moved = _limits(wants, most) if flows else ({}, {})
        for (a, b), w in moved.items():
            loads[a], loads[b] = loads.get(a, 0) - w, loads.get(b, 0) + w
        unmet |= {b for (a, b), w in flows.items() if moved.get((a, b), 0) < w}
        quiet = 0 if moved else quiet + 1
        if quiet == 2:
            break
        goes = F.col("cell") <= F.get(_numbers([limits.get(b, -1) for b in range(k)]), F.col("to"))
        state = wants.withColumn("shard", F.when(F.col("to").isNotNull() & goes, F.col("to")).otherwise(F.col("shard"))).select(*items.columns, "shard")
    return state


def _wants(state: DataFrame, k: int, open_: list[bool], order: list[int], r: int) -> DataFrame:
    """state with ``to``, the shard that each document wants to go to (null: it stays), and ``cell``.

    A group is one row with a count for each shard, summed before it is shuffled.
    """
    links = state.select("key", "shard", F.explode("groups").alias("grp"))
    counts = links.groupBy("grp").agg(F.array(*(F.count_if(F.col("shard") == s) for s in range(k))).alias("counts"))
    counts = cut(counts, "counts")  # a plain equi-join of two exchanges: hot groups can be split
    by_shard = [F.sum(F.get("counts", s)) for s in range(k)]
    scores = links.join(counts, "grp").groupBy("key").agg(F.array(*by_shard).alias("scores"), F.count(F.lit(1)).alias("n"))
    own = state.join(scores, "key", "left")
    # its own counts hold a document back; in half of the rounds those of all groups but one do not
    held = F.when(F.pmod(F.xxhash64(F.lit(r), "key"), F.lit(2)) == 0, F.col("n") - 1).otherwise(0)
    score = lambda s: F.get("scores", s) - F.when(s == F.col("shard"), held).otherwise(0)
    ranked = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda s: F.struct(score(s).alias("score"), F.get(_numbers(order), s).alias("order"), s.alias("shard")))
    may = F.filter(ranked, lambda x: (x["shard"] == F.col("shard")) | F.get(F.array(*map(F.lit, open_)), x["shard"]))
    best = F.array_max(may)
    to = F.when(F.col("scores").isNotNull() & (best["shard"] != F.col("shard")) & (best["score"] > 0), best["shard"])
    members = F.aggregate("scores", F.lit(0).cast("long"), lambda a, x: a + x)
    size = F.least(F.lit(SIZES - 1), F.floor(F.log2(F.greatest(members, F.lit(1))))).cast("int")
    slot = F.pmod(F.xxhash64(F.lit(r), F.get("groups", F.lit(0))), F.lit(SLOTS))
    part = F.pmod(F.xxhash64(F.lit(r), "key"), F.lit(PARTS))
    return own.select(*state.columns, to.cast("int").alias("to"), ((size * SLOTS + slot) * PARTS + part).cast("long").alias("cell"))


def _limits(wants: DataFrame, most: list[int]) -> tuple[dict[int, int], dict[tuple[int, int], int]]:
    """The last cell that each shard admits, and what goes from shard to shard by that: cells
    are taken whole, in order, while ``most`` lasts."""
    cells = wants.where("to is not null").groupBy("shard", "to", "cell").agg(F.sum("w").alias("w"))
    upto = F.sum("w").over(Window.partitionBy("to").orderBy("cell"))  # cells of one number go together
    fits = cells.withColumn("upto", upto).where(F.col("upto") <= F.get(_numbers(most), F.col("to")))
    got = fits.groupBy("shard", "to").agg(F.sum("w").alias("w"), F.max("cell").alias("cell")).collect()
    last: dict[int, int] = {}
    for r in got:
        last[r["to"]] = max(last.get(r["to"], -1), r["cell"])
    return last, {(r["shard"], r["to"]): r["w"] for r in got}


def settle(rows: DataFrame, caps: list[int], order: list[str]) -> DataFrame:
    """rows (w, shard or null) with the shard of every row: what exceeds a shard's cap leaves
    it, the last by ``order`` first, and goes with the rows that have none into the room left, in order.

    With w = 1 the shards come out at their caps exactly (which sum to the rows).
    """
    k = len(caps)
    loads = {a: w for (a,), w in _sums(rows.where("shard is not null"), ["shard"]).items()}
    if any(w > caps[a] for a, w in loads.items()):
        ranked = numbered(rows.where("shard is not null"), ["shard"], [F.col(c) for c in order], "_before", weight="w")
        fits = F.col("_before") + F.col("w") <= F.get(_numbers(caps), F.col("shard"))
        ranked = ranked.withColumn("shard", F.when(fits, F.col("shard"))).drop("_before")
        rows = cut(ranked.unionByName(rows.where("shard is null")), "fitting")
        loads = {a: w for (a,), w in _sums(rows.where("shard is not null"), ["shard"]).items()}
    ends, at = [], 0
    for s in range(k):
        at += caps[s] - loads.get(s, 0)
        ends.append(at)
    waiting = numbered(rows.where("shard is null"), [], [F.col(c) for c in order], "_before", weight="w")
    there = F.array_size(F.filter(_numbers(ends), lambda e: e <= F.col("_before")))
    dealt = waiting.withColumn("shard", F.least(there, F.lit(k - 1)).cast("int")).drop("_before")
    return rows.where("shard is not null").unionByName(dealt)


def shard(docs: DataFrame, k: int = 16, law: str = "rows", doc_id: str = "doc_id", text: str = "text", links: DataFrame | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every document.

    size: the bytes of the text and 1. Documents of equal texts are linked, and those that
    ``links`` (doc_id, grp) gives one group. The law ``rows`` makes the shards' counts at most one
    apart, ``bytes`` their sizes equal but for about a document. Both depend on all
    documents, so grown_shard is null. A null text has no bytes (size 1, CRC 0) and
    equals no other; ids may be null or repeated, each row has a shard and a slot (from 0,
    without gaps). A group that is larger than a shard is spread over as few as room allows.
    Texts are hashed where they are read and go no further. Tables may be empty;
    other columns are not looked at.
    """
    data = F.coalesce(F.col(text), F.lit(""))
    read = docs.select(F.col(doc_id).alias("doc_id"), (F.octet_length(data) + 1).cast("long").alias("size"), F.crc32(data.cast("binary")).alias("text_crc32"), F.when(F.col(text).isNotNull(), F.unhex(F.sha2(data.cast("binary"), 256))).alias("digest"))
    read = read.withColumns({"h": F.xxhash64("doc_id", "digest"), "w": F.col("size") if law == "bytes" else F.lit(1).cast("long")})
    # repeated rows are told apart by a number, so that nothing follows from how rows are partitioned
    read = cut(numbered(cut(read, "read"), ["h"], [F.col("doc_id"), F.col("digest")], "copy"), "rows").withColumn("key", F.struct("h", "copy"))
    total = read.agg(F.coalesce(F.sum("w"), F.lit(0))).first()[0]
    caps = [total // k + (s < total % k) for s in range(k)]
    twice = cut(read.where("digest is not null").groupBy("digest").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("digest"), "twice")
    grouped = read.select("digest", "key", "w").join(twice, "digest").select("key", "w", F.col("digest").alias("grp"))
    if links is not None:
        given = links.select(F.col("doc_id").alias("_of"), F.concat(F.lit("g"), F.col("grp").cast("string")).cast("binary").alias("grp")).where("_of is not null and grp is not null")
        grouped = grouped.unionByName(read.join(given, F.col("doc_id") == F.col("_of")).select("key", "w", "grp"))
    items = grouped.groupBy("key").agg(F.first("w").alias("w"), F.array_sort(F.collect_set("grp")).alias("groups"))
    placed = propagate(items, caps).select("key", "shard", F.get("groups", F.lit(0)).alias("grp"))
    rows = read.join(placed, "key", "left")
    rows = cut(rows.withColumn("o", F.xxhash64("grp")), "placed")
    settled = settle(rows, caps, ["o", "h", "copy"])
    out = numbered(settled, ["shard"], [F.col(c) for c in ("h", "copy")], "slot")
    return out.select("doc_id", "size", "text_crc32", F.lit(law).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
