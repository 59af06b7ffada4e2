"""Components, forests, cores, independent sets, matchings, colourings, covers, flows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..iterate import fixpoint
from ..storage import cut, shared_path
from .graphs import symmetrize, undirected
from .prefixes import first_free, in_order
from .traversal import bfs

#: Open links of a forest that one task may finish, and open pairs of a cover.
LAST, LAST_PAIRS = 1_000_000, 4_000_000


def components(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, comp): the smallest id of each vertex's component.

    A round takes the smallest label of neighbours and then that label's own label
    (pointer doubling), so long paths take few rounds.
    """
    both = cut(symmetrize(edges), "both")
    state = vertices.select("id", F.col("id").alias("comp"), F.lit(True).alias("changed"))

    def step(now: DataFrame, _: int) -> DataFrame:
        near = both.join(now.select(F.col("id").alias("dst"), F.col("comp").alias("c")), "dst").groupBy(F.col("src").alias("id")).agg(F.min("c").alias("c"))
        hooked = cut(now.join(near, "id", "left").select("id", F.col("comp").alias("old"), F.least("comp", "c").alias("comp")), "hooked")
        jump = hooked.select(F.col("id").alias("comp"), F.col("comp").alias("further"))
        return hooked.join(jump, "comp", "left").select("id", F.least("comp", "further").alias("comp"), (F.least("comp", "further") < F.col("old")).alias("changed"))

    return fixpoint(state, step, "changed")[0].drop("changed")


def minimum_forest(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """The edges (eid, src, dst, w) of the minimum spanning forest under (w, eid), by `merge_least`."""
    own, ids = edges.where("src <> dst").select("eid", "src", "dst", "w"), vertices.select("id")
    ends = own.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    chosen, _ = merge_least(ends.select("eid", F.col("src").alias("ca"), F.col("dst").alias("cb"), "w"))
    return own.join(chosen.hint("merge"), "eid", "left_semi").select("eid", "src", "dst", "w")


def merge_least(links: DataFrame, last: int = LAST) -> tuple[DataFrame, DataFrame]:
    """(eid) of the minimum spanning forest of (eid, ca, cb, w) under (w, eid), and (comp, root): the
    same root for all ends of a tree.

    In a round every component takes its least link to another, which points it to that one;
    of two that chose the same link the smaller is a root, and pointers are doubled until they
    end at roots. With at most ``last`` links open, one task tries these in order.
    """
    spark, kinds = links.sparkSession, dict(links.dtypes)
    path, kind = shared_path(spark, "least"), f"comp {kinds['ca']}, root {kinds['ca']}"
    spark.createDataFrame([], f"eid {kinds['eid']}").write.parquet(path)
    chosen = lambda: spark.read.schema(f"eid {kinds['eid']}").parquet(path)
    open_, roots = cut(links.where("ca <> cb").select("eid", "ca", "cb", "w"), "open"), None
    while (n := open_.count()) > last:
        ends = open_.select("w", "eid", F.col("ca").alias("comp"), F.col("cb").alias("root")).unionByName(open_.select("w", "eid", F.col("cb").alias("comp"), F.col("ca").alias("root")))
        best = cut(ends.groupBy("comp").agg(F.min(F.struct("w", "eid", "root")).alias("e")).select("comp", "e.root", "e.eid"), "best")
        best.select("eid").distinct().write.mode("append").parquet(path)
        twin = best.select(F.col("root").alias("comp"), F.col("comp").alias("root"), "eid", F.lit(True).alias("twin"))
        top = F.col("twin").isNotNull() & (F.col("comp") < F.col("root"))
        to = cut(best.join(twin, ["comp", "root", "eid"], "left").select("comp", F.when(top, F.col("comp")).otherwise(F.col("root")).alias("root"), (~top).alias("moved")), "pointers")
        while not to.where("moved").isEmpty():
            jump = to.select(F.col("comp").alias("root"), F.col("root").alias("r"))
            to = cut(to.join(jump, "root").select("comp", F.col("r").alias("root"), (F.col("r") != F.col("root")).alias("moved")), "pointers")
        to = to.select("comp", "root")
        a, b = to.select(F.col("comp").alias("ca"), F.col("root").alias("ra")), to.select(F.col("comp").alias("cb"), F.col("root").alias("rb"))
        open_ = cut(open_.join(a, "ca").join(b, "cb").where("ra <> rb").select("eid", F.col("ra").alias("ca"), F.col("rb").alias("cb"), "w"), "open")
        roots = to if roots is None else _follow(roots, to)
    if n:
        types = f"eid {kinds['eid']}, {kind}"
        solved = cut(open_.repartition(1).mapInArrow(_try_links, types), "solved")
        solved.where("comp is null").select("eid").write.mode("append").parquet(path)
        to = solved.where("comp is not null").select("comp", "root")
        roots = to if roots is None else _follow(roots, to)
    return chosen(), roots if roots is not None else spark.createDataFrame([], kind)


def _follow(roots: DataFrame, to: DataFrame) -> DataFrame:
    return cut(roots.join(to.select(F.col("comp").alias("root"), F.col("root").alias("r")), "root", "left").select("comp", F.coalesce("r", "root").alias("root")), "roots")


def _try_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links that join two trees in order of (w, eid), then each end with its tree's least end."""
    rows = [b for b in batches if b.num_rows]
    if not rows:
        return
    t = pa.Table.from_batches(rows)
    t = t.take(pc.sort_indices(t, sort_keys=[("w", "ascending"), ("eid", "ascending")], null_placement="at_start"))
    names = pc.unique(pa.chunked_array([*t["ca"].chunks, *t["cb"].chunks])).sort()
    a, b = (pc.index_in(t[c], names).to_numpy().tolist() for c in ("ca", "cb"))
    up = list(range(len(names)))

    def top(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    taken = []
    for i, (x, y) in enumerate(zip(a, b, strict=True)):
        x, y = top(x), top(y)
        if x != y:
            up[max(x, y)] = min(x, y)
            taken.append(i)
    eid, none = t["eid"].take(pa.array(taken, pa.int64())), pa.nulls(len(taken), names.type)
    yield from pa.table({"eid": eid, "comp": none, "root": none}).to_batches(max_chunksize=100_000)
    root = names.take(pa.array([top(x) for x in range(len(up))], pa.int64()))
    yield from pa.table({"eid": pa.nulls(len(names), t.schema.field("eid").type), "comp": names, "root": root}).to_batches(max_chunksize=100_000)


def spanning_forest(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """The edges (eid, src, dst) of a spanning forest: the one of least edge ids."""
    return minimum_forest(vertices, edges.withColumn("w", F.lit(0))).drop("w")


def core_numbers(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, core): the largest k for which the vertex is in a subgraph of degree k.

    Estimates begin at the degrees; each round takes the largest h such that h
    neighbours have estimates of h or more. Neighbours are counted by estimate, so a
    hub is as many rows as its neighbours have different estimates. After the first
    round only vertices that a neighbour fell below are counted again, as others keep theirs.
    """
    both = cut(symmetrize(edges), "both")
    d = both.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("core"))
    state = vertices.select("id").join(d, "id", "left").select("id", F.coalesce("core", F.lit(0)).alias("core"), F.lit(True).alias("changed"))
    down = Window.partitionBy("src").orderBy(F.desc("c")).rowsBetween(Window.unboundedPreceding, 0)

    def step(now: DataFrame, rounds: int) -> DataFrame:
        est, links = now.select(F.col("id").alias("dst"), F.col("core").alias("c")), both
        if rounds:
            fell = both.join(now.where("changed").select(F.col("id").alias("dst"), F.col("core").alias("c")), "dst").groupBy("src").agg(F.min("c").alias("c"))
            touched = fell.join(now.select(F.col("id").alias("src"), "core"), "src").where("c < core").select("src")
            links = both.join(touched, "src", "left_semi")
        counts = links.join(est, "dst").groupBy("src", "c").agg(F.count(F.lit(1)).alias("k"))
        h = counts.withColumn("upto", F.sum("k").over(down)).groupBy(F.col("src").alias("id")).agg(F.max(F.least("c", "upto")).alias("h"))
        new = F.least("core", "h")  # no h: the vertex was not counted again, and keeps what it has
        return now.join(h, "id", "left").select("id", new.alias("core"), (new < F.col("core")).alias("changed"))

    return fixpoint(state, step, "changed")[0].drop("changed")


def independent_set(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, chosen): the lexicographically first maximal independent set.

    A vertex is in once all smaller neighbours are out, and out once one of them is in.
    """
    lower = cut(undirected(edges), "lower")
    state = vertices.select("id", F.lit(None).cast("boolean").alias("chosen"), F.lit(True).alias("changed"))

    def step(now: DataFrame, _: int) -> DataFrame:
        seen = lower.join(now.select(F.col("id").alias("src"), F.col("chosen").alias("c")), "src").groupBy(F.col("dst").alias("id")).agg(F.coalesce(F.bool_or("c"), F.lit(False)).alias("any_in"), F.count_if(F.col("c").isNull()).alias("open"))
        new = F.when(F.col("chosen").isNotNull(), F.col("chosen")).when(F.coalesce("any_in", F.lit(False)), False).when(F.coalesce("open", F.lit(0)) == 0, True)
        return now.join(seen, "id", "left").select("id", new.alias("chosen"), (F.col("chosen").isNull() & new.isNotNull()).alias("changed"))

    return fixpoint(state, step, "changed")[0].drop("changed")


def matching(edges: DataFrame) -> DataFrame:
    """The edges (eid, src, dst) of the greedy matching in order of eid, by prefixes."""
    own = edges.where("src <> dst").select("eid", "src", "dst")
    ends = own.select(F.col("eid").alias("item"), F.col("eid").alias("priority"), F.explode(F.array("src", "dst")).alias("resource"))
    chosen = in_order(ends.withColumns({"needs": F.lit(True), "takes": F.lit(True)}))[0]
    return own.join(chosen.select(F.col("item").alias("eid")).hint("merge"), "eid", "left_semi")


def colouring(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, colour): greedy by falling degree (ties by id), each the smallest colour that
    no neighbour before it has; by prefixes."""
    return first_free(vertices, edges)


def set_cover(sets: DataFrame, last: int = LAST_PAIRS) -> DataFrame:
    """(set, round): a greedy cover of all elements of (set, element).

    A round takes, of the sets that are largest among those that share an open element
    with them (ties to the smaller set), all at once: they share nothing. An element leaves with its
    first set if that is taken, so a round is one job, which writes what stays and what leaves apart. With at most
    ``last`` pairs open, one task does the rounds that are left. Rows with nulls are left out.
    """
    spark, path, n = sets.sparkSession, shared_path(sets.sparkSession, "cover"), 0
    open_ = cut(sets.where("set is not null and element is not null").select("set", "element").distinct(), "open")
    schema = f"set {dict(sets.dtypes)['set']}, element {dict(sets.dtypes)['element']}, best {dict(sets.dtypes)['set']}, won boolean"
    while (left := open_.count()) > last:
        size = open_.groupBy("set").agg(F.count(F.lit(1)).alias("k"))
        ranked = open_.join(size, "set")
        best = ranked.groupBy("element").agg(F.min(F.struct(-F.col("k"), "set"))["set"].alias("best"))
        met = open_.join(best, "element")
        wins = met.groupBy("set").agg(F.bool_and(F.col("set") == F.col("best")).alias("win")).where("win").select(F.col("set").alias("best"), F.lit(True).alias("won"))
        done = met.join(wins, "best", "left").select("set", "element", "best", F.coalesce("won", F.lit(False)).alias("won"))
        done.write.partitionBy("won").parquet(f"{path}/round={n}")
        open_ = spark.read.schema(schema).parquet(f"{path}/round={n}").where("not won").select("set", "element")
        n += 1
    taken = spark.read.schema(f"{schema}, round int").parquet(path).where("won").select(F.col("best").alias("set"), "round").distinct() if n else None
    if left or not n:
        rest = cut(open_.repartition(1).mapInArrow(_rounds_left(n), f"set {dict(sets.dtypes)['set']}, round int"), "taken")
        taken = rest if taken is None else taken.unionByName(rest)
    return taken


def _rounds_left(begun: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """What one task does with the pairs (set, element) that are open after ``begun`` rounds: (set, round)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [b for b in batches if b.num_rows]
        if not rows:
            return
        t = pa.Table.from_batches(rows)
        del rows
        names = pc.unique(t["set"]).sort()
        s = pc.index_in(t["set"], names).to_numpy().astype(np.int32)
        e = pc.index_in(t["element"], pc.unique(t["element"])).to_numpy().astype(np.int32)
        del t
        order = np.argsort(e, kind="stable")
        s, e, r = s[order], e[order], begun
        while len(s):
            size = np.bincount(s, minlength=len(names))
            place = np.empty(len(names), dtype=np.int32)
            place[np.lexsort((np.arange(len(names)), -size))] = np.arange(len(names), dtype=np.int32)
            new = np.flatnonzero(np.diff(e, prepend=-1))
            own = place[s]
            first = np.repeat(np.minimum.reduceat(own, new), np.diff(new, append=len(e)))
            win = (size > 0) & (np.bincount(s[own != first], minlength=len(names)) == 0)
            sets = np.flatnonzero(win)
            yield pa.record_batch({"set": names.take(pa.array(sets)), "round": pa.array(np.full(len(sets), r, dtype=np.int32))})
            by_place = np.zeros(len(names), dtype=bool)
            by_place[place[sets]] = True
            keep = ~by_place[first]
            s, e, r = s[keep], e[keep], r + 1

    return run


def max_flow(arcs: DataFrame, source: int, sink: int) -> int:
    """The value of a maximum flow over arcs (src, dst, cap), by synchronous push-relabel.

    Heights begin at the distances to the sink. In a round every vertex with excess
    pushes along its admissible arcs in order; one that has none is lifted above its
    lowest residual neighbour. A vertex at height n or more is cut off from the sink,
    and what it holds does not count; when no other holds any, the sink has the flow.
    """
    both = arcs.select("src", "dst", "cap").unionByName(arcs.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(0).alias("cap"))).where("src <> dst")
    both = cut(both.groupBy("src", "dst").agg(F.sum("cap").cast("long").alias("res")), "arcs")
    nodes = both.select(F.col("src").alias("id")).distinct()
    n = nodes.count()
    first = both.where(F.col("src") == source).select(F.col("dst").alias("id"), F.col("res").alias("e"))
    heights = cut(nodes.join(first, "id", "left").select("id", F.when(F.col("id") == source, n).otherwise(0).cast("long").alias("h"), F.when(F.col("id") == source, 0).otherwise(F.coalesce("e", F.lit(0))).cast("long").alias("excess")), "nodes")
    back = both.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.when(F.col("src") == source, F.col("res")).otherwise(0).alias("more"))
    both = cut(both.join(back, ["src", "dst"]).select("src", "dst", (F.when(F.col("src") == source, 0).otherwise(F.col("res")) + F.col("more")).alias("res")), "arcs")
    back = both.where("res > 0").select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    near = bfs(back, nodes.where(F.col("id") == sink)).select("id", "dist")
    heights = cut(heights.join(near, "id", "left").select("id", F.when(F.col("id") == source, n).otherwise(F.coalesce("dist", F.lit(n))).cast("long").alias("h"), "excess"), "nodes")
    order = Window.partitionBy("src").orderBy("dst").rowsBetween(Window.unboundedPreceding, -1)
    inner = ~F.col("id").isin(source, sink) & (F.col("h") < n)
    while not heights.where(inner & (F.col("excess") > 0)).isEmpty():
        a = heights.select(F.col("id").alias("src"), F.col("h").alias("hs"), F.col("excess"))
        b = heights.select(F.col("id").alias("dst"), F.col("h").alias("hd"))
        active = both.where("res > 0").join(a.where(~F.col("src").isin(source, sink) & (F.col("excess") > 0) & (F.col("hs") < n)), "src").join(b, "dst")
        ok = active.where("hs = hd + 1").withColumn("before", F.coalesce(F.sum("res").over(order), F.lit(0)))
        pushed = cut(ok.select("src", "dst", F.greatest(F.lit(0), F.least("res", F.col("excess") - F.col("before"))).alias("p")).where("p > 0"), "pushed")
        lifted = active.join(pushed.select("src").distinct(), "src", "left_anti").groupBy(F.col("src").alias("id")).agg((F.min("hd") + 1).alias("lift"))
        delta = pushed.select("src", "dst", (-F.col("p")).alias("d")).unionByName(pushed.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.col("p").alias("d")))
        moved = pushed.select(F.col("src").alias("id"), (-F.col("p")).alias("m")).unionByName(pushed.select(F.col("dst").alias("id"), F.col("p").alias("m"))).groupBy("id").agg(F.sum("m").alias("m"))
        both = cut(both.join(delta, ["src", "dst"], "left").select("src", "dst", (F.col("res") + F.coalesce("d", F.lit(0))).alias("res")), "arcs")
        heights = cut(heights.join(moved, "id", "left").join(lifted, "id", "left").select("id", F.coalesce("lift", "h").alias("h"), (F.col("excess") + F.coalesce("m", F.lit(0))).alias("excess")), "nodes")
    got = heights.where(F.col("id") == sink).first()
    return int(got["excess"]) if got else 0
