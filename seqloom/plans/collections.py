"""Queries on ordered and keyed collections."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import query
from ..operators import grouping, ordered, scans, sorting
from .tables import BOTH, SEQ, other, seq, table


def rare():
    return F.col("val") > 20_000


@query("tabulate", "SELECT CAST(i AS BIGINT) AS pos, CAST(i * i % 97 AS BIGINT) AS val FROM generate_series(0, (SELECT count(*) - 1 FROM orders)) g(i)")
def _(spark, d):
    return ordered.tabulate(spark, table(spark, d, "orders").count(), (F.col("pos") * F.col("pos") % 97).cast("long"))


@query("iota_map", "SELECT CAST(i AS BIGINT) AS pos, CAST(3 * i + 1 AS BIGINT) AS val FROM generate_series(0, (SELECT count(*) - 1 FROM events)) g(i)")
def _(spark, d):
    return ordered.iota(spark, table(spark, d, "events").count()).select("pos", (3 * F.col("val") + 1).alias("val"))


@query("enumerate_events", SEQ + "SELECT pos, val FROM s")
def _(spark, d):
    return seq(spark, d).select("pos", "val")


@query("filter_ordered", SEQ + "SELECT row_number() OVER (ORDER BY pos) - 1 AS pos, val FROM s WHERE val > 20000")
def _(spark, d):
    return ordered.filter_into(seq(spark, d).select("pos", "val"), rare())[0]


@query("remove_if", SEQ + "SELECT row_number() OVER (ORDER BY pos) - 1 AS pos, val FROM s WHERE NOT val > 20000")
def _(spark, d):
    return ordered.renumber(seq(spark, d).select("pos", "val").where(~rare()))


@query("pack", SEQ + "SELECT row_number() OVER (ORDER BY pos) - 1 AS pos, val FROM s WHERE kind = 'click'")
def _(spark, d):
    s = seq(spark, d)
    return ordered.pack(s.select("pos", "val"), s.select("pos", (F.col("kind") == "click").alias("flag")))


@query("pack_index", SEQ + "SELECT row_number() OVER (ORDER BY pos) - 1 AS pos, pos AS val FROM s WHERE kind = 'error'")
def _(spark, d):
    return ordered.pack_index(seq(spark, d).select("pos", (F.col("kind") == "error").alias("flag")))


@query("map_maybe", SEQ + "SELECT row_number() OVER (ORDER BY pos) - 1 AS pos, val // 2 AS val FROM s WHERE val % 2 = 0")
def _(spark, d):
    return ordered.map_maybe(seq(spark, d), F.when(F.col("val") % 2 == 0, F.floor(F.col("val") / 2)))


@query("split_three", SEQ + "SELECT val % 3 AS part, row_number() OVER (ORDER BY val % 3, pos) - 1 AS pos, val FROM s")
def _(spark, d):
    return ordered.split_parts(seq(spark, d).select("pos", "val"), F.col("val") % 3)


@query("split_two", SEQ + "SELECT CAST(val > 20000 AS BIGINT) AS part, row_number() OVER (ORDER BY val > 20000, pos) - 1 AS pos, val FROM s")
def _(spark, d):
    return ordered.split_parts(seq(spark, d).select("pos", "val"), rare().cast("long"))


@query("is_partitioned", SEQ + "SELECT coalesce(max(pos) FILTER (val > 20000) < min(pos) FILTER (NOT val > 20000), true) AS result FROM s")
def _(spark, d):
    return ordered.is_partitioned(seq(spark, d), rare())


@query("quantifiers", SEQ + "SELECT count(*) FILTER (val > 20000) AS count_if, bool_and(val > 20000) AS all_of, bool_or(val > 20000) AS any_of, NOT bool_or(val > 20000) AS none_of FROM s")
def _(spark, d):
    return ordered.quantifiers(seq(spark, d), rare())


@query("find_if", SEQ + "SELECT coalesce(min(pos) FILTER (val > 40000), count(*)) AS pos FROM s")
def _(spark, d):
    return ordered.find_if(seq(spark, d), F.col("val") > 40_000)


@query("find_first_of", BOTH + "SELECT coalesce(min(pos) FILTER (val IN (SELECT val // 100 FROM t)), count(*)) AS pos FROM s")
def _(spark, d):
    return ordered.find_first_of(seq(spark, d), other(spark, d).select(F.floor(F.col("val") / 100).alias("val")))


@query("adjacent_find", SEQ + "SELECT coalesce(min(pos) FILTER (n = val), count(*)) AS pos FROM (SELECT pos, val, lead(val) OVER (ORDER BY pos) AS n FROM s)")
def _(spark, d):
    return ordered.adjacent_find(seq(spark, d), F.col("val") == F.col("next_val"))


@query("mismatch", BOTH + "SELECT coalesce(min(s.pos) FILTER (s.val % 2 <> t.val % 2), count(*)) AS pos FROM s JOIN t USING (pos)")
def _(spark, d):
    return ordered.mismatch(seq(spark, d).select("pos", (F.col("val") % 2).alias("val")), other(spark, d).select("pos", (F.col("val") % 2).alias("val")))


_PATTERN = SEQ.rstrip() + ", k AS (SELECT pos, val % 4 AS val FROM s), p(off, val) AS (VALUES (0, 1), (1, 3), (2, 0), (3, 2)), o AS (SELECT k.pos - off AS pos FROM k JOIN p ON k.val = p.val GROUP BY 1 HAVING count(*) = 4 AND k.pos - off >= 0) "


def _search(spark, d, last):
    pattern = spark.createDataFrame([(0, 1), (1, 3), (2, 0), (3, 2)], "pos long, val long")
    return ordered.search(seq(spark, d).select("pos", (F.col("val") % 4).alias("val")), pattern, last)


@query("search", _PATTERN + "SELECT coalesce(min(pos), (SELECT count(*) FROM s)) AS pos FROM o")
def _(spark, d):
    return _search(spark, d, False)


@query("find_end", _PATTERN + "SELECT coalesce(max(pos), (SELECT count(*) FROM s)) AS pos FROM o")
def _(spark, d):
    return _search(spark, d, True)


@query("equal", BOTH + "SELECT coalesce(bool_and(s.val IS NOT DISTINCT FROM t.val AND s.pos IS NOT NULL AND t.pos IS NOT NULL), true) AS result FROM s FULL JOIN t USING (pos)")
def _(spark, d):
    return ordered.equal(seq(spark, d), other(spark, d))


@query("lexicographical_compare", BOTH + "SELECT (SELECT s.val < t.val FROM s JOIN t USING (pos) WHERE s.val <> t.val ORDER BY pos LIMIT 1) AS result")
def _(spark, d):
    return ordered.lexicographical_compare(seq(spark, d), other(spark, d))


@query("is_sorted_until", SEQ + "SELECT coalesce(min(pos) FILTER (p > val), count(*)) AS pos, count(*) FILTER (p > val) = 0 AS is_sorted FROM (SELECT pos, val, lag(val) OVER (ORDER BY pos) AS p FROM s)")
def _(spark, d):
    return ordered.is_sorted_until(seq(spark, d))


@query("reverse", SEQ + "SELECT (SELECT count(*) FROM s) - 1 - pos AS pos, val FROM s")
def _(spark, d):
    return ordered.reverse(seq(spark, d).select("pos", "val"))


@query("rotate", SEQ + "SELECT (pos - 777 + (SELECT count(*) FROM s)) % (SELECT count(*) FROM s) AS pos, val FROM s")
def _(spark, d):
    return ordered.rotate(seq(spark, d).select("pos", "val"), 777)


@query("zip_with", BOTH + "SELECT pos, s.val + t.val AS val FROM s JOIN t USING (pos)")
def _(spark, d):
    return ordered.zip_with(seq(spark, d), other(spark, d), F.col("x") + F.col("y"))


@query("append", BOTH + "SELECT pos, val FROM s UNION ALL SELECT pos + (SELECT count(*) FROM s), val FROM t")
def _(spark, d):
    return ordered.append(seq(spark, d), other(spark, d))


@query("flatten", SEQ + "SELECT row_number() OVER (ORDER BY pos, i) - 1 AS pos, val * 10 + i AS val FROM s, generate_series(0, 2) g(i) WHERE i < val % 4")
def _(spark, d):
    s = seq(spark, d)
    nested = s.select("pos", F.when(F.col("val") % 4 > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.col("val") % 4 - 1), lambda i: F.col("val") * 10 + i)).otherwise(F.array().cast("array<bigint>")).alias("val"))
    return ordered.flatten(nested)


_PIECES = SEQ.rstrip() + ", f AS (SELECT pos, coalesce(sum(CAST(kind = 'error' AS BIGINT)) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS piece, val FROM s) "


@query("split_at", _PIECES + "SELECT pos, val, CAST(piece AS BIGINT) AS piece FROM f")
def _(spark, d):
    return ordered.split_at(seq(spark, d), F.col("kind") == "error").select("pos", "val", "piece")


@query("split_at_sizes", _PIECES.rstrip() + ", c AS (SELECT CAST(piece AS BIGINT) AS piece, count(*) AS size FROM f GROUP BY 1), l AS (SELECT count(*) FILTER (kind = 'error') AS piece FROM s) SELECT piece, size FROM c UNION ALL SELECT piece, 0 FROM l WHERE piece NOT IN (SELECT piece FROM c)")
def _(spark, d):
    return ordered.piece_sizes(seq(spark, d), F.col("kind") == "error")


@query("random_shuffle")
def _(spark, d):
    return ordered.random_shuffle(seq(spark, d).select("pos", "val"), 7)


@query("reduce_monoids", SEQ + "SELECT CAST(sum(val) AS BIGINT) AS sum, min(val) AS min, max(val) AS max, bit_or(val) AS bit_or, bit_xor(val) AS bit_xor, bit_and(val) AS bit_and FROM (SELECT CAST(val AS BIGINT) AS val FROM s)")
def _(spark, d):
    return scans.reduce(seq(spark, d), "sum", "min", "max", "bit_or", "bit_xor", "bit_and")


@query("reduce_logical", SEQ + "SELECT bool_and(val > 0) AS bool_and, bool_or(val > 48000) AS bool_or, count(*) AS n FROM s")
def _(spark, d):
    s = seq(spark, d).select((F.col("val") > 0).alias("a"), (F.col("val") > 48_000).alias("b"), F.lit(1).cast("long").alias("one"))
    return scans.reduce_columns(s, {"bool_and": ("bool_and", "a"), "bool_or": ("bool_or", "b"), "n": ("sum", "one")})


@query("reduce_product", "SELECT product(CASE WHEN s_suppkey % 10 = 0 THEN 2.0 ELSE 1.0 END) AS product, min(s_nationkey) AS low, max(s_nationkey) AS high FROM supplier")
def _(spark, d):
    rows = table(spark, d, "supplier").select(F.when(F.col("s_suppkey") % 10 == 0, 2.0).otherwise(1.0).alias("val"), "s_nationkey")
    return scans.reduce_columns(rows, {"product": ("product", "val"), "low": ("min", "s_nationkey"), "high": ("max", "s_nationkey")})


#: Factors of 2 for 100,000 positions, then of 0.5 for as many: products stay between 1 and 2^200, so they are exact and finite at any length.
_FACTOR = "CASE WHEN pos % 500 <> 3 THEN 1.0 WHEN pos // 100000 % 2 = 0 THEN 2.0 ELSE 0.5 END"


@query("scan_product", SEQ + f"SELECT pos, product(v) OVER (ORDER BY pos) AS val FROM (SELECT pos, {_FACTOR} AS v FROM s)")
def _(spark, d):
    factor = F.when(F.col("pos") % 500 != 3, 1.0).when(F.floor(F.col("pos") / 100_000) % 2 == 0, 2.0).otherwise(0.5)
    return scans.scan(seq(spark, d).select("pos", factor.alias("val")), "product", inclusive=True)


@query("map_split_at", _PIECES + "SELECT CAST(piece AS BIGINT) AS piece, max(val) AS val FROM f GROUP BY 1")
def _(spark, d):
    return ordered.map_split_at(seq(spark, d), F.col("kind") == "error", F.max("val"))


@query("keys_view", "SELECT o_orderkey AS pos, o_custkey AS val FROM orders")
def _(spark, d):
    return ordered.keys_of(table(spark, d, "orders").select(F.col("o_orderkey").alias("pos"), F.col("o_custkey").alias("k"), F.col("o_totalprice").alias("v")))


@query("values_view", "SELECT o_orderkey AS pos, o_custkey AS val FROM orders")
def _(spark, d):
    return ordered.values_of(table(spark, d, "orders").select(F.col("o_orderkey").alias("pos"), F.col("o_orderstatus").alias("k"), F.col("o_custkey").alias("v")))


@query("scan_exclusive", SEQ + "SELECT pos, CAST(coalesce(sum(val) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS val FROM s")
def _(spark, d):
    return scans.scan(seq(spark, d))


@query("scan_inclusive", SEQ + "SELECT pos, CAST(sum(val) OVER (ORDER BY pos) AS BIGINT) AS val FROM s")
def _(spark, d):
    return scans.scan(seq(spark, d), inclusive=True)


@query("scan_max", SEQ + "SELECT pos, max(val) OVER (ORDER BY pos) AS val FROM s")
def _(spark, d):
    return scans.scan(seq(spark, d), "max", inclusive=True)


@query("minmax_element", SEQ + "SELECT (SELECT pos FROM s ORDER BY val, pos LIMIT 1) AS min_pos, (SELECT pos FROM s ORDER BY val DESC, pos LIMIT 1) AS max_pos")
def _(spark, d):
    return scans.extreme_positions(seq(spark, d))


@query("mcss", SEQ.rstrip() + ", p AS (SELECT pos, sum(val - 5000) OVER (ORDER BY pos) AS p FROM s) SELECT CAST(max(p - m) AS BIGINT) AS mcss FROM (SELECT p, least(coalesce(min(p) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0) AS m FROM p)")
def _(spark, d):
    return scans.max_subsequence_sum(seq(spark, d).select("pos", (F.col("val") - 5000).alias("val")))


def _lines(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_suppkey").alias("k"), F.col("l_quantity").cast("long").alias("v"))


@query("reduce_by_key", "SELECT l_suppkey AS k, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS total, max(CAST(l_quantity AS BIGINT)) AS most, count(*) AS n FROM lineitem GROUP BY 1")
def _(spark, d):
    return grouping.reduce_by_key(_lines(spark, d), F.sum("v").alias("total"), F.max("v").alias("most"), F.count(F.lit(1)).alias("n"))


@query("histogram_by_key", "SELECT l_suppkey AS k, count(*) AS n FROM lineitem GROUP BY 1")
def _(spark, d):
    return grouping.histogram_by_key(_lines(spark, d))


def _baskets(spark, d):
    own = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    return own.select(F.col("l_orderkey").alias("k"), F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity").alias("pos"), F.col("l_partkey").alias("v"))


_ORDER = "ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity"


@query("group_by_key", f"SELECT l_orderkey AS k, string_agg(CAST(l_partkey AS VARCHAR), ',' {_ORDER}) AS vals FROM lineitem GROUP BY 1")
def _(spark, d):
    return grouping.group_by_key(_baskets(spark, d)).select("k", F.array_join(F.col("vals").cast("array<string>"), ",").alias("vals"))


@query("group_by_key_ordered", f"SELECT row_number() OVER (ORDER BY l_orderkey) - 1 AS pos, l_orderkey AS k, string_agg(CAST(l_partkey AS VARCHAR), ',' {_ORDER}) AS vals FROM lineitem GROUP BY l_orderkey")
def _(spark, d):
    grouped = grouping.group_by_key(_baskets(spark, d)).select("k", F.array_join(F.col("vals").cast("array<string>"), ",").alias("vals"))
    return ordered.positions(grouped, "k").select("pos", "k", "vals")


@query("fold_by_key", f"SELECT k, CAST(list_reduce(list_prepend(CAST(7 AS BIGINT), v), lambda a, b: (a * 31 + b) % 1000003) AS BIGINT) AS val FROM (SELECT l_orderkey AS k, list(l_partkey {_ORDER}) AS v FROM lineitem GROUP BY 1)")
def _(spark, d):
    return grouping.fold_by_key(_baskets(spark, d), F.lit(7).cast("long"), lambda a, b: (a * 31 + b) % 1_000_003)


@query("remove_duplicates", "SELECT DISTINCT l_partkey AS val FROM lineitem")
def _(spark, d):
    return grouping.remove_duplicates(table(spark, d, "lineitem").select(F.col("l_partkey").alias("val")))


@query("remove_duplicates_ordered", "SELECT row_number() OVER (ORDER BY val) - 1 AS pos, val FROM (SELECT DISTINCT l_partkey AS val FROM lineitem)")
def _(spark, d):
    return ordered.positions(grouping.remove_duplicates(table(spark, d, "lineitem").select(F.col("l_partkey").alias("val"))), "val").select("pos", "val")


@query("unique_adjacent", SEQ + "SELECT row_number() OVER (ORDER BY pos) - 1 AS pos, val FROM (SELECT pos, kind AS val, lag(kind) OVER (ORDER BY pos) AS p FROM s) WHERE p IS NULL OR p <> val")
def _(spark, d):
    return grouping.unique(seq(spark, d).select("pos", F.col("kind").alias("val")))


@query("reduce_by_index", "SELECT CAST(i AS BIGINT) AS k, CAST(coalesce(sum(CAST(l_quantity AS BIGINT)), 0) AS BIGINT) AS val FROM generate_series(0, 2 * (SELECT count(*) FROM part) - 1) g(i) LEFT JOIN lineitem ON l_partkey = i GROUP BY 1")
def _(spark, d):
    pairs = table(spark, d, "lineitem").select(F.col("l_partkey").alias("k"), F.col("l_quantity").cast("long").alias("v"))
    return grouping.by_index(spark, 2 * table(spark, d, "part").count(), pairs, F.sum("v"), F.lit(0).cast("long"))


@query("histogram_by_index", "SELECT CAST(i AS BIGINT) AS k, count(l_partkey) AS val FROM generate_series(0, 2 * (SELECT count(*) FROM part) - 1) g(i) LEFT JOIN lineitem ON l_partkey = i GROUP BY 1")
def _(spark, d):
    pairs = table(spark, d, "lineitem").select(F.col("l_partkey").alias("k"))
    return grouping.by_index(spark, 2 * table(spark, d, "part").count(), pairs, F.count(F.lit(1)), F.lit(0).cast("long"))


@query("group_by_index", "SELECT CAST(i AS BIGINT) AS k, coalesce(string_agg(CAST(c_custkey AS VARCHAR), ',' ORDER BY c_custkey), '') AS val FROM generate_series(0, 29) g(i) LEFT JOIN customer ON c_nationkey = i GROUP BY 1")
def _(spark, d):
    pairs = table(spark, d, "customer").select(F.col("c_nationkey").cast("long").alias("k"), F.col("c_custkey").alias("v"))
    grouped = grouping.by_index(spark, 30, pairs, F.array_sort(F.collect_list("v")), F.array().cast("array<bigint>"))
    return grouped.select("k", F.array_join(F.col("val").cast("array<string>"), ",").alias("val"))


@query("keyed_table", """WITH w AS (SELECT c_nationkey AS k, c_custkey AS v FROM customer), a AS (SELECT k, min(v) AS v FROM w GROUP BY 1),
 r AS (SELECT * FROM a WHERE k NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)), n AS (SELECT s_nationkey AS k, min(s_suppkey) + 1000000 AS v FROM supplier GROUP BY 1)
 SELECT CAST(k AS BIGINT) AS k, v FROM r UNION ALL SELECT CAST(k AS BIGINT), v FROM n WHERE k NOT IN (SELECT k FROM r)""")
def _(spark, d):
    first = table(spark, d, "customer").select(F.col("c_nationkey").cast("long").alias("k"), F.col("c_custkey").alias("v"), F.col("c_custkey").alias("pos"))
    gone = table(spark, d, "nation").where("n_regionkey = 2").select(F.col("n_nationkey").cast("long").alias("k"))
    more = table(spark, d, "supplier").select(F.col("s_nationkey").cast("long").alias("k"), (F.col("s_suppkey") + 1_000_000).alias("v"), F.col("s_suppkey").alias("pos"))
    return grouping.KeyedTable.of(first).remove(gone).insert(more).df


@query("scatter_min", "SELECT o_custkey AS k, min(CAST(floor(o_totalprice) AS BIGINT)) AS v FROM orders GROUP BY 1")
def _(spark, d):
    return grouping.scatter(table(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.floor("o_totalprice").alias("v")), "min")


@query("gather", SEQ + "SELECT o_orderkey AS pos, val FROM orders JOIN s ON s.pos = o_custkey")
def _(spark, d):
    return grouping.gather(seq(spark, d).select("pos", "val"), table(spark, d, "orders").select(F.col("o_orderkey").alias("pos"), F.col("o_custkey").alias("k"))).select("pos", "val")


@query("sort", SEQ + "SELECT row_number() OVER (ORDER BY val, pos) - 1 AS pos, val FROM s")
def _(spark, d):
    return sorting.sort(seq(spark, d).select("pos", "val"))


@query("stable_sort", SEQ + "SELECT row_number() OVER (ORDER BY kind, pos) - 1 AS pos, kind, val FROM s")
def _(spark, d):
    return sorting.sort(seq(spark, d).select("pos", "kind", "val"), F.col("kind"))


@query("integer_sort", SEQ + "SELECT row_number() OVER (ORDER BY val % 256 DESC, pos) - 1 AS pos, val FROM s")
def _(spark, d):
    return sorting.sort(seq(spark, d).select("pos", "val"), F.col("val") % 256, descending=True)


@query("counting_sort_offsets", SEQ + "SELECT CAST(i AS BIGINT) AS k, (SELECT count(*) FROM s WHERE val % 16 < i) AS start FROM generate_series(0, 16) g(i)")
def _(spark, d):
    return sorting.counting_sort(seq(spark, d).select("pos", "val", (F.col("val") % 16).alias("k")), 16)[1]


@query("merge_sorted", BOTH + "SELECT row_number() OVER (ORDER BY val, x, p) - 1 AS pos, val FROM (SELECT val, 0 AS x, pos AS p FROM s UNION ALL SELECT val, 1, pos FROM t)")
def _(spark, d):
    return sorting.merge(sorting.sort(seq(spark, d).select("pos", "val")), sorting.sort(other(spark, d)))


@query("rank", SEQ + "SELECT pos, row_number() OVER (ORDER BY val, pos) - 1 AS rank FROM s")
def _(spark, d):
    return sorting.rank(seq(spark, d))


@query("kth_smallest", SEQ + "SELECT val FROM s ORDER BY val LIMIT 1 OFFSET 1234")
def _(spark, d):
    s = seq(spark, d)
    return sorting.kth_smallest(s, 1234) if s.count() > 1234 else s.limit(0).select("val")


@query("top_k", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 25")
def _(spark, d):
    return sorting.top_k(table(spark, d, "customer").select("c_custkey", "c_acctbal"), 25, "c_acctbal", "c_custkey")


@query("set_union", "SELECT o_custkey AS k FROM orders UNION SELECT c_custkey FROM customer")
def _(spark, d):
    return ordered.union(table(spark, d, "orders").select(F.col("o_custkey").alias("k")), table(spark, d, "customer").select(F.col("c_custkey").alias("k")))


@query("set_difference", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders")
def _(spark, d):
    return ordered.difference(table(spark, d, "customer").select(F.col("c_custkey").alias("k")), table(spark, d, "orders").select(F.col("o_custkey").alias("k")))


@query("intersection_size", "SELECT count(*) AS n FROM (SELECT DISTINCT l_partkey AS k FROM lineitem INTERSECT SELECT s_suppkey FROM supplier)")
def _(spark, d):
    return ordered.intersection_size(table(spark, d, "lineitem").select(F.col("l_partkey").alias("k")), table(spark, d, "supplier").select(F.col("s_suppkey").alias("k")))


@query("lower_bound", SEQ + "SELECT k AS key, (SELECT count(*) FROM s WHERE val < k) AS pos FROM (SELECT DISTINCT c_custkey * 7 AS k FROM customer)")
def _(spark, d):
    return ordered.lower_bound(sorting.sort(seq(spark, d).select("pos", "val")), table(spark, d, "customer").select((F.col("c_custkey") * 7).alias("key")))
