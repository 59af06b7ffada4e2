"""Queries on texts and numbers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import query
from ..functions import numeric, patterns, text
from ..operators.ordered import positions
from ..sources.files import scrape
from .tables import SEQ, seq, table

_LOW = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACES = r"'[ \f\n\r\t\x0B]+'"


@query("word_counts", f"SELECT word, count(*) AS n FROM (SELECT unnest(regexp_split_to_array({_LOW}, '[^a-z]+')) AS word FROM documents) WHERE word <> '' GROUP BY 1")
def _(spark, d):
    return text.word_counts(table(spark, d, "documents"))


@query("word_counts_top", f"SELECT word, count(*) AS n FROM (SELECT unnest(regexp_split_to_array({_LOW}, '[^a-z]+')) AS word FROM documents) WHERE word <> '' GROUP BY 1 ORDER BY n DESC, word LIMIT 50")
def _(spark, d):
    return text.word_counts(table(spark, d, "documents")).orderBy(F.desc("n"), "word").limit(50)


@query("tokens", f"SELECT doc_id, CAST(len(t) AS BIGINT) AS n, coalesce(list_max(list_transform(t, lambda x: length(x))), 0) AS longest, coalesce(t[1], '') AS first FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, {_SPACES}), lambda x: x <> '') AS t FROM documents)")
def _(spark, d):
    t = table(spark, d, "documents").select("doc_id", text.tokens("text").alias("t"))
    longest = F.coalesce(F.array_max(F.transform("t", lambda x: F.length(x))), F.lit(0)).cast("long")
    return t.select("doc_id", F.size("t").cast("long").alias("n"), longest.alias("longest"), F.coalesce(F.get("t", F.lit(0)), F.lit("")).alias("first"))


@query("line_word_byte_counts", f"SELECT CAST(sum(length(text) - length(replace(text, chr(10), ''))) AS BIGINT) AS lines, CAST(sum(len(list_filter(regexp_split_to_array(text, {_SPACES}), lambda x: x <> ''))) AS BIGINT) AS words, CAST(sum(strlen(text)) AS BIGINT) AS bytes FROM documents")
def _(spark, d):
    return text.line_word_byte_counts(table(spark, d, "documents"))


@query("parse_integers", "SELECT c_custkey, CAST(split_part(c_name, '#', 2) AS BIGINT) AS number, TRY_CAST(nullif(regexp_extract(CAST(c_acctbal AS VARCHAR), '^([+-]?[0-9]+)', 1), '') AS BIGINT) AS whole FROM customer")
def _(spark, d):
    c = table(spark, d, "customer")
    return c.select("c_custkey", text.to_integer(F.substring_index("c_name", "#", -1)).alias("number"), text.to_integer(F.format_string("%.2f", "c_acctbal")).alias("whole"))


@query("parse_floats", "SELECT o_orderkey, round(o_totalprice, 2) AS price FROM orders")
def _(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.replace(F.format_string("%.2f", "o_totalprice"), F.lit("."), F.lit(",")).alias("t"))
    return o.select("o_orderkey", F.round(text.to_float("t"), 2).alias("price"))


@query("format_values", "SELECT o_orderkey, CASE WHEN o_totalprice > 100000 THEN '1' ELSE '0' END AS flag, '(' || o_orderkey || ', ' || o_custkey || ')' AS pair, '[' || o_orderkey || ', ' || o_custkey || ', 7]' AS arr FROM orders")
def _(spark, d):
    o = table(spark, d, "orders")
    return o.select(
        "o_orderkey", text.format_value(F.col("o_totalprice") > 100_000, "boolean").alias("flag"), text.format_value(F.struct("o_orderkey", "o_custkey"), "struct").alias("pair"), text.format_value(F.array("o_orderkey", "o_custkey", F.lit(7).cast("long")), "array").alias("arr")
    )


@query("find_all", "SELECT doc_id, CAST((length(text) - length(replace(text, 'the', ''))) // 3 AS BIGINT) AS n, CAST(instr(text, 'the') - 1 AS BIGINT) AS first FROM documents WHERE contains(text, 'the')")
def _(spark, d):
    at = table(spark, d, "documents").select("doc_id", text.find_all(F.col("text"), "the").alias("at")).where(F.size("at") > 0)
    return at.select("doc_id", F.size("at").cast("long").alias("n"), F.col("at")[0].cast("long").alias("first"))


@query("find_overlapping", "SELECT doc_id, count(*) AS n, min(i) - 1 AS first, max(i) - 1 AS last FROM (SELECT doc_id, text, unnest(generate_series(1, length(text) - 2)) AS i FROM documents) WHERE substr(text, i, 3) = 'ene' GROUP BY 1")
def _(spark, d):
    at = table(spark, d, "documents").select("doc_id", text.find_all(F.col("text"), "ene").alias("at")).where(F.size("at") > 0)
    return at.select("doc_id", F.size("at").cast("long").alias("n"), F.col("at")[0].cast("long").alias("first"), F.element_at("at", -1).cast("long").alias("last"))


@query("edit_distance")
def _(spark, d):
    pages = table(spark, d, "pages").select("page_id", "url")
    other = pages.select((F.col("page_id") - 1).alias("page_id"), F.col("url").alias("other"))
    return pages.join(other, "page_id").select("page_id", text.edit_distance(F.col("url"), F.col("other")).alias("indel"), F.levenshtein("url", "other").alias("levenshtein"))


def _codes(spark, d):
    return seq(spark, d).select("pos", F.ascii("kind").cast("long").alias("val"))


@query("suffix_array", SEQ.rstrip() + ", x AS (SELECT string_agg(kind[1], '' ORDER BY pos) AS t FROM s) SELECT row_number() OVER (ORDER BY substr(t, CAST(pos AS BIGINT) + 1)) - 1 AS rank, pos FROM s, x")
def _(spark, d):
    return text.suffix_array(_codes(spark, d))


_LCP = SEQ.rstrip() + """, x AS MATERIALIZED (SELECT string_agg(kind[1], '' ORDER BY pos) AS t FROM s), f AS (SELECT row_number() OVER (ORDER BY substr(t, CAST(pos AS BIGINT) + 1)) - 1 AS rank, pos FROM s, x),
 g AS (SELECT rank, pos, lag(pos) OVER (ORDER BY rank) AS prev FROM f), l AS MATERIALIZED (SELECT rank, pos, prev, CAST((SELECT coalesce(max(k), 0) FROM generate_series(1, 200) y(k) WHERE substr(t, CAST(pos AS BIGINT) + 1, k) = substr(t, CAST(prev AS BIGINT) + 1, k) AND k <= length(t) - greatest(pos, prev)) AS BIGINT) AS lcp FROM g, x WHERE prev IS NOT NULL) """


@query("longest_common_prefixes", _LCP + "SELECT rank, pos, prev, lcp FROM l")
def _(spark, d):
    return text.lcp(_codes(spark, d))


@query("longest_repeated_run", _LCP + "SELECT lcp AS length, least(pos, prev) AS first, greatest(pos, prev) AS second FROM l ORDER BY lcp DESC, rank LIMIT 1")
def _(spark, d):
    return text.longest_repeat(_codes(spark, d))


@query("suffix_tree_nodes", _LCP.rstrip() + """, n AS (SELECT a.rank, a.lcp, (SELECT max(b.rank) FROM l b WHERE b.rank < a.rank AND b.lcp <= a.lcp) AS lo, (SELECT min(b.rank) FROM l b WHERE b.rank > a.rank AND b.lcp < a.lcp) AS hi FROM l a)
 SELECT n.rank AS node, CASE WHEN lo IS NULL THEN coalesce(hi, n.rank) WHEN hi IS NULL THEN lo WHEN y.lcp >= x.lcp THEN hi ELSE lo END AS parent, n.lcp AS depth FROM n LEFT JOIN l x ON x.rank = lo LEFT JOIN l y ON y.rank = hi""")
def _(spark, d):
    return text.suffix_tree(_codes(spark, d))


@query("cartesian_tree", SEQ.rstrip() + """, n AS (SELECT a.pos, a.val, (SELECT max(b.pos) FROM s b WHERE b.pos < a.pos AND b.val <= a.val) AS l, (SELECT min(b.pos) FROM s b WHERE b.pos > a.pos AND b.val < a.val) AS r FROM s a)
 SELECT n.pos, n.val, CASE WHEN l IS NULL THEN coalesce(r, n.pos) WHEN r IS NULL THEN l WHEN y.val >= x.val THEN r ELSE l END AS parent FROM n LEFT JOIN s x ON x.pos = l LEFT JOIN s y ON y.pos = r""")
def _(spark, d):
    return text.cartesian_tree(seq(spark, d))


@query("huffman_bits")
def _(spark, d):
    counts = text.word_counts(table(spark, d, "documents")).select(F.col("word").alias("symbol"), F.col("n").alias("weight"))
    return text.huffman_lengths(counts)


@query("line_fit", "SELECT round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept FROM lineitem")
def _(spark, d):
    got = numeric.line_fit(table(spark, d, "lineitem").select(F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y")))
    return got.select(F.round("slope", 4).alias("slope"), F.round("intercept", 4).alias("intercept"))


@query("big_integers", "SELECT o_orderkey, CAST(CAST(o_orderkey AS HUGEINT) * 1000000007 * 1000003 + o_custkey AS VARCHAR) AS total, CAST(CAST(o_orderkey + 1 AS HUGEINT) * 1000000007 * (o_custkey + 3) AS VARCHAR) AS product FROM orders")
def _(spark, d):
    o = table(spark, d, "orders")
    wide = numeric.big_multiply(F.col("o_orderkey").cast("string"), F.lit(str(1_000_000_007 * 1_000_003)))
    product = numeric.big_multiply((F.col("o_orderkey") + 1).cast("string"), ((F.col("o_custkey") + 3) * 1_000_000_007).cast("string"))
    return o.select("o_orderkey", numeric.big_add(wide, F.col("o_custkey").cast("string")).alias("total"), product.alias("product"))


def _fft_part(f: str) -> str:
    return f"round(sum(v * {f}(2 * pi() * ((j * k) % n) / n)), 6) + 0.0"


@query("fft", "WITH e AS (SELECT vec_id, len(embedding) AS n, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS j FROM embeddings), "
       f"k AS (SELECT e.*, k FROM e, generate_series(0, 63) g(k) WHERE k < n) SELECT vec_id, CAST(k AS BIGINT) AS pos, {_fft_part('cos')} AS re, -({_fft_part('sin')}) + 0.0 AS im FROM k GROUP BY vec_id, k")
def _(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("pos", "val"))
    return numeric.fft(e, "vec_id").select("vec_id", "pos", *((F.round(c, 6) + F.lit(0.0)).alias(c) for c in ("re", "im")))


@query("primes", "WITH n AS (SELECT count(*) AS n FROM orders), f AS (SELECT unnest(generate_series(2, CAST(sqrt(n) AS BIGINT) + 1)) AS k FROM n) SELECT CAST(p AS BIGINT) AS p FROM generate_series(2, (SELECT n FROM n)) g(p) WHERE NOT EXISTS (SELECT 1 FROM f WHERE k < p AND p % k = 0)")
def _(spark, d):
    """Up to as many as there are orders."""
    return numeric.primes(spark, table(spark, d, "orders").count())


@query("integrate", "WITH n AS (SELECT 10.0::DOUBLE / count(*) AS h, count(*) AS n FROM lineitem) SELECT round(sum(sqrt(h / 2 + i * h)) * any_value(h), 6) AS integral FROM n, generate_series(0, (SELECT n - 1 FROM n)) g(i)")
def _(spark, d):
    """In as many steps as there are lines of orders."""
    return numeric.integrate(spark, F.sqrt("x"), 0.0, 10.0, table(spark, d, "lineitem").count()).select(F.round("integral", 6).alias("integral"))


@query("range_min", SEQ.rstrip() + ", q AS (SELECT o_orderkey AS q, (o_orderkey * 37) % (SELECT count(*) FROM s) AS i, o_custkey AS w FROM orders), p AS (SELECT q, i, least(i + w, (SELECT count(*) FROM s) - 1) AS j FROM q) SELECT q, arg_min(pos, (val, pos)) AS pos FROM p JOIN s ON s.pos BETWEEN i AND j GROUP BY q")
def _(spark, d):
    s = seq(spark, d).select("pos", "val")
    n = s.count()
    q = table(spark, d, "orders").select(F.col("o_orderkey").alias("q"), (F.col("o_orderkey") * 37 % n).alias("i"), F.col("o_custkey").alias("w"))
    return numeric.range_min(s, q.select("q", "i", F.least(F.col("i") + F.col("w"), F.lit(n - 1)).alias("j")))


@query("cycle_count")
def _(spark, d):
    s = seq(spark, d).select("pos", F.xxhash64("pos").alias("h"))
    perm = positions(s.withColumnRenamed("pos", "val"), "h", "val").select("pos", "val")
    return spark.createDataFrame([(numeric.cycle_count(perm),)], "cycles long")


def _cycles_sql(rounds: int = 24) -> str:
    """Doubling as in the operator; up to 2 ** rounds elements."""
    parts = ["WITH n AS (SELECT count(*) AS n FROM events), p0 AS MATERIALIZED (SELECT i AS pos, (i * 7919 + 13) % n AS nxt, least(i, (i * 7919 + 13) % n) AS m FROM n, generate_series(0, n - 1) g(i))"]
    for k in range(1, rounds + 1):
        parts.append(f", p{k} AS MATERIALIZED (SELECT a.pos, b.nxt, least(a.m, b.m) AS m FROM p{k - 1} a JOIN p{k - 1} b ON b.pos = a.nxt)")
    return "".join(parts) + f" SELECT count(DISTINCT m) AS cycles FROM p{rounds}"


@query("cycle_count_affine", _cycles_sql())
def _(spark, d):
    """Of i -> (7919 i + 13) mod n, a permutation where 7919 does not divide n."""
    n = table(spark, d, "events").count()
    perm = spark.range(n).select(F.col("id").alias("pos"), ((F.col("id") * 7919 + 13) % n).alias("val"))
    return spark.createDataFrame([(numeric.cycle_count(perm),)], "cycles long")


@query("log2_up", "SELECT p_partkey, CAST(ceil(log2(p_size)) AS INTEGER) AS bits FROM part WHERE p_size > 0")
def _(spark, d):
    return table(spark, d, "part").where("p_size > 0").select("p_partkey", numeric.log2_up(F.col("p_size").cast("long")).alias("bits"))


@query("bucket_of", "SELECT p_partkey, CAST((p_size >= 5) AS INTEGER) + CAST((p_size >= 20) AS INTEGER) + CAST((p_size >= 40) AS INTEGER) AS bucket FROM part")
def _(spark, d):
    return table(spark, d, "part").select("p_partkey", numeric.bucket_of(F.col("p_size").cast("double"), [5.0, 20.0, 40.0]).alias("bucket"))


@query("scrape_numbers", r"SELECT CAST(regexp_extract(props, '\"k\": ([0-9]+)', 1) AS DOUBLE) AS k FROM events WHERE regexp_extract(props, '\"k\": ([0-9]+)', 1) <> ''".replace('\\"', '"'))
def _(spark, d):
    return scrape(table(spark, d, "events").select(F.col("props").alias("value")), r'"k": ([0-9]+)', "k")


_PATTERNS = """WITH w AS (SELECT DISTINCT unnest(string_split(text, ' ')) AS pattern FROM documents), q AS (SELECT pattern FROM w WHERE length(pattern) BETWEEN 5 AND 12 UNION SELECT substr(text, 11, 60) FROM benchmark WHERE length(text) > 10),
 i AS (SELECT item_id, text, unnest(generate_series(1, length(text))) AS i FROM benchmark), l AS (SELECT DISTINCT length(pattern) AS k FROM q),
 f AS (SELECT q.pattern, item_id AS doc, i - 1 AS "at" FROM i JOIN l ON i + k - 1 <= length(text) JOIN q ON q.pattern = substr(text, i, k)) """


def _pattern_tables(spark, d):
    words = table(spark, d, "documents").select(F.explode(patterns.words_of(F.col("text"), 5, 12)).alias("pattern"))
    items = table(spark, d, "benchmark")
    long_ = items.where(F.length("text") > 10).select(F.substring("text", 11, 60).alias("pattern"))
    return patterns.build(items, "item_id", "text"), words.distinct(), long_


@query("pattern_lookup", _PATTERNS + "SELECT pattern, doc, \"at\" FROM f")
def _(spark, d):
    """Where the texts of benchmark have the words of documents (of 5 to 12 characters), and passages of 60 characters."""
    index, words, long_ = _pattern_tables(spark, d)
    return patterns.find(index, words.unionByName(long_))


@query("pattern_counts", _PATTERNS + "SELECT pattern, count(*) AS n FROM f WHERE length(pattern) BETWEEN 5 AND 12 GROUP BY 1")
def _(spark, d):
    index, words, _ = _pattern_tables(spark, d)
    return patterns.intervals(index, words).select("pattern", "n")
