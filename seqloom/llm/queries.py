"""The registered queries of this folder: thin, whole tables, production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bpe, language_id, lm, minhash, mixing, point_in_time, quality, resampling, secrets, sharding, token_counts, url_filter

#: The rules that op2 judges by.
RULES = [
    url_filter.Rule("allow", "com", "/"),
    url_filter.Rule("block", "example.com", "/en/"),
    url_filter.Rule("allow", "www.example.com", "/en/"),
    url_filter.Rule("block", "net", "/es/"),
    url_filter.Rule("block", "net", "/fr/"),
]


def tokenizer(name: str) -> str:
    """Where a public tokenizer's file is."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every whole text; null texts and texts without letters are ``und``. Nulls, repeated rows and long texts as in ``language_id.predict``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", language_id.held_out())
    train = language_id.sample(docs.where(~F.col("held_out") & F.col("lang").isNotNull()), "doc_id", "lang")
    return language_id.predict(docs.drop("lang"), ["doc_id", "held_out"], language_id.fit(train))


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last number of a page's path names the document that was made of it; its label is the page's."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    number = F.regexp_extract(F.regexp_extract("url", r"^[^?#]*", 0), r"(\d+)[^\d/]*/?$", 1)
    of = pages.select("url", number.try_cast("bigint").alias("doc_id"))
    labels = of.join(table(spark, sf_dir, "labels"), "doc_id").select("url", ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    return url_filter.judge(pages, labels, RULES, ["page_id"])


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The library's tokens of every whole text; a null text is an empty one, and repeated rows are counted each."""
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), ["doc_id"], tokenizer("byte_bpe_50k.json"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The secrets of every whole text; a null text has none, and rows that share an id are scanned each."""
    found = secrets.scan(table(spark, sf_dir, "documents"), "doc_id")
    strong = secrets.strong_only(F.col("spans"))
    count = lambda k: F.size(F.filter(strong, lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *map(count, secrets.STRONG), F.sha2(secrets.joined(strong), 256).alias("base_sha256"), secrets.joined(F.col("spans")).alias("spans"))


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The component of every document by whole texts; null ids, shared ids and texts without words as in ``minhash.near_duplicates``."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), k=4, percent=80)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document; null sources come last, null texts have no words, repeated rows are sampled each."""
    docs = table(spark, sf_dir, "documents")
    return mixing.take(mixing.sizes(docs, ["doc_id", "source"]), "source", "doc_id").drop("source")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ids of every whole text and what they decode to, as digests; a null text is an empty one."""
    return bpe.encode_texts(table(spark, sf_dir, "documents"), ["doc_id"], tokenizer("word_bpe_49k.json"), ids=False)


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every twentieth vector; null, zero and non-finite vectors and repeated ids as in ``ann.nearest``."""
    vectors = table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.where("vec_id % 20 = 0"), k=20)


def op9_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The model's and the base score of every whole text; null and empty texts are one end."""
    return lm.score(table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The measures and verdict of every document; null texts have no words and fail, null hosts are one host."""
    return quality.judge(table(spark, sf_dir, "documents"), ["doc_id"]).drop("host_rate")


def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards under the law of rows; equal texts, null ids and all else as in ``sharding.shard``."""
    return sharding.shard(table(spark, sf_dir, "documents"), k=16, law="rows")


def op12_point_in_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The version that each label sees at its moment; nulls, ties and empty tables as in ``point_in_time.features_at``."""
    return point_in_time.features_at(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the documents drawn towards the benchmark's words; nulls and ties as in ``resampling.resample``."""
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_language_id, op2_url_filters, op3_token_counts, op4_secret_scan, op5_near_duplicates, op6_mixing, op7_bpe, op8_nearest, op9_lm_scores, op10_quality_rules, op11_sharding, op12_point_in_time, op13_resampling]
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    """Of those that SQL can express; models, spans, tokenizers and sampling are beyond it,
    and tests/llm holds these against brute force instead."""
    return {"op10_quality_rules": quality.sql(), "op12_point_in_time": point_in_time.sql(), "op13_resampling": resampling.sql()}
