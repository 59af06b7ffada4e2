"""From raw documents to token ids, in five stages.

Each stage takes (spark, docs, sf_dir), works on all rows that the one before kept, and
returns the columns of documents; the last returns the ids.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqloom.llm import bpe, minhash, mixing, quality, secrets
from seqloom.llm.common import cut
from seqloom.llm.queries import tokenizer

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _key() -> Column:
    """What tells rows of one id apart."""
    return F.xxhash64(F.coalesce("text", F.lit("")))


def _same(docs: DataFrame, other: DataFrame) -> Column:
    return docs["doc_id"].eqNullSafe(other["_id"]) & (docs["_key"] == other["_of"])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rule go, those of hosts that mostly fail, and those that
    fail a rule by which their host is worse than others.

    Null ids and hosts are judged as others are; a null text fails; equal rows stay or go together.
    """
    own = docs.select(*COLUMNS, _key().alias("_key"))
    kept = quality.judge(own, ["doc_id", "_key", "source"]).where("kept").select(F.col("doc_id").alias("_id"), F.col("_key").alias("_of"), F.col("source").alias("_source")).distinct()
    return own.join(kept, _same(own, kept) & own["source"].eqNullSafe(kept["_source"]), "left_semi").select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates stays: the one with the smallest id.

    Of several rows with that id, the first by text stays. Rows without an id come after
    those with one. Texts that share an id but not a group stay each; texts without words
    are in no group and all stay.
    """
    own = docs.select(*COLUMNS, _key().alias("_key"))
    got = minhash.labelled(own, "doc_id", "text").select(F.col("doc").alias("_id"), F.col("key").alias("_of"), F.col("comp").alias("_comp")).distinct()
    named = cut(own.join(got, _same(own, got)).select(*COLUMNS, "_comp"), "named")
    one = Window.partitionBy("_comp").orderBy(F.col("doc_id").asc_nulls_last(), "text", "lang", "source", "n_chars")
    out = named.where("_comp is not null").withColumn("_r", F.row_number().over(one)).where("_r = 1").select(COLUMNS)
    return out.unionByName(named.where("_comp is null").select(COLUMNS))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the texts; all documents stay, also those with a null text, which
    stays null. An empty table stays empty."""
    clean = secrets.redact(docs.select(COLUMNS), "doc_id")
    return clean.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast("long"))).select(COLUMNS)


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stands as often as the mix takes it; what it does not take goes.

    Rows of one id, text and source are sampled each; what they are taken together is dealt
    out to them evenly, in order of the other columns. A null text has no words and goes, as
    do texts without words; an empty table stays empty.
    """
    own = docs.select(*COLUMNS, _key().alias("_key"))
    mixed = mixing.take(mixing.sizes(own, ["doc_id", "_key", "source"]), "source", "doc_id")
    times = mixed.groupBy(F.col("doc_id").alias("_id"), F.col("_key").alias("_of"), F.col("source").alias("_source")).agg(F.sum(F.when(F.col("size") > 0, F.col("taken") / F.col("size"))).cast("int").alias("times"), F.count(F.lit(1)).cast("int").alias("_rows")).where("times > 0")
    one = Window.partitionBy("doc_id", "_key", "source").orderBy("lang", "n_chars")
    out = own.join(times, _same(own, times) & own["source"].eqNullSafe(times["_source"])).withColumn("_r", F.row_number().over(one))
    own_times = F.expr("times div _rows + if(_r <= times % _rows, 1, 0)").cast("int")
    return out.withColumn("_times", own_times).where("_times > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times")))).select(COLUMNS)


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang and source with the ids of the whole text; a null text counts as empty and has
    no ids. Rows are encoded each, also equal ones; an empty table stays empty."""
    out = bpe.encode_texts(docs, ["doc_id", "lang", "source"], tokenizer("word_bpe_49k.json"))
    return out.select("doc_id", "lang", "source", "n_tokens", "ids")


STAGES = [
    ("quality rules", quality_rules),
    ("MinHash near-dedup", near_duplicates),
    ("secret scans", secret_scan),
    ("mixing sources to target weights", mixing_sources),
    ("BPE encoding and decoding", bpe_encoding),
]

#: SQL can express neither the near-duplicate groups nor the sample, nor the encoding.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; each stage is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = cut(docs, f"stage{k}")
    return docs
