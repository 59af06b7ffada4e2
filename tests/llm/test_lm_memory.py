"""A worker of the language model is given little at once."""

import pyarrow as pa

from seqloom.llm import lm


def test_buckets_go_to_workers_one_by_one(spark, tmp_path):
    spark.range(50).selectExpr("id", "cast(repeat('x', 1000) as binary) as u").coalesce(1).write.parquet(str(tmp_path / "packed"))
    packed = spark.read.parquet(str(tmp_path / "packed"))

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["n"])

    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.parquet.columnarReaderBatchSize", "spark.sql.execution.arrow.maxRecordsPerBatch")
    before = [spark.conf.get(n) for n in names]
    with lm._small_splits(spark):
        got = [r["n"] for r in packed.mapInArrow(sizes, "n long").collect()]
    assert got == [1] * 50
    with lm._few_texts(spark):
        most = max(r["n"] for r in spark.range(0, 5_000, 1, 1).mapInArrow(sizes, "n long").collect())
    assert most <= lm.TEXTS
    assert [spark.conf.get(n) for n in names] == before


def test_scores_do_not_follow_from_the_block(spark, monkeypatch):
    docs = spark.createDataFrame([(i, " ".join(f"W{(i * j) % 23}" for j in range(1 + i % 40))) for i in range(120)] + [(500, None), (501, "")], "doc_id long, text string")
    rows = lambda: {r["doc_id"]: r for r in lm.score(docs).collect()}
    want = rows()
    monkeypatch.setattr(lm, "BLOCK", 64)
    monkeypatch.setattr(lm, "TEXTS", 3)
    got = rows()
    assert got.keys() == want.keys()
    for k, r in want.items():
        assert (got[k]["n_tokens"], got[k]["n_known"], got[k]["train_tokens"]) == (r["n_tokens"], r["n_known"], r["train_tokens"])
        assert abs(got[k]["base_score"] - r["base_score"]) < 1e-9 and abs(got[k]["score"] - r["score"]) < 1e-9
