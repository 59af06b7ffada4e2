"""Trees of many nodes."""

from pyspark.sql import functions as F

from seqloom.operators import learning


def _walk(nodes, row):
    at = nodes[0]
    while "children" in at:
        x = row[at["feature"]]
        key = x if at["cut"] is None else None if x is None else int(x >= at["cut"])
        if key not in at["children"]:
            break
        at = nodes[at["children"][key]]
    return at["label"]


def test_classify_by_many_nodes(spark):
    """Every node doubled the expression: 60 of them were more than any driver holds."""
    nodes = [{"id": 0, "depth": 0, "label": 0, "feature": "a", "cut": None, "children": {v: v + 1 for v in range(60)}}]
    nodes += [{"id": v + 1, "depth": 1, "label": v, "feature": "b", "cut": v % 7, "children": {0: 61 + 2 * v, 1: 62 + 2 * v}} for v in range(60)]
    nodes += [{"id": 61 + i, "depth": 2, "label": 100 + i} for i in range(120)]
    rows = spark.range(500).select("id", F.when(F.col("id") % 50 != 0, F.col("id") % 64).alias("a"), F.when(F.col("id") % 31 != 0, F.col("id") % 9).alias("b"))
    got = learning.classify(rows, nodes).collect()
    assert len(got) == 500 and all(r["predicted"] == _walk(nodes, r) for r in got)


def test_tree_is_what_it_classifies(spark):
    rows = spark.range(3_000).select(F.pmod(F.xxhash64("id"), F.lit(40)).cast("int").alias("a"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(200)).cast("int").alias("b")).withColumn("y", F.pmod(F.col("a") * 7 + F.floor(F.col("b") / 50), F.lit(8)).cast("int"))
    nodes = learning.decision_tree(rows, {"a": "d", "b": "i"}, "y", max_depth=4)
    assert len(nodes) > 40
    assert all(r["predicted"] == _walk(nodes, r) for r in learning.classify(rows, nodes).collect())


def test_classify_features_that_cannot_be_null(spark):
    """Leaves beside a node that splits again have no feature to look at; as arrays of no nulls were read there, place -1 was asked for."""
    nodes = [{"id": 0, "depth": 0, "label": 0, "feature": "a", "cut": 4, "children": {0: 1, 1: 2}}, {"id": 1, "depth": 1, "label": 5}, {"id": 2, "depth": 1, "label": 6, "feature": "b", "cut": None, "children": {0: 3, 1: 4}}]
    nodes += [{"id": i, "depth": 2, "label": 7 + i} for i in (3, 4)]
    rows = spark.range(60).select("id", F.least(F.col("id") % 8, F.lit(255)).alias("a"), F.least(F.col("id") % 3, F.lit(255)).alias("b"))
    assert not rows.schema["a"].nullable
    got = learning.classify(rows, nodes).collect()
    assert len(got) == 60 and all(r["predicted"] == _walk(nodes, r) for r in got)
