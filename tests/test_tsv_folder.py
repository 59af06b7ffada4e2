"""Tab-separated rows in several files."""

from seqloom.sources import files


def test_only_the_first_line_of_a_folder_is_its_header(spark, tmp_path):
    """Of every further file the first row was taken for a header."""
    folder = tmp_path / "t"
    folder.mkdir()
    (folder / "part-0.tsv").write_text("# note\n\nid\tname\tval\n1\ta\t1.5\n# more\n2\t\t\n")
    (folder / "part-1.tsv").write_text("3\tc\t2.5\n\n4\t\"x\"\t3.5\n")
    (folder / "part-2.tsv").write_text("")
    (folder / "part-3.tsv").write_text("# 5\n5\te\t4.5")
    got = files.read_commented_tsv(spark, str(folder), "id long, name string, val double")
    assert got.dtypes == [("id", "bigint"), ("name", "string"), ("val", "double")]
    assert sorted(map(tuple, got.collect())) == [(1, "a", 1.5), (2, None, None), (3, "c", 2.5), (4, "x", 3.5), (5, "e", 4.5)]


def test_rows_of_large_files_are_read_in_splits(spark, tmp_path):
    (tmp_path / "big.tsv").write_text("id\tname\n" + "".join(f"{i}\tname {i}\n" for i in range(5_000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        got = files.read_commented_tsv(spark, str(tmp_path / "big.tsv"), "id long, name string").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert sorted(r["id"] for r in got) == list(range(5_000)) and all(r["name"] == f"name {r['id']}" for r in got)
