"""Forces of both kinds are computed once, though they are read for their mean and for each body."""

from seqloom import catalog


def test_forces_are_written_before_they_are_read_twice(spark, sf):
    df = catalog.queries()["approximate_forces"](spark, sf)
    assert "CoGroups" not in df._jdf.queryExecution().toString()
    assert df.where("not close").count() == 0 and df.count() > 100
