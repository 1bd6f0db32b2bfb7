from datetime import datetime

from pyspark.sql import functions as F

from quirespark.tables import latest, source_key


def test_latest(spark):
    d = datetime
    df = spark.createDataFrame([(1, "a", None, d(2024, 1, 1)), (1, "b", 2, d(2024, 1, 2)), (1, "b", 2, d(2024, 1, 2)), (2, None, None, None), (None, "x", 1, None)], "k int, v string, w int, ingested_at timestamp")
    assert {(r.k, r.v, r.w) for r in latest(df, ["k"]).collect()} == {(1, "b", 2), (2, None, None), (None, "x", 1)}
    assert latest(df.where("false"), ["k"]).count() == 0


def test_source_key(spark):
    df = spark.createDataFrame([(" A.b ",), ("a.B　",), ("  ",), ("",), (None,)], "s string")
    assert [r.k for r in df.select(source_key(F.col("s")).alias("k")).collect()] == ["a.b", "a.b", None, None, None]
