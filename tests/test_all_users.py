import pytest
from pyspark.sql import functions as F

from sparkseries.queries import QUERIES

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", ["ts_ema", "ts_rsi", "ts_macd"])
def test_every_event_has_a_row(spark, name):
    events = spark.read.parquet(f"{SF}/events.parquet")
    assert events.filter("user_id > 40").count() > 0
    got = sorted(x.event_id for x in QUERIES[name](spark, SF).select("event_id").collect())
    assert got == sorted(x.event_id for x in events.select("event_id").collect())


def test_dense_buckets_of_every_user(spark):
    events = spark.read.parquet(f"{SF}/events.parquet")
    assert events.filter("user_id > 5").count() > 0
    got = QUERIES["ts_resample_dense"](spark, SF).groupBy("user_id").agg(F.sum("value").alias("n"))
    assert {x.user_id: x.n for x in got.collect()} == {x.user_id: x["count"] for x in events.groupBy("user_id").count().collect()}
