"""Cutting hot keys into chunks never changes positions or neighbours."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import Window, functions as F

from stagewatch.operators.lifecycle import assign_request_numbers
from stagewatch.operators.timeline import append_timeline, timeline_positions
from stagewatch.plans.sequence import Sequence, hot_keys, sequence


def skewed(spark, rows=6000):
    """One key with most rows, many of them at the same instants, next to small keys."""
    n = F.col("id")
    return spark.range(rows).select(
        F.when(n % 3 != 0, F.lit("hot")).when(n % 3 == 0, F.concat(F.lit("k"), (n % 97).cast("string"))).alias("request_id"),
        n.cast("string").alias("id"),
        F.timestamp_micros(F.lit(1_700_000_000_000_000) + ((n * 7919) % 1500) * 1_000_000).alias("at"),
        F.when(n % 5 != 0, n).alias("v"),
    )


def test_hot_keys_are_found(spark):
    assert set(hot_keys(skewed(spark), "request_id", min_rows=500, fraction=1.0)) == {"hot"}
    assert hot_keys(skewed(spark), "request_id") == {}


def test_hot_keys_by_sample(spark):
    found = hot_keys(skewed(spark, 60_000), "request_id", min_rows=5_000, fraction=0.05)
    assert set(found) == {"hot"} and 30_000 < found["hot"] < 50_000


@pytest.mark.parametrize("rows_per_chunk", [100, 1000])
def test_chunked_equals_windowed(spark, rows_per_chunk):
    df = skewed(spark)
    want = Sequence("pos", {"next_v": "v", "next_at": "at"}, {"prev_v": "v"})
    hot = hot_keys(df, "request_id", min_rows=500, fraction=1.0)
    got = sequence(df, "request_id", "at", "id", want, hot, rows_per_chunk)
    w = Window.partitionBy("request_id").orderBy("at", "id")
    plain = df.withColumns(
        {"pos": F.row_number().over(w).cast("bigint"), "next_v": F.lead("v").over(w),
         "next_at": F.lead("at").over(w), "prev_v": F.lag("v").over(w)}
    )
    assert got.columns == plain.columns
    assert got.exceptAll(plain).count() == 0 and plain.exceptAll(got).count() == 0


def test_one_instant_is_cut_too(spark):
    df = skewed(spark).withColumn("at", F.lit("2024-01-01").cast("timestamp"))
    hot = {"hot": 4000}
    got = sequence(df, "request_id", "at", "id", Sequence("pos", {"next_v": "v"}), hot, 200)
    w = Window.partitionBy("request_id").orderBy("at", "id")
    plain = df.withColumns({"pos": F.row_number().over(w).cast("bigint"), "next_v": F.lead("v").over(w)})
    assert got.exceptAll(plain).count() == 0 and plain.exceptAll(got).count() == 0
    assert "_chunk" in got._jdf.queryExecution().optimizedPlan().toString()


def test_numbers_of_a_hot_year(spark):
    new = spark.range(3000).select(
        F.col("id").cast("string").alias("id"),
        F.timestamp_micros(F.lit(1_704_100_000_000_000) + F.col("id") * 1_000_000).alias("created_at"),
    )
    taken = spark.createDataFrame([("SR-2024-00001",), ("SR-2024-00002",), ("SR-2023-00001",)], "request_number string")
    numbered = assign_request_numbers(new, taken, hot={2024: 3000}, rows_per_chunk=100)
    numbers = sorted(r[0] for r in numbered.select("request_number").collect())
    assert numbers == [f"SR-2024-{i:05d}" for i in range(3, 3003)]


def test_number_grows_beyond_five_digits(spark):
    new = spark.createDataFrame([("a", datetime(2024, 5, 1))], "id string, created_at timestamp")
    taken = spark.range(100_000).select(F.format_string("SR-2024-%06d", "id").alias("request_number"))
    assert assign_request_numbers(new, taken).first()["request_number"] == "SR-2024-100001"


def test_timeline_goes_on_from_stored_entries(spark):
    start = datetime(2024, 1, 1)
    rows = [(f"e{i}", "r1", start + timedelta(hours=i)) for i in range(5)]
    events = spark.createDataFrame(rows, "id string, request_id string, received_at timestamp")
    first = timeline_positions(events.where("id < 'e3'"))
    later = append_timeline(events, first)
    assert sorted((r.event_id, r.position) for r in later.collect()) == [("e3", 4), ("e4", 5)]
    assert [r.position for r in first.orderBy("position").collect()] == [1, 2, 3]
