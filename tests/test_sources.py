"""Declared schemas, the event store and the derived tables."""

from pyspark.sql import functions as F

from stagewatch import schema as S
from stagewatch.operators import ingest
from stagewatch.sources import bulk, tables


def test_events_are_stored_by_day_and_pruned(spark, small, tmp_path):
    events = bulk.ops_events(spark, small).select(*ingest.EVENT_COLUMNS)
    path = str(tmp_path / "events")
    tables.write_events(events, path)
    stored = tables.read_table(spark, "events", path)
    assert stored.select(*ingest.EVENT_COLUMNS).schema == S.TABLES["events"] or stored.columns[:13] == ingest.EVENT_COLUMNS
    assert stored.select(*ingest.EVENT_COLUMNS).exceptAll(events).count() == 0
    day = stored.where("event_date = date'2024-01-05'")
    assert "PartitionFilters: [isnotnull(event_date" in day._jdf.queryExecution().executedPlan().toString()
    assert day.count() == events.where("to_date(occurred_at) = date'2024-01-05'").count()


def test_stage_counts_of_the_projection(spark):
    """Sizes of the derived requests at the middle scale, counted independently beforehand."""
    evaluated = bulk.dwell(spark, "/root/testdata/sf0.01").groupBy("journey_stage").count()
    counts = {r["journey_stage"]: r["count"] for r in evaluated.collect()}
    assert [counts[s] for s in S.ACTIVE_STAGES] == [1500, 1483, 1437, 1347, 1174, 985, 749]


def test_requests_have_one_row_per_request(spark, small):
    requests = bulk.requests(spark, small)
    events = bulk.plain_events(spark, small)
    assert requests.count() == requests.select("id").distinct().count() == events.select("request_id").distinct().count()
    named = bulk.with_customer(requests, spark, small)
    assert named.where(F.col("customer_name").isNull()).count() == 0
