"""Listings, scopes, permissions, messages and display text."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from stagewatch import schema as S
from stagewatch.functions import ladders, text
from stagewatch.functions.numbers import fixed_text, half_up, pad_number, plain_text
from stagewatch.operators import broadcast, listing

START = datetime(2024, 1, 1)


def values(spark, column, rows, kind):
    df = spark.createDataFrame([(r,) for r in rows], f"v {kind}")
    return [r[0] for r in df.select(column(F.col("v"))).collect()]


def test_page_clamp():
    assert listing.clamp_page(0, 500) == (1, 100, 0) and listing.clamp_page(3, 0) == (3, 1, 2)
    assert [listing.page_count(t, 20) for t in (0, 20, 21)] == [1, 1, 2]


@pytest.mark.parametrize("newest_first", [True, False])
def test_deep_pages_equal_plain_ones(spark, monkeypatch, newest_first):
    df = spark.range(5000).select(
        F.col("id").cast("string").alias("id"), F.timestamp_micros((F.col("id") * 37 % 900) * 1_000_000).alias("at")
    )
    df = df.withColumn("at", F.when(F.crc32("id") % 4 > 0, F.col("at")))  # a quarter has no time
    order = [F.desc("at") if newest_first else F.asc("at"), F.asc("id")]
    plain = [r.id for r in df.orderBy(*order).collect()]
    monkeypatch.setattr(listing, "DEEP_OFFSET", 10)
    for page in (2, 40, 50, 51):
        got = [r.id for r in listing.paginate(df, order, page, 100, "at", newest_first).collect()]
        assert got == plain[(page - 1) * 100 : page * 100]


def test_scopes(spark):
    df = spark.createDataFrame([("1", "Sales"), ("2", "Ops"), ("3", None)], "id string, assigned_department string")
    seen = {role: listing.scope_requests(df, role, "Sales").count() for role in S.ROLES}
    assert seen == {"Administrator": 3, "Regional Manager": 3, "Sales Engineer": 1, "Backend Designer": 1, "Logistics Officer": 1}
    assert listing.scope_requests(df, "Sales Engineer").count() == 0


GRANTED = {
    "Administrator": 12, "Regional Manager": 7, "Sales Engineer": 4, "Backend Designer": 3, "Logistics Officer": 3,
}


def test_permission_matrix(spark):
    counts = {r["role"]: r["count"] for r in listing.permission_matrix(spark).groupBy("role").count().collect()}
    assert counts == GRANTED
    users = spark.createDataFrame([(r, r) for r in S.ROLES], "id string, role string")
    assert {r.id for r in listing.require(users, "manage:sla_rules").collect()} == {"Administrator"}
    assert {r.id for r in listing.require(users, "create:service_request").collect()} == {"Administrator", "Sales Engineer"}
    assert listing.user_permissions(users).count() == sum(GRANTED.values())


def test_bad_bounds_are_ignored(spark):
    df = spark.createDataFrame([("1", START), ("2", START + timedelta(days=2))], "id string, occurred_at timestamp")
    assert listing.filter_events(df, start="yesterday", end="").count() == 2
    assert listing.filter_events(df, start="2024-01-02T00:00:00Z").count() == 1
    assert listing.filter_events(df, end=START).count() == 1


def test_lookup_by_id_or_number(spark):
    df = spark.createDataFrame([("a", "SR-1", "Ops"), ("b", "SR-2", "Ops")], "id string, request_number string, assigned_department string")
    assert listing.get_request(df, "a").first().id == "a" == listing.get_request(df, "SR-1").first().id
    assert listing.get_request(df, "SR-1", "Sales Engineer", "Sales").count() == 0


def test_stage_progress(spark):
    df = spark.createDataFrame([("a", "Quotation"), ("b", "Cancelled"), ("c", "Completed")], "id string, current_stage string")
    rows = listing.stage_progress(df).orderBy("id", "place").collect()
    states = {i: [r.state for r in rows if r.id == i] for i in "abc"}
    assert states["a"] == ["done"] * 3 + ["active"] + ["pending"] * 4
    assert states["b"] == ["pending"] * 8 and states["c"] == ["done"] * 7 + ["active"]


def test_durations(spark):
    got = values(spark, text.fmt_hours, [None, 0.5, 0.999, 1.0, 23.94, 24.0, 60.0, float("nan")], "double")
    assert got == ["—", "30m", "60m", "1.0h", "23.9h", "1.0d", "2.5d", "—"]


def test_text(spark):
    assert values(spark, lambda c: text.truncate(c, 5), ["abcdef", "abcde", "", None], "string") == ["abcde…", "abcde", "—", "—"]
    assert values(spark, text.initials, ["Alex Admin", "maya", "a b c"], "string") == ["AA", "M", "AB"]
    assert values(spark, text.fmt_date, [datetime(2024, 9, 5, 3, 4), None], "timestamp") == ["05 Sept 2024, 03:04", "—"]
    assert values(spark, text.percent, [0.8374, 1.0], "double") == ["83.7%", "100.0%"]
    assert values(spark, text.words, ["stage_change"], "string") == ["stage change"]
    assert values(spark, ladders.compliance_band, [0.85, 0.65, 0.64], "double") == ["good", "ok", "bad"]


def test_numbers(spark):
    assert values(spark, lambda c: fixed_text(c, 2), [1.006, 0.0, 12.3, -0.5], "double") == ["1.01", "0.00", "12.30", "-0.50"]
    assert values(spark, lambda c: half_up(c, 3), [0.0125, 2.0], "double") == [0.013, 2.0]
    assert values(spark, plain_text, [24.0, 0.5, 100.0, 8.25], "double") == ["24", "0.5", "100", "8.25"]
    assert values(spark, lambda c: pad_number(c, 5), [7, 123456], "bigint") == ["00007", "123456"]


def test_messages_fan_out_and_replay(spark):
    rows = [("request:1", "e", "{}", START + timedelta(hours=h), f"m{h}") for h in (1, 20, 30, 40)] + [("alert:Critical", "a", "{}", START + timedelta(hours=35), "x")]
    payloads = spark.createDataFrame(rows, "channel string, event string, data string, sent_at timestamp, source_id string")
    clients = spark.createDataFrame(
        [("c1", ["request:1", "alert:Critical", "request:1"], None), ("c2", ["request:1"], START + timedelta(hours=30)), ("c3", ["request:2"], None)],
        "connection_id string, subscribed_channels array<string>, last_received_at timestamp",
    )
    sent = broadcast.fan_out(payloads, clients)
    assert sorted((r.connection_id, r.source_id) for r in sent.collect()) == [
        ("c1", "m1"), ("c1", "m20"), ("c1", "m30"), ("c1", "m40"), ("c1", "x"), ("c2", "m1"), ("c2", "m20"), ("c2", "m30"), ("c2", "m40")]
    counts = {r.connection_id: r.messages for r in broadcast.delivery_counts(payloads, clients).collect()}
    assert counts == {"c1": 5, "c2": 4}
    delivered = spark.createDataFrame([("c1", "m30")], "connection_id string, source_id string")
    missed = broadcast.replay(payloads, delivered, clients, START + timedelta(hours=41))
    assert sorted((r.connection_id, r.source_id) for r in missed.collect()) == [("c1", "m20"), ("c1", "m40"), ("c1", "x"), ("c2", "m40")]


def many_channels(spark):
    """Messages, and a few bytes of clients that subscribe to many channels."""
    n = F.col("id")
    payloads = spark.range(3000).select(
        F.concat(F.lit("request:"), (n % 1500).cast("string")).alias("channel"), F.lit("e").alias("event"), F.lit("{}").alias("data"),
        F.timestamp_micros(n * 1_000_000).alias("sent_at"), n.cast("string").alias("source_id"),
    )
    clients = spark.range(20).select(
        F.concat(F.lit("c"), n.cast("string")).alias("connection_id"),
        F.transform(F.sequence(F.lit(0), F.lit(99)), lambda i: F.concat(F.lit("request:"), (n * 100 + i).cast("string"))).alias("subscribed_channels"),
        F.lit(None).cast("timestamp").alias("last_received_at"),
    )
    return payloads, clients


def test_delivery_counts_broadcast_no_subscriptions(spark):
    counts = broadcast.delivery_counts(*many_channels(spark))
    assert "BroadcastHashJoin" not in counts._jdf.queryExecution().executedPlan().toString()
    assert {r.connection_id: r.messages for r in counts.collect()} == {f"c{k}": 200 for k in range(15)}


def test_fan_out_broadcasts_no_subscriptions(spark):
    payloads, clients = many_channels(spark)
    sent = broadcast.fan_out(payloads, clients)
    assert "BroadcastHashJoin" not in sent._jdf.queryExecution().executedPlan().toString()
    queue = broadcast.delivery_queue(payloads, clients, hot={})
    assert "BroadcastHashJoin" not in queue._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.connection_id, r.delivery_no) for r in queue.collect()) == sorted((f"c{k}", n) for k in range(15) for n in range(1, 201))


def test_created_alerts_and_payloads(spark):
    made = broadcast.create_alerts(
        spark.createDataFrame([("a", "r", S.ESCALATION, "Warning", "m", None)], "id string, request_id string, alert_type string, severity string, message string, metadata string"), START
    )
    row = made.first()
    assert (row.lifecycle_state, row.created_at, row.acknowledged_by) == ("Created", START, None)
    events = spark.createDataFrame([("e", "r", START)], "id string, request_id string, received_at timestamp")
    got = {r.channel: r.event for r in broadcast.broadcast_payloads(made, events).collect()}
    assert got == {"alert:Warning": "alert_created", "request:r": "event_received"}


@pytest.mark.parametrize("newest_first", [True, False])
def test_pages_by_key(spark, newest_first):
    """Put end to end they are the whole order, ties and missing times included."""
    rows = [(f"i{k:02d}", None if k % 9 == 4 else datetime(2024, 1, 1 + k % 5)) for k in range(40)]
    df = spark.createDataFrame(rows, "id string, occurred_at timestamp")
    order = F.desc("occurred_at") if newest_first else F.asc("occurred_at")
    want = [tuple(r) for r in df.orderBy(order, "id").select("occurred_at", "id").collect()]
    got, last = [], None
    while page := [(r.occurred_at, r.id) for r in listing.page_after(df, 7, last, newest_first=newest_first).collect()]:
        got, last = got + page, page[-1]
    assert got == want


def test_search_by_postings_equals_the_scan(spark):
    names = ["Müller & Söhne", "ACME", "acme corp", "a%b_c", None, "", "ab", "İstanbul", "aaaaaa", "Customer#000000123"]
    requests = spark.createDataFrame([(f"r{k}", f"SR-2024-{k:05d}", n) for k, n in enumerate(names)], "id string, request_number string, customer_name string")
    index = listing.search_index(requests)
    for text in ("acme", "ACM", "ac", "", "a%b", "%", "aaa", "aaaaaaa", "SR-2024", "0000", "#00000012", "söh", "İst", "nothing", "me co"):
        scan = {r.id for r in listing.search_requests(requests, text).collect()}
        assert {r.id for r in listing.search_by_index(requests, index, text).collect()} == scan, text
