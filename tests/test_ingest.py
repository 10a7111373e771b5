"""Normalization, validation, signatures and outcomes on literal payloads."""

import hashlib
import hmac
import json
from datetime import datetime

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from stagewatch import schema as S
from stagewatch.functions.signing import hmac_sha256, key_blocks
from stagewatch.functions.times import to_utc
from stagewatch.operators import ingest

RID = "123e4567-e89b-12d3-a456-426614174000"
GOOD = {"id": "evt-001", "requestId": RID, "eventType": "stage_change", "sourceSystem": "Manual", "occurredAt": "2024-01-15T10:00:00.000Z"}
MAP = {"id": "$.crm_id", "requestId": "$.opportunity.id", "eventType": "$.Kind", "occurredAt": "$.created_date", "newState": "stage"}


def configs(spark):
    rows = [("CRM", "crm-secret", MAP, 15, None, True), ("ERP", "x" * 100, None, 15, None, True), ("Quotation System", None, None, 15, None, True)]
    return spark.createDataFrame(rows, S.TABLES["integration_configs"])


def raw(spark, *payloads, signatures=None, headers=None):
    at = datetime(2024, 2, 1)
    rows = [
        (f"d{i:03d}", p if isinstance(p, str) else json.dumps(p), (headers or {}).get(i), (signatures or {}).get(i), at)
        for i, p in enumerate(payloads)
    ]
    return spark.createDataFrame(rows, S.TABLES["raw_events"])


def none(spark):
    return spark.createDataFrame([], "id string")


def outcome(spark, *payloads, existing=(), **extra):
    stored = spark.createDataFrame([(i,) for i in existing], "id string")
    df = ingest.ingest(raw(spark, *payloads, **extra), configs(spark), stored)
    return df.orderBy("delivery_id").collect()


def without(name):
    return {k: v for k, v in GOOD.items() if k != name}


def test_minimal_event_is_accepted(spark):
    row = outcome(spark, GOOD)[0]
    assert (row.status, row.http_code, row.pipeline_status) == ("accepted", 202, "pending")
    assert row.occurred_at == datetime(2024, 1, 15, 10)
    assert row.department is None and row.metadata is None and row.failed_steps == []


@pytest.mark.parametrize(
    "payload",
    [
        GOOD | {"id": ""}, GOOD | {"requestId": ""}, GOOD | {"requestId": "not-a-uuid"}, GOOD | {"eventType": ""},
        without("occurredAt"), GOOD | {"occurredAt": "not a date"}, GOOD | {"sourceSystem": "InvalidSource"}, "[1, 2]", "nope", "null",
    ],
)
def test_invalid_payloads(spark, payload):
    row = outcome(spark, payload)[0]
    assert (row.status, row.http_code) == ("invalid", 422) and row.reasons


def test_missing_time_can_default(spark):
    df = ingest.ingest(raw(spark, without("occurredAt")), configs(spark), none(spark), default_missing_ts=datetime(2024, 3, 1))
    row = df.first()
    assert row.status == "accepted" and row.occurred_at == datetime(2024, 3, 1)


@pytest.mark.parametrize(
    ("value", "expected"),
    [
        ("2024-03-10T12:30:00+03:00", datetime(2024, 3, 10, 9, 30)),
        (1705312800000, datetime(2024, 1, 15, 10)),
        ("1705312800", datetime(2024, 1, 15, 10)),
        ("2024-01-15", datetime(2024, 1, 15)),
        ("2024-01-15T10:00:00.123456Z", datetime(2024, 1, 15, 10, 0, 0, 123000)),
        (True, None), (None, None), ({"a": 1}, None), ("soon", None),
        (1e300, None), (-1e17, None), ("1e300", None), ("NaN", None), ("Infinity", None), (1705312800000.7, datetime(2024, 1, 15, 10)),
    ],
)
def test_times(spark, value, expected):
    for name in ("occurredAt", "occurred_at"):
        payload = without("occurredAt") | {name: value}
        df = ingest.normalize(ingest.resolve_source(ingest.parse(raw(spark, payload), configs(spark))), configs(spark))
        assert df.first().occurred_at == expected


def test_aliases_only_fill_absent_fields(spark):
    snake = {"event_id": "e", "request_id": RID, "event_type": "t", "source_system": "ERP", "occurred_at": "2024-01-15T10:00:00Z", "triggered_by": "u9", "new_state": "Dispatch"}
    both = GOOD | {"event_type": "other", "previousState": None, "previous_state": "Inquiry", "triggered_by_user_id": "u1", "triggered_by": "u2"}
    first, second = outcome(spark, snake, both)
    assert (first.id, first.event_type, first.source_system, first.triggered_by_user, first.new_state) == ("e", "t", "ERP", "u9", "Dispatch")
    # A canonical field that is there, even as null, hides its other spelling.
    assert (second.event_type, second.previous_state, second.triggered_by_user) == ("stage_change", None, "u1")


def test_mapping_reads_only_mapped_paths(spark):
    payload = {"sourceSystem": "CRM", "crm_id": 77, "opportunity": {"id": RID}, "Kind": "call", "kind": "x", "created_date": "2024-01-15T10:00:00Z", "department": "Sales"}
    row = outcome(spark, payload)[0]
    assert (row.status, row.id, row.request_id, row.event_type) == ("accepted", "77", RID, "call")
    assert row.department is None and row.new_state is None


def test_unknown_fields_are_stripped_and_metadata_kept(spark):
    payload = GOOD | {"department": "Logistics", "metadata": {"trackingNumber": "TRK-001"}, "crm_account_id": 1, "legacy_field": "x"}
    df = ingest.ingest(raw(spark, payload), configs(spark), none(spark))
    row = ingest.accepted_events(df).first()
    assert set(row.asDict()) == set(ingest.EVENT_COLUMNS)
    assert json.loads(row.metadata) == {"trackingNumber": "TRK-001"} and row.department == "Logistics"


def test_duplicates(spark):
    rows = outcome(spark, GOOD, GOOD, GOOD | {"id": "old"}, GOOD | {"id": ""}, existing=["old"])
    assert [r.status for r in rows] == ["accepted", "duplicate", "duplicate", "invalid"]
    assert [r.http_code for r in rows] == [202, 409, 409, 422]


def test_source_resolution(spark):
    payloads = [without("sourceSystem"), without("sourceSystem"), without("sourceSystem") | {"source_system": "ERP"}, GOOD]
    df = ingest.resolve_source(ingest.parse(raw(spark, *payloads, headers={1: "CRM", 2: "CRM", 3: "CRM"})))
    assert [r.source for r in df.orderBy("delivery_id").collect()] == ["Manual", "CRM", "ERP", "Manual"]


def sign(body, secret):
    return "sha256=" + hmac.new(secret.encode(), body.encode(), hashlib.sha256).hexdigest()


def test_signatures(spark):
    body = json.dumps(GOOD | {"sourceSystem": "ERP"})
    unset = json.dumps(GOOD | {"sourceSystem": "Quotation System"})
    right = sign(body, "x" * 100)
    signatures = {0: right, 1: sign(body + " ", "x" * 100), 2: sign(body, "other"), 3: right[7:], 4: sign(unset, "x" * 100), 5: right.upper()}
    rows = outcome(spark, body, body, body, body, unset, body, signatures=signatures)
    assert [r.signature_ok for r in rows] == [True, False, False, False, False, False]
    assert rows[0].status == "accepted" and {r.http_code for r in rows[1:]} == {401}


@settings(max_examples=5, deadline=None)
@given(st.text(min_size=1, max_size=120), st.lists(st.text(max_size=80), min_size=1, max_size=30))
def test_hmac_equals_standard_library(spark, secret, bodies):
    bodies = [b.encode("utf-8", "ignore").decode() for b in bodies]
    secret = secret.encode("utf-8", "ignore").decode()
    inner, outer = (F.lit(bytearray(b)) for b in key_blocks(secret))
    df = spark.createDataFrame([(b,) for b in bodies], "b string").select("b", hmac_sha256(F.col("b"), inner, outer).alias("h"))
    assert all(r.h == sign(r.b, secret)[7:] for r in df.collect())


def test_payload_size(spark):
    df = spark.createDataFrame([("é" * 524_288,), ("é" * 524_288 + "x",), (None,)], "raw string")
    assert [r.too_large for r in ingest.guard_payload_size(df).collect()] == [False, True, False]


def test_too_large_payload_is_refused_unparsed(spark):
    row = outcome(spark, GOOD | {"metadata": {"x": "y" * 1_100_000}})[0]
    assert (row.status, row.http_code, row.is_json) == ("invalid", 413, False)


def test_pipeline_status(spark):
    rows = [("a", s, True) for s in S.PIPELINE_STEPS] + [("b", s, s != "analytics-update") for s in S.PIPELINE_STEPS] + [("c", "timeline-update", True)]
    got = {r.id: (r.pipeline_status, r.failed_steps) for r in ingest.pipeline_status(spark.createDataFrame(rows, "id string, step string, ok boolean")).collect()}
    assert got == {"a": ("complete", []), "b": ("partial", ["analytics-update"]), "c": ("pending", [])}


def test_append_is_idempotent(spark):
    df = ingest.ingest(raw(spark, GOOD, GOOD | {"id": "b"}), configs(spark), none(spark))
    events = ingest.accepted_events(df)
    assert ingest.append_events(events.unionByName(events), none(spark)).count() == 2
    assert ingest.append_events(events, events).count() == 0


def test_archived_events_stay_readable(spark):
    rows = [("a", datetime(2024, 1, 1)), ("b", datetime(2024, 1, 2)), ("c", datetime(2024, 1, 3))]
    events = spark.createDataFrame(rows, "id string, occurred_at timestamp")
    old = ingest.archive_older_than(events, datetime(2024, 1, 2))
    assert [r.id for r in old.collect()] == ["a"]
    assert ingest.with_archive(events, old).count() == 3


def test_settings_of_other_sources_do_not_crowd_out(spark):
    rows = [(f"Retired {k}", "x") for k in range(50)] + [("CRM", "secret")]
    configs = spark.createDataFrame(rows, "source_system string, webhook_secret string")
    assert [r.webhook_secret for r in ingest.settings(configs)] == ["secret"]
    with pytest.raises(ValueError):
        ingest.settings(configs.union(configs))


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("2024/01/10 08:00:00", datetime(2024, 1, 10, 8)),
        ("2024/1/10", datetime(2024, 1, 10)),
        ("1/10/2024 8:30", datetime(2024, 1, 10, 8, 30)),
        ("Wed, 10 Jan 2024 08:00:00 GMT", datetime(2024, 1, 10, 8)),
        ("Wed Jan 10 2024 08:00:00 GMT+0300 (Moscow Standard Time)", datetime(2024, 1, 10, 5)),
        ("Jan 10, 2024", datetime(2024, 1, 10)),
        ("10 January 2024 23:59", datetime(2024, 1, 10, 23, 59)),
        ("2024-01-10T08:00:00+03:00", datetime(2024, 1, 10, 5)),
        ("1704873600", datetime(2024, 1, 10, 8)),
        ("13/45/2024", None), ("yesterday 2024", None), ("Foo 10 2024", None), ("", None), ("10", datetime(1970, 1, 1, 0, 0, 10)),
    ],
)
def test_written_dates(spark, text, expected):
    row = spark.createDataFrame([(text,)], "t string").select(to_utc(F.col("t")).cast("timestamp_ntz").alias("v")).first()
    assert row.v == expected
