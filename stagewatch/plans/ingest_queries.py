"""Queries over raw payloads, the event store and outgoing messages."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from stagewatch import schema as S
from stagewatch.functions.signing import PREFIX, hmac_sha256, key_blocks
from stagewatch.functions.times import instant
from stagewatch.operators import broadcast, ingest, timeline
from stagewatch.plans.catalog import query
from stagewatch.sources import bulk

STORED_BEFORE = datetime(2024, 1, 10)
REPLAY_AT = datetime(2024, 1, 30, 12)
SIZE_LIMIT = 16_384


def _raw(spark, d):
    return bulk.raw_events(spark, d)


def _sourced(spark, d):
    return ingest.resolve_source(ingest.parse(_raw(spark, d), bulk.configs(spark)))


def _canonical(spark, d):
    return ingest.normalize(_sourced(spark, d).drop("id", "occurred_at"), bulk.configs(spark))


def _stored(spark, d):
    """What the store held when the raw payloads came in again."""
    return bulk.plain_events(spark, d).where(F.col("received_at") < instant(STORED_BEFORE))


def _clients(spark, d, alerts: bool):
    """Every customer listens to its own requests, and optionally to critical alerts."""
    own = F.transform(
        F.sequence(F.lit(0), F.lit(9)),
        lambda i: F.concat(F.lit("request:"), bulk.request_key(F.col("c_custkey") * 100 + i)),
    )
    channels = F.concat(own, F.array(F.lit("alert:Critical"))) if alerts else own
    return bulk.table(spark, d, "customer").select(
        F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("connection_id"),
        channels.alias("subscribed_channels"),
        F.when(F.col("c_custkey") % 2 == 0, instant(datetime(2024, 1, 30))).alias("last_received_at"),
    )


@query(
    "payload_guard",
    f"SELECT doc_id, CAST(strlen(text) AS BIGINT) AS bytes, strlen(text) > {SIZE_LIMIT} AS too_large FROM documents",
)
def payload_guard(spark, d):
    docs = bulk.table(spark, d, "documents").select("doc_id", F.col("text").alias("raw"))
    checked = ingest.guard_payload_size(docs, SIZE_LIMIT)
    return checked.select("doc_id", F.octet_length("raw").alias("bytes"), "too_large")


@query(
    "source_resolution",
    """SELECT delivery_id, source, source IN ('CRM', 'ERP', 'Engineering Software', 'Quotation System',
    'Logistics Platform', 'Manual') AS source_ok FROM srcs""",
)
def source_resolution(spark, d):
    return _sourced(spark, d).select("delivery_id", "source", "source_ok")


@query(
    "normalize_alias",
    """SELECT delivery_id, coalesce(json_extract_string(doc, '$.id'), json_extract_string(doc, '$.event_id')) AS id,
    coalesce(json_extract_string(doc, '$.requestId'), json_extract_string(doc, '$.request_id')) AS request_id,
    coalesce(json_extract_string(doc, '$.eventType'), json_extract_string(doc, '$.event_type')) AS event_type,
    coalesce(json_extract_string(doc, '$.sourceSystem'), json_extract_string(doc, '$.source_system')) AS source_system,
    json_extract_string(doc, '$.triggered_by') AS triggered_by, json_extract_string(doc, '$.new_state') AS new_state
    FROM docs""",
)
def normalize_alias(spark, d):
    df = ingest.apply_aliases(ingest.parse(_raw(spark, d).drop("id", "occurred_at")))
    return df.select(
        "delivery_id", "id", F.col("requestId").alias("request_id"), F.col("eventType").alias("event_type"),
        F.col("sourceSystem").alias("source_system"), F.col("triggeredByUserId").alias("triggered_by"),
        F.col("newState").alias("new_state"),
    )


@query(
    "normalize_mapped",
    """SELECT delivery_id, source, nullif(id, '') AS id, nullif(request_id, '') AS request_id, nullif(event_type, '') AS event_type,
    occurred_at, department, new_state FROM canon WHERE source IN ('CRM', 'ERP')""",
)
def normalize_mapped(spark, d):
    mapped = ingest.map_fields(_sourced(spark, d).drop("id", "occurred_at"), bulk.configs(spark))
    return mapped.where(F.col("source").isin("CRM", "ERP")).select(
        "delivery_id", "source", "id", F.col("requestId").alias("request_id"),
        F.col("eventType").alias("event_type"), F.col("occurredAt").alias("occurred_at"), "department",
        F.col("newState").alias("new_state"),
    )


@query("normalize_ts", "SELECT delivery_id, source, occurred_at FROM canon")
def normalize_ts(spark, d):
    mapped = ingest.map_fields(_sourced(spark, d).drop("id", "occurred_at"), bulk.configs(spark))
    return mapped.select("delivery_id", "source", F.col("occurredAt").alias("occurred_at"))


@query(
    "normalize_canonical",
    """SELECT delivery_id, id, request_id, event_type, source AS source_system, department, triggered_by_user,
    new_state, metadata_k, occurred_at, 'pending' AS pipeline_status FROM canon""",
)
def normalize_canonical(spark, d):
    return _canonical(spark, d).select(
        "delivery_id", "id", "request_id", "event_type", "source_system", "department", "triggered_by_user",
        "new_state", F.get_json_object("metadata", "$.k").cast("bigint").alias("metadata_k"), "occurred_at",
        "pipeline_status",
    )


@query(
    "validate_events",
    f"""SELECT delivery_id, concat_ws('; ', CASE WHEN id = '' THEN 'id: must not be empty' END,
    CASE WHEN NOT regexp_matches(request_id, '{S.UUID_PATTERN}') THEN 'requestId: Invalid uuid' END,
    CASE WHEN event_type = '' THEN 'eventType: must not be empty' END,
    CASE WHEN source NOT IN ('CRM', 'ERP', 'Engineering Software', 'Quotation System', 'Logistics Platform', 'Manual') THEN 'sourceSystem: unknown source system' END,
    CASE WHEN occurred_at IS NULL THEN 'occurredAt: must be a valid date-time' END) AS errors FROM canon""",
)
def validate_events(spark, d):
    checked = ingest.validate_events(_canonical(spark, d))
    return checked.select("delivery_id", F.array_join("errors", "; ").alias("errors"))


@query(
    "validate_strict",
    f"""SELECT delivery_id, concat_ws('; ', CASE WHEN coalesce(length(id), 0) < 1 THEN 'id: Event ID is required' END,
    CASE WHEN NOT coalesce(regexp_matches(rid, '{S.UUID_PATTERN}'), false) THEN 'requestId: Invalid request ID' END,
    CASE WHEN coalesce(length(et), 0) NOT BETWEEN 1 AND 255 THEN 'eventType: Event type is required' END,
    CASE WHEN src IS NULL OR src NOT IN ('CRM', 'ERP', 'Engineering Software', 'Quotation System', 'Logistics Platform', 'Manual') THEN 'sourceSystem: Invalid source system' END,
    CASE WHEN trig IS NOT NULL AND NOT regexp_matches(trig, '{S.UUID_PATTERN}') THEN 'triggeredByUserId: Invalid uuid' END,
    CASE WHEN tm IS NULL OR NOT regexp_matches(tm, '{S.ISO_UTC_PATTERN}') THEN 'occurredAt: must be ISO 8601 UTC' END) AS errors
    FROM (SELECT delivery_id, coalesce(json_extract_string(doc, '$.id'), json_extract_string(doc, '$.event_id')) AS id,
      coalesce(json_extract_string(doc, '$.requestId'), json_extract_string(doc, '$.request_id')) AS rid,
      coalesce(json_extract_string(doc, '$.eventType'), json_extract_string(doc, '$.event_type')) AS et,
      coalesce(json_extract_string(doc, '$.sourceSystem'), json_extract_string(doc, '$.source_system')) AS src,
      json_extract_string(doc, '$.triggered_by') AS trig, json_extract_string(doc, '$.occurredAt') AS tm FROM docs)""",
)
def validate_strict(spark, d):
    df = ingest.apply_aliases(ingest.parse(_raw(spark, d).drop("id", "occurred_at")))
    df = df.withColumn("occurredAt", F.get_json_object("raw", "$.occurredAt"))
    return ingest.validate_strict(df).select("delivery_id", F.array_join("errors", "; ").alias("errors"))


@query(
    "validate_requests",
    f"""SELECT c_custkey, concat_ws('; ', CASE WHEN length(nm) NOT BETWEEN 1 AND 255 THEN 'customerName: length' END,
    CASE WHEN length(dept) > 255 THEN 'assignedDepartment: too long' END,
    CASE WHEN NOT regexp_matches(usr_id, '{S.UUID_PATTERN}') THEN 'assignedUserId: Invalid user ID' END,
    CASE WHEN rt IS NULL THEN 'requestType: Required' END) AS create_errors,
    concat_ws('; ', CASE WHEN length(nm) NOT BETWEEN 1 AND 255 THEN 'customerName: length' END,
    CASE WHEN length(dept) > 255 THEN 'assignedDepartment: too long' END,
    CASE WHEN NOT regexp_matches(usr_id, '{S.UUID_PATTERN}') THEN 'assignedUserId: Invalid user ID' END,
    CASE WHEN c_nationkey = 3 THEN 'At least one field must be provided' END,
    CASE WHEN c_nationkey = 4 THEN 'Unrecognized key(s)' END) AS patch_errors
    FROM (SELECT c_custkey, c_nationkey, CASE WHEN c_acctbal < 0 THEN '' ELSE c_name END AS nm,
      CASE WHEN c_nationkey = 0 THEN repeat('x', 300) ELSE c_mktsegment END AS dept,
      CASE WHEN c_nationkey = 1 THEN 'u' || CAST(c_custkey AS VARCHAR) ELSE '00000000-0000-4000-8000-' || lpad(CAST(c_custkey AS VARCHAR), 12, '0') END AS usr_id,
      CASE WHEN c_nationkey <> 2 THEN c_mktsegment END AS rt FROM customer)""",
)
def validate_requests(spark, d):
    nation, key = F.col("c_nationkey"), F.col("c_custkey")
    payloads = bulk.table(spark, d, "customer").select(
        "c_custkey",
        F.when(F.col("c_acctbal") < 0, "").otherwise(F.col("c_name")).alias("customer_name"),
        F.lit(None).cast("string").alias("customer_contact"),
        F.when(nation != 2, F.col("c_mktsegment")).alias("request_type"),
        F.when(nation == 0, F.repeat(F.lit("x"), 300)).otherwise(F.col("c_mktsegment")).alias("assigned_department"),
        F.when(nation == 1, F.concat(F.lit("u"), key.cast("string"))).otherwise(bulk.request_key(key)).alias("assigned_user_id"),
        F.lit(None).cast("string").alias("current_status"),
        F.when(nation == 3, F.array().cast("array<string>")).when(nation == 4, F.array(F.lit("current_stage")))
        .otherwise(F.array(F.lit("customer_name"))).alias("fields"),
    )
    created = ingest.validate_requests(payloads, "create").withColumn("create_errors", F.array_join("errors", "; "))
    return ingest.validate_requests(created, "patch").select(
        "c_custkey", "create_errors", F.array_join("errors", "; ").alias("patch_errors")
    )


@query(
    "verify_signatures",
    """SELECT delivery_id, source, k%2 = 0 AND source IN ('CRM', 'ERP', 'Engineering Software', 'Logistics Platform') AS signature_ok
    FROM srcs WHERE doc IS NOT NULL""",
)
def verify_signatures(spark, d):
    """Payloads signed with the right secret when ``k`` is even, with another one when it is odd."""
    df = _sourced(spark, d).where(F.col("is_json"))
    wrong = [F.lit(bytearray(b)) for b in key_blocks("another secret")]
    digest = hmac_sha256(F.col("raw"), *wrong)
    for row in ingest.settings(bulk.configs(spark)):
        if row["webhook_secret"]:
            right = [F.lit(bytearray(b)) for b in key_blocks(row["webhook_secret"])]
            fits = (F.col("source") == row["source_system"]) & (F.col("k") % 2 == 0)
            digest = F.when(fits, hmac_sha256(F.col("raw"), *right)).otherwise(digest)
    signed = df.withColumn("signature", F.concat(F.lit(PREFIX), digest))
    return ingest.verify_signatures(signed, bulk.configs(spark)).select("delivery_id", "source", "signature_ok")


@query(
    "event_append",
    f"""SELECT id, request_id, min(received_at) AS received_at, min(occurred_at) AS occurred_at FROM judged
    WHERE reasons = '' AND id NOT IN (SELECT id FROM ev WHERE received_at < TIMESTAMP '{STORED_BEFORE}')
    GROUP BY id, request_id""",
)
def event_append(spark, d):
    checked = ingest.validate_events(_canonical(spark, d))
    valid = checked.where((F.size("errors") == 0) & F.col("is_json"))
    new = valid.select(*ingest.EVENT_COLUMNS, "delivery_id")
    return ingest.append_events(new, _stored(spark, d)).select("id", "request_id", "received_at", "occurred_at")


@query(
    "ingest_outcome",
    f"""SELECT delivery_id, id, reasons,
    CASE WHEN reasons <> '' THEN 'invalid' WHEN stored.sid IS NOT NULL OR place > 1 THEN 'duplicate' ELSE 'accepted' END AS status,
    CAST(CASE WHEN reasons <> '' THEN 422 WHEN stored.sid IS NOT NULL OR place > 1 THEN 409 ELSE 202 END AS BIGINT) AS http_code
    FROM (SELECT *, row_number() OVER (PARTITION BY id, reasons = '' ORDER BY received_at, delivery_id) AS place FROM judged) j
    LEFT JOIN (SELECT id AS sid FROM ev WHERE received_at < TIMESTAMP '{STORED_BEFORE}') stored ON stored.sid = j.id""",
)
def ingest_outcome(spark, d):
    raw = _raw(spark, d).drop("id", "occurred_at", "k")
    outcome = ingest.ingest(raw, bulk.configs(spark), _stored(spark, d))
    return outcome.select("delivery_id", "id", F.array_join("reasons", "; ").alias("reasons"), "status", "http_code")


@query(
    "pipeline_status",
    """SELECT id, CASE WHEN k%9 = 0 THEN 'partial' WHEN k%13 = 0 THEN 'pending' ELSE 'complete' END AS pipeline_status,
    CASE WHEN k%9 = 0 THEN 'sla-evaluate,analytics-update' ELSE '' END AS failed_steps FROM ev""",
)
def pipeline_status(spark, d):
    """Results of the five steps: two fail when ``k`` divides by 9, one is missing when by 13."""
    steps = F.explode(F.array(*[F.lit(s) for s in S.PIPELINE_STEPS])).alias("step")
    results = bulk.plain_events(spark, d).select("id", "k", steps)
    results = results.where((F.col("k") % 13 != 0) | (F.col("step") != "realtime-broadcast"))
    failing = (F.col("k") % 9 == 0) & F.col("step").isin("sla-evaluate", "analytics-update")
    status = ingest.pipeline_status(results.withColumn("ok", ~failing))
    return status.withColumn("failed_steps", F.array_join("failed_steps", ","))


_ACTIVE_SOURCES = """(VALUES ('CRM', TIMESTAMP '2024-01-10'), ('ERP', TIMESTAMP '2024-01-20'),
      ('Engineering Software', NULL), ('Logistics Platform', TIMESTAMP '2024-01-20')) c(source_system, mark)"""
_PULLED = "e.source_system = c.source_system AND (c.mark IS NULL OR e.received_at > c.mark)"
_SYNC = f"""SELECT c.source_system, CAST(count(e.id) AS BIGINT) AS processed,
    CAST(coalesce(sum(CASE WHEN e.received_at < TIMESTAMP '{STORED_BEFORE}' THEN 1 ELSE 0 END), 0) AS BIGINT) AS duplicates,
    coalesce(max(e.received_at), max(c.mark)) AS last_synced_at
    FROM {_ACTIVE_SOURCES} LEFT JOIN ev e ON {_PULLED}
    GROUP BY c.source_system"""


@query("incremental_sync", _SYNC)
def incremental_sync(spark, d):
    _, report = ingest.incremental_sync(bulk.plain_events(spark, d), bulk.configs(spark), _stored(spark, d))
    return report


@query(
    "sync_events",
    f"""SELECT e.id, e.source_system, e.received_at FROM {_ACTIVE_SOURCES} JOIN ev e ON {_PULLED}
    WHERE e.received_at >= TIMESTAMP '{STORED_BEFORE}'""",
)
def sync_events(spark, d):
    """The events that the pull adds to the store."""
    fresh, _ = ingest.incremental_sync(bulk.plain_events(spark, d), bulk.configs(spark), _stored(spark, d))
    return fresh.select("id", "source_system", "received_at")


@query(
    "archived_union",
    f"""SELECT id, request_id, occurred_at, occurred_at < TIMESTAMP '{STORED_BEFORE}' AND received_at < TIMESTAMP '{STORED_BEFORE}' AS cold
    FROM ev WHERE received_at >= TIMESTAMP '{STORED_BEFORE}' OR occurred_at < TIMESTAMP '{STORED_BEFORE}'""",
)
def archived_union(spark, d):
    """Old events are read from the archive, also those which are still in the store; ``cold`` marks the others."""
    events = bulk.plain_events(spark, d)
    live = events.where(F.col("received_at") >= instant(STORED_BEFORE))
    both = ingest.with_archive(live, ingest.archive_older_than(events, STORED_BEFORE))
    return both.select("id", "request_id", "occurred_at", (F.col("received_at") < instant(STORED_BEFORE)).alias("cold"))


@query(
    "archive_eligible",
    f"SELECT CAST(date_trunc('day', occurred_at) AS TIMESTAMP) AS day, CAST(count(*) AS BIGINT) AS archived_count FROM ev WHERE occurred_at < TIMESTAMP '{STORED_BEFORE}' GROUP BY 1",
)
def archive_eligible(spark, d):
    old = ingest.archive_older_than(bulk.plain_events(spark, d), STORED_BEFORE)
    return old.groupBy(F.date_trunc("DAY", "occurred_at").alias("day")).agg(F.count(F.lit(1)).alias("archived_count"))


@query(
    "orphan_events",
    """SELECT id, request_id, occurred_at FROM ev WHERE request_id NOT IN
    (SELECT id FROM reqs WHERE created_at < TIMESTAMP '2024-01-25')""",
)
def orphan_events(spark, d):
    known = bulk.requests(spark, d).where(F.col("created_at") < instant(datetime(2024, 1, 25)))
    return timeline.orphan_events(bulk.plain_events(spark, d), known).select("id", "request_id", "occurred_at")


@query(
    "arrival_delay",
    """SELECT source_system, CAST(count(*) AS BIGINT) AS events, max((epoch_us(received_at)-epoch_us(occurred_at))/1e6) AS max_delay_seconds,
    floor(avg((epoch_us(received_at)-epoch_us(occurred_at))/1e6)*1e6+0.5e0)/1e6 AS avg_delay_seconds FROM ev GROUP BY 1""",
)
def arrival_delay(spark, d):
    delayed = timeline.arrival_delay(bulk.plain_events(spark, d))
    return delayed.groupBy("source_system").agg(
        F.count(F.lit(1)).alias("events"),
        F.max("delay_seconds").alias("max_delay_seconds"),
        (F.floor(F.avg("delay_seconds") * 1e6 + F.lit(0.5)) / F.lit(1e6)).alias("avg_delay_seconds"),
    )


_PAYLOADS = """(SELECT 'alert:' || severity AS channel, 'alert_created' AS event, created_at AS sent_at, id AS source_id, message FROM alerts
    UNION ALL SELECT 'request:' || request_id, 'event_received', received_at, id, NULL FROM ev)"""


def _payloads(spark, d):
    return broadcast.broadcast_payloads(bulk.alerts(spark, d), bulk.plain_events(spark, d))


@query("broadcast_payloads", f"SELECT channel, event, sent_at, source_id, source_id AS data_id, message FROM {_PAYLOADS}")
def broadcast_payloads(spark, d):
    data_id = F.coalesce(F.get_json_object("data", "$.alertId"), F.get_json_object("data", "$.eventId"))
    return _payloads(spark, d).select(
        "channel", "event", "sent_at", "source_id", data_id.alias("data_id"),
        F.get_json_object("data", "$.message").alias("message"),
    )


_CLIENTS = """(SELECT 'c' || CAST(c_custkey AS VARCHAR) AS connection_id, c_custkey,
    unnest(range(10)) AS slot FROM customer)"""


@query(
    "channel_fanout",
    f"""SELECT connection_id, CAST(count(*) AS BIGINT) AS messages, max(sent_at) AS last_sent_at FROM
    (SELECT connection_id, 'request:00000000-0000-4000-8000-' || lpad(CAST(c_custkey*100+slot AS VARCHAR), 12, '0') AS channel FROM {_CLIENTS}
     UNION ALL SELECT 'c' || CAST(c_custkey AS VARCHAR), 'alert:Critical' FROM customer) JOIN {_PAYLOADS} USING (channel) GROUP BY 1""",
)
def channel_fanout(spark, d):
    return broadcast.delivery_counts(_payloads(spark, d), _clients(spark, d, alerts=True))


@query(
    "replay_undelivered",
    f"""SELECT connection_id, p.source_id, p.channel, p.sent_at FROM
    (SELECT connection_id, c_custkey, 'request:00000000-0000-4000-8000-' || lpad(CAST(c_custkey*100+slot AS VARCHAR), 12, '0') AS channel FROM {_CLIENTS}) s
    JOIN {_PAYLOADS} p USING (channel) JOIN ev e ON e.id = p.source_id
    WHERE p.sent_at > TIMESTAMP '2024-01-29 12:00:00' AND p.sent_at <= TIMESTAMP '2024-01-30 12:00:00'
    AND (c_custkey%2 = 1 OR p.sent_at > TIMESTAMP '2024-01-30') AND e.k >= 50""",
)
def replay_undelivered(spark, d):
    """Messages of events with ``k`` below 50 had been delivered."""
    clients = _clients(spark, d, alerts=False)
    delivered = bulk.plain_events(spark, d).where(F.col("k") < 50).select(
        F.concat(F.lit("c"), F.col("user_id").cast("string")).alias("connection_id"), F.col("id").alias("source_id")
    )
    missed = broadcast.replay(_payloads(spark, d), delivered, clients, REPLAY_AT)
    return missed.select("connection_id", "source_id", "channel", "sent_at")


@query(
    "replay_in_order",
    f"""SELECT connection_id, delivery_no, source_id, channel, sent_at FROM
    (SELECT connection_id, c_custkey, p.source_id, p.channel, p.sent_at,
      CAST(row_number() OVER (PARTITION BY connection_id ORDER BY p.sent_at, p.source_id, p.channel) AS BIGINT) AS delivery_no, e.k
     FROM (SELECT connection_id, c_custkey, 'request:00000000-0000-4000-8000-' || lpad(CAST(c_custkey*100+slot AS VARCHAR), 12, '0') AS channel FROM {_CLIENTS}) s
     JOIN {_PAYLOADS} p USING (channel) JOIN ev e ON e.id = p.source_id)
    WHERE sent_at > TIMESTAMP '2024-01-29 12:00:00' AND sent_at <= TIMESTAMP '2024-01-30 12:00:00'
    AND (c_custkey%2 = 1 OR sent_at > TIMESTAMP '2024-01-30') AND k >= 50""",
)
def replay_in_order(spark, d):
    """Messages of events with ``k`` below 50 had been delivered, in two rounds; the rest in the order of the queue."""
    queue = broadcast.delivery_queue(_payloads(spark, d), _clients(spark, d, alerts=False))
    k = bulk.plain_events(spark, d).select(F.col("id").alias("source_id"), "k")
    numbers = queue.join(k, "source_id").select("connection_id", "delivery_no", "k")
    cursors, gaps = spark.createDataFrame([], broadcast.CURSOR), spark.createDataFrame([], broadcast.GAP)
    for got in (numbers.where("k < 50 AND k % 2 = 1"), numbers.where("k < 50 AND k % 2 = 0")):
        cursors, gaps = broadcast.advance_cursors(cursors, gaps, got)
    missed = broadcast.replay_from(queue, cursors, gaps, REPLAY_AT)
    return missed.select("connection_id", "delivery_no", "source_id", "channel", "sent_at")
