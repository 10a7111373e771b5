"""The domain tables derived from the provided bulk tables.

``events`` becomes workflow events (one request per user and three-day window), ``customer`` the
users and customers. Everything else (requests, alerts, commands, predictions, raw payloads) is
computed from these, so all work grows with the bulk tables.
"""

from __future__ import annotations

from datetime import datetime
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession, functions as F

from stagewatch import schema as S
from stagewatch.functions.times import instant, plus_hours
from stagewatch.operators.sla import sla_alert_candidates, sla_evaluate, stage_dwell
from stagewatch.operators.timeline import timeline_positions
from stagewatch.plans.sequence import Sequence, hot_keys, sequence

AS_OF = datetime(2024, 1, 31)

# Department of an event type.
DEPARTMENTS = {
    "click": "Sales",
    "view": "Engineering",
    "purchase": "Finance",
    "signup": "Operations",
    "error": "Logistics",
}

# Declared schemas of the bulk tables in use: no job reads footers to infer them.
SCHEMAS = {
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
}

# Plans, not data: a frame is built once per session and folder, like a registered view.
_view = lru_cache(maxsize=64)


@_view
def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _pick(values: list[str], place) -> F.Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), place.cast("int"))


def request_key(number) -> F.Column:
    """A request number in UUID form."""
    return F.concat(F.lit("00000000-0000-4000-8000-"), F.lpad(number.cast("string"), 12, "0"))


@_view
def plain_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Workflow events without their states: a pure projection of the scan."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    department = F.create_map(*[F.lit(v) for kv in DEPARTMENTS.items() for v in kv])
    window_number = F.floor((F.dayofmonth("ts") - 1) / 3).cast("bigint")
    at = F.date_trunc("MILLISECOND", F.col("ts").cast("timestamp"))
    return table(spark, sf_dir, "events").select(
        F.col("event_id").cast("string").alias("id"),
        request_key(F.col("user_id") * 100 + window_number).alias("request_id"),
        "user_id",
        "event_type",
        k.alias("k"),
        _pick(S.SOURCES, k % 6 + 1).alias("source_system"),
        F.when(k >= 5, department[F.col("event_type")]).alias("department"),
        F.when(k % 10 != 0, F.concat(F.lit("u"), F.col("user_id").cast("string"))).alias("triggered_by_user"),
        F.col("props").alias("metadata"),
        at.alias("occurred_at"),
        F.timestamp_micros(F.unix_micros(at) + k * 60_000_000).alias("received_at"),
        F.when(k % 9 == 0, "partial").otherwise("complete").alias("pipeline_status"),
        F.when(k % 9 == 0, F.array(F.lit("analytics-update"))).otherwise(F.array().cast("array<string>")).alias("failed_steps"),
    )


@_view
def _hot_requests(spark: SparkSession, sf_dir: str) -> tuple:
    return tuple(hot_keys(plain_events(spark, sf_dir), "request_id").items())


def hot_requests(spark: SparkSession, sf_dir: str) -> dict:
    """Requests too large for one task. A hint for the plan only, so looked up once per folder."""
    return dict(_hot_requests(spark, sf_dir))


@_view
def sequenced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with their place ``rn`` in the request and the time ``next_at`` of the next one."""
    want = Sequence(position="rn", lead={"next_at": "occurred_at"})
    return sequence(
        plain_events(spark, sf_dir), "request_id", "occurred_at", "id", want, hot_requests(spark, sf_dir)
    )


@_view
def ops_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Workflow events; the n-th event of a request enters the n-th stage, up to Completed."""
    last = len(S.PROGRESS_STAGES)
    before = F.greatest(F.least(F.col("rn") - 1, F.lit(last)), F.lit(1))
    return sequenced(spark, sf_dir).withColumns(
        {
            "new_state": _pick(S.STAGES, F.least(F.col("rn"), F.lit(last))),
            "previous_state": F.when(F.col("rn") > 1, _pick(S.STAGES, before)),
        }
    )


@_view
def rules(spark: SparkSession) -> DataFrame:
    """The default SLA rules (seven rows, one per active stage)."""
    rows = ", ".join(f"('{stage}', CAST({hours} AS DECIMAL(8,2)), '{text}')" for stage, hours, text in S.SLA_SEED)
    return spark.sql(f"SELECT * FROM VALUES {rows} AS rules(journey_stage, threshold_hours, description)")


@_view
def dwell(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stage entries with the time of the next transition, from the sequence of ``ops_events``."""
    return stage_dwell(ops_events(spark, sf_dir), AS_OF)


@_view
def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per request: first event gives the origin, last one the state, dwells the breach."""
    evaluated = sla_evaluate(dwell(spark, sf_dir), rules(spark), keep_terminal=True)
    first = F.col("rn") == 1
    return (
        evaluated.groupBy("request_id")
        .agg(
            F.min("user_id").alias("user_id"),
            F.max(F.when(first, F.col("event_type"))).alias("request_type"),
            F.max("rn").alias("event_count"),
            F.max(F.when(first, F.col("department"))).alias("assigned_department"),
            F.max(F.when(first, F.col("triggered_by_user"))).alias("assigned_user_id"),
            F.bool_or(F.coalesce("breached", F.lit(False))).alias("sla_breached"),
            F.min("occurred_at").alias("created_at"),
            F.max("occurred_at").alias("updated_at"),
        )
        .withColumn("current_stage", _pick(S.STAGES, F.least("event_count", F.lit(len(S.PROGRESS_STAGES)))))
        .select(
            F.col("request_id").alias("id"),
            F.concat(F.lit("SR-2024-"), F.substring("request_id", 25, 12)).alias("request_number"),
            "user_id",
            F.concat(F.lit("contact"), F.col("user_id").cast("string"), F.lit("@example.com")).alias("customer_contact"),
            "request_type",
            "current_stage",
            F.when(F.col("current_stage") == "Completed", "Closed").otherwise("Open").alias("current_status"),
            "assigned_department",
            "assigned_user_id",
            F.lit(None).cast("string").alias("metadata"),
            "sla_breached",
            "created_at",
            "updated_at",
        )
    )


def with_customer(reqs: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attach the customer name; the join strategy is left to the optimizer's size estimate."""
    customer = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("user_id"), F.col("c_name").alias("customer_name")
    )
    return reqs.join(customer, "user_id", "left")


@_view
def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer is a user; the role follows the key."""
    key = F.col("c_custkey")
    text = key.cast("string")
    return table(spark, sf_dir, "customer").select(
        F.concat(F.lit("u"), text).alias("id"),
        F.concat(F.lit("user"), text, F.lit("@example.com")).alias("email"),
        _pick(S.ROLES, key % 5 + 1).alias("role"),
        (F.col("c_acctbal") > 0).alias("is_active"),
        F.col("c_name").alias("name"),
    )


@_view
def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SLA alerts of all stage entries, moved through the lifecycle by the event's ``k``."""
    evaluated = sla_evaluate(dwell(spark, sf_dir), rules(spark))
    state = _pick(S.LIFECYCLE, F.col("k") % 4 + 1)
    step = F.col("k") % 4
    raised = plus_hours(F.col("entered_at"), F.col("threshold_hours"))
    rows = sla_alert_candidates(evaluated, carry=["k", "entered_at", "threshold_hours", "user_id"])

    def after(hours: int, needed: int):
        return F.when(step >= needed, plus_hours(F.col("created_at"), F.lit(float(hours))))

    clerk = F.concat(F.lit("u"), F.col("user_id").cast("string"))
    return (
        rows.withColumn("created_at", raised)
        .withColumn("lifecycle_state", state)
        .withColumns(
            {
                "acknowledged_by": F.when(step >= 1, clerk),
                "acknowledged_at": after(1, 1),
                "resolved_by": F.when(step >= 2, clerk),
                "resolved_at": after(2, 2),
                "archived_at": after(3, 3),
            }
        )
        .select(*[f.name for f in S.TABLES["alerts"].fields], "journey_stage", "k")
    )


@_view
def timelines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored timeline entries: one per event, numbered in order of arrival."""
    return timeline_positions(plain_events(spark, sf_dir), by="arrival", hot=hot_requests(spark, sf_dir))


@_view
def configs(spark: SparkSession) -> DataFrame:
    """Integration settings: CRM maps its own field names, ERP nests them, Manual has no secret."""
    crm = {"id": "$.crm_id", "requestId": "$.opportunity_id", "eventType": "$.activity_type",
           "occurredAt": "$.created_date", "department": "$.team"}
    erp = {"id": "$.doc.id", "requestId": "$.doc.request", "eventType": "$.doc.kind",
           "occurredAt": "$.doc.at", "newState": "$.doc.state.to"}
    start, later = datetime(2024, 1, 10), datetime(2024, 1, 20)
    data = [
        ("CRM", "crm-secret", crm, 15, start, True),
        ("ERP", "erp-secret", erp, 30, later, True),
        ("Engineering Software", "eng-" + "s" * 80, None, 60, None, True),
        ("Quotation System", None, None, 60, start, False),
        ("Logistics Platform", "logistics-secret", None, None, later, True),
    ]
    return spark.createDataFrame(data, S.TABLES["integration_configs"])


@_view
def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw payloads of the events as the source systems would send them.

    ``k`` selects the spelling: mapped CRM and nested ERP documents, snake_case, camelCase, and
    payloads with missing or broken fields. Each event with ``k`` divisible by 7 is sent twice.
    """
    e = plain_events(spark, sf_dir)
    k, rid = F.col("k"), F.col("request_id")
    iso = F.date_format("occurred_at", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    plus3 = F.date_format(F.timestamp_micros(F.unix_micros("occurred_at") + 3 * 3_600_000_000), "yyyy-MM-dd'T'HH:mm:ss.SSS'+03:00'")
    millis = F.unix_millis("occurred_at").cast("string")
    seconds = F.floor(F.unix_millis("occurred_at") / 1000).cast("bigint").cast("string")

    def doc(template: str, *parts):
        """The template with its %s replaced in turn."""
        texts = template.split("%s")
        pieces = [F.lit(texts[0])]
        for part, text in zip(parts, texts[1:], strict=True):
            pieces += [F.col(part) if isinstance(part, str) else part, F.lit(text)]
        return F.concat(*pieces)

    crm = doc('{"crm_id":"%s","opportunity_id":"%s","activity_type":"%s","created_date":"%s","team":"Field","sourceSystem":"CRM"}',
              "id", rid, "event_type", plus3)
    erp = doc('{"doc":{"id":"%s","request":"%s","kind":"%s","at":%s,"state":{"to":"Quotation"}},"source_system":"ERP"}',
              "id", rid, "event_type", millis)
    snake = doc('{"event_id":"%s","request_id":"%s","event_type":"%s","source_system":"Logistics Platform","occurred_at":"%s","triggered_by":"u1","new_state":"Dispatch","legacy_field":1}',
                "id", rid, "event_type", seconds)
    camel = doc('{"id":"%s","requestId":"%s","eventType":"%s","occurredAt":"%s","department":"Logistics","metadata":%s,"extra":"x"}',
                "id", rid, "event_type", iso, "metadata")
    no_id = doc('{"id":"","requestId":"%s","eventType":"%s","occurredAt":"%s"}', rid, "event_type", iso)
    bad_request = doc('{"id":"%s","requestId":"req-%s","eventType":"","occurredAt":"%s"}', "id", k.cast("string"), iso)
    no_time = doc('{"id":"%s","requestId":"%s","eventType":"%s"}', "id", rid, "event_type")
    bad_source = doc('{"id":"%s","requestId":"%s","eventType":"%s","occurredAt":"%s","sourceSystem":"Fax"}', "id", rid, "event_type", iso)
    raw = (
        F.when(k < 20, crm).when(k < 40, erp).when(k < 60, snake).when(k < 90, camel)
        .when(k < 92, no_id).when(k < 94, bad_request).when(k < 96, no_time).when(k < 98, bad_source)
        .otherwise(F.lit("not json"))
    )
    copies = F.when(k % 7 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return (
        e.withColumn("raw", raw)
        .withColumn("copy", F.explode(copies))
        .select(
            F.concat("id", F.lit("-"), F.col("copy").cast("string")).alias("delivery_id"),
            "raw",
            F.when((k >= 60) & (k % 2 == 0), F.lit("Engineering Software")).alias("header_source"),
            F.lit(None).cast("string").alias("signature"),
            F.timestamp_micros(F.unix_micros("received_at") + F.col("copy") * 1_000_000).alias("received_at"),
            "k",
            "id",
            "occurred_at",
        )
    )


def as_of():
    return instant(AS_OF)
