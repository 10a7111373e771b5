"""Registry of queries with their SQL oracles, and the shared text of those oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from stagewatch import schema as S
from stagewatch.session import configure
from stagewatch.sources import bulk

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def plain(df: DataFrame) -> DataFrame:
    """Types both engines print alike: zone-free timestamps, bigint, double."""
    columns = []
    for field in df.schema.fields:
        column, kind = F.col(f"`{field.name}`"), field.dataType
        if isinstance(kind, T.TimestampType):
            column = column.cast("timestamp_ntz")
        elif isinstance(kind, (T.IntegerType, T.ShortType, T.ByteType)):
            column = column.cast("bigint")
        elif isinstance(kind, (T.DecimalType, T.FloatType)):
            column = column.cast("double")
        columns.append(column.alias(field.name))
    return df.select(*columns)


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; ``sql`` is its oracle over the shared definitions below."""

    def register(build: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return plain(build(configure(spark), sf_dir))

        QUERIES[name] = run
        if sql is not None:
            # An oracle that starts with a comma adds definitions of its own.
            ORACLES[name] = f"WITH {BASE.strip()}{sql.strip()}" if sql.startswith(",") else f"WITH {BASE}{sql.strip()}"
        return build

    return register


def _list(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def r6(value: str) -> str:
    return f"floor(({value})*1e6+0.5e0)/1e6"


def rn(value: str, digits: int) -> str:
    return f"floor(({value})*1e{digits}+0.5e0)/1e{digits}"


def fixed(value: str, digits: int) -> str:
    units = f"CAST(floor(({value})*1e{digits}+0.5e0) AS BIGINT)"
    scale = 10**digits
    return f"(CAST({units}//{scale} AS VARCHAR) || '.' || lpad(CAST({units}%{scale} AS VARCHAR), {digits}, '0'))"


def hours(start: str, end: str) -> str:
    return f"(epoch_us({end})-epoch_us({start}))/3.6e9"


STAGES_SQL = _list(S.STAGES)
AS_OF_SQL = f"TIMESTAMP '{bulk.AS_OF:%Y-%m-%d %H:%M:%S}'"
_RULES = ", ".join(f"('{s}', CAST({h} AS DOUBLE), '{t}')" for s, h, t in S.SLA_SEED)
_DEPARTMENTS = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in bulk.DEPARTMENTS.items())

# The domain tables in SQL, defined as in stagewatch.sources.bulk.
BASE = f"""
ev AS (
  SELECT CAST(event_id AS VARCHAR) AS id,
    '00000000-0000-4000-8000-' || lpad(CAST(user_id*100 + (day(ts)-1)//3 AS VARCHAR), 12, '0') AS request_id,
    user_id, event_type, k, {_list(S.SOURCES)}[k%6+1] AS source_system,
    CASE WHEN k >= 5 THEN CASE event_type {_DEPARTMENTS} END END AS department,
    CASE WHEN k%10 <> 0 THEN 'u' || CAST(user_id AS VARCHAR) END AS triggered_by_user,
    props AS metadata, date_trunc('millisecond', ts) AS occurred_at,
    date_trunc('millisecond', ts) + to_minutes(k) AS received_at,
    CASE WHEN k%9 = 0 THEN 'partial' ELSE 'complete' END AS pipeline_status
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)),
seq AS (
  SELECT *, row_number() OVER w AS rn, lead(occurred_at) OVER w AS next_at
  FROM ev WINDOW w AS (PARTITION BY request_id ORDER BY occurred_at, id)),
ops AS (
  SELECT *, {STAGES_SQL}[least(rn, 8)] AS new_state,
    CASE WHEN rn > 1 THEN {STAGES_SQL}[least(rn-1, 8)] END AS previous_state FROM seq),
rules(journey_stage, threshold_hours, description) AS (VALUES {_RULES}),
dwell AS (
  SELECT *, new_state AS journey_stage, occurred_at AS entered_at, next_at IS NULL AS is_open,
    {hours('occurred_at', f'coalesce(next_at, {AS_OF_SQL})')} AS elapsed_hours FROM ops),
evald AS (
  SELECT d.*, r.threshold_hours, d.elapsed_hours/r.threshold_hours AS percent_used,
    d.elapsed_hours/r.threshold_hours >= 1.0 AS breached
  FROM dwell d JOIN rules r USING (journey_stage)),
reqs AS (
  SELECT o.request_id AS id, 'SR-2024-' || substr(o.request_id, 25, 12) AS request_number,
    min(o.user_id) AS user_id, max(CASE WHEN rn = 1 THEN event_type END) AS request_type,
    {STAGES_SQL}[least(max(rn), 8)] AS current_stage,
    CASE WHEN max(rn) >= 8 THEN 'Closed' ELSE 'Open' END AS current_status,
    max(CASE WHEN rn = 1 THEN department END) AS assigned_department,
    max(CASE WHEN rn = 1 THEN triggered_by_user END) AS assigned_user_id,
    coalesce(bool_or(b.breached), false) AS sla_breached,
    min(o.occurred_at) AS created_at, max(o.occurred_at) AS updated_at
  FROM ops o LEFT JOIN (SELECT id AS bid, breached FROM evald) b ON b.bid = o.id
  GROUP BY o.request_id),
usr AS (
  SELECT 'u' || CAST(c_custkey AS VARCHAR) AS id, 'user' || CAST(c_custkey AS VARCHAR) || '@example.com' AS email,
    {_list(S.ROLES)}[c_custkey%5+1] AS role, c_acctbal > 0 AS is_active, c_name AS name FROM customer),
alerts AS (
  SELECT request_id || '|' || journey_stage || '|' || severity AS id, request_id, 'SLA Breach Alert' AS alert_type,
    severity, {_list(S.LIFECYCLE)}[k%4+1] AS lifecycle_state, journey_stage, k, created_at,
    CASE WHEN severity = 'Critical'
      THEN 'SLA breached for request ' || request_id || ' at stage "' || journey_stage || '". Elapsed: ' || {fixed('elapsed_hours', 2)} || 'h / Threshold: ' || CAST(CAST(threshold_hours AS BIGINT) AS VARCHAR) || 'h.'
      ELSE 'SLA warning for request ' || request_id || ' at stage "' || journey_stage || '". ' || {fixed('percent_used*100', 1)} || '% of threshold used (' || {fixed('elapsed_hours', 2)} || 'h / ' || CAST(CAST(threshold_hours AS BIGINT) AS VARCHAR) || 'h).' END AS message,
    CASE WHEN k%4 >= 1 THEN 'u' || CAST(user_id AS VARCHAR) END AS acknowledged_by,
    CASE WHEN k%4 >= 1 THEN created_at + INTERVAL 1 HOUR END AS acknowledged_at,
    CASE WHEN k%4 >= 2 THEN created_at + INTERVAL 2 HOUR END AS resolved_at,
    CASE WHEN k%4 >= 3 THEN created_at + INTERVAL 3 HOUR END AS archived_at
  FROM (SELECT *, CASE WHEN percent_used >= 1.0 THEN 'Critical' ELSE 'Warning' END AS severity,
          entered_at + to_hours(CAST(threshold_hours AS BIGINT)) AS created_at
        FROM evald WHERE percent_used >= 0.8)),
raws AS (
  SELECT id || '-' || CAST(copy AS VARCHAR) AS delivery_id, id AS event_id, k, occurred_at, request_id, event_type,
    received_at + to_seconds(copy) AS received_at,
    CASE WHEN k >= 60 AND k%2 = 0 THEN 'Engineering Software' END AS header_source,
    CASE WHEN k < 20 THEN '{{"crm_id":"' || id || '","opportunity_id":"' || request_id || '","activity_type":"' || event_type || '","created_date":"' || strftime(occurred_at + INTERVAL 3 HOUR, '%Y-%m-%dT%H:%M:%S.%g') || '+03:00","team":"Field","sourceSystem":"CRM"}}'
      WHEN k < 40 THEN '{{"doc":{{"id":"' || id || '","request":"' || request_id || '","kind":"' || event_type || '","at":' || CAST(epoch_ms(occurred_at) AS VARCHAR) || ',"state":{{"to":"Quotation"}}}},"source_system":"ERP"}}'
      WHEN k < 60 THEN '{{"event_id":"' || id || '","request_id":"' || request_id || '","event_type":"' || event_type || '","source_system":"Logistics Platform","occurred_at":"' || CAST(epoch_ms(occurred_at)//1000 AS VARCHAR) || '","triggered_by":"u1","new_state":"Dispatch","legacy_field":1}}'
      WHEN k < 90 THEN '{{"id":"' || id || '","requestId":"' || request_id || '","eventType":"' || event_type || '","occurredAt":"' || strftime(occurred_at, '%Y-%m-%dT%H:%M:%S.%g') || 'Z","department":"Logistics","metadata":' || metadata || ',"extra":"x"}}'
      WHEN k < 92 THEN '{{"id":"","requestId":"' || request_id || '","eventType":"' || event_type || '","occurredAt":"' || strftime(occurred_at, '%Y-%m-%dT%H:%M:%S.%g') || 'Z"}}'
      WHEN k < 94 THEN '{{"id":"' || id || '","requestId":"req-' || CAST(k AS VARCHAR) || '","eventType":"","occurredAt":"' || strftime(occurred_at, '%Y-%m-%dT%H:%M:%S.%g') || 'Z"}}'
      WHEN k < 96 THEN '{{"id":"' || id || '","requestId":"' || request_id || '","eventType":"' || event_type || '"}}'
      WHEN k < 98 THEN '{{"id":"' || id || '","requestId":"' || request_id || '","eventType":"' || event_type || '","occurredAt":"' || strftime(occurred_at, '%Y-%m-%dT%H:%M:%S.%g') || 'Z","sourceSystem":"Fax"}}'
      ELSE 'not json' END AS raw
  FROM (SELECT *, unnest(CASE WHEN k%7 = 0 THEN [0, 1] ELSE [0] END) AS copy FROM ev)),
docs AS (SELECT *, CASE WHEN json_valid(raw) THEN raw END AS doc FROM raws),
srcs AS (
  SELECT *, coalesce(json_extract_string(doc, '$.sourceSystem'), json_extract_string(doc, '$.source_system'), header_source, 'Manual') AS source FROM docs),
canon AS (
  SELECT delivery_id, k, received_at, doc, source,
    coalesce(CASE source WHEN 'CRM' THEN json_extract_string(doc, '$.crm_id') WHEN 'ERP' THEN json_extract_string(doc, '$.doc.id')
      ELSE coalesce(json_extract_string(doc, '$.id'), json_extract_string(doc, '$.event_id')) END, '') AS id,
    coalesce(CASE source WHEN 'CRM' THEN json_extract_string(doc, '$.opportunity_id') WHEN 'ERP' THEN json_extract_string(doc, '$.doc.request')
      ELSE coalesce(json_extract_string(doc, '$.requestId'), json_extract_string(doc, '$.request_id')) END, '') AS request_id,
    coalesce(CASE source WHEN 'CRM' THEN json_extract_string(doc, '$.activity_type') WHEN 'ERP' THEN json_extract_string(doc, '$.doc.kind')
      ELSE coalesce(json_extract_string(doc, '$.eventType'), json_extract_string(doc, '$.event_type')) END, '') AS event_type,
    CASE source WHEN 'CRM' THEN json_extract_string(doc, '$.team') WHEN 'ERP' THEN NULL ELSE json_extract_string(doc, '$.department') END AS department,
    CASE WHEN source NOT IN ('CRM', 'ERP') THEN json_extract_string(doc, '$.triggered_by') END AS triggered_by_user,
    CASE source WHEN 'CRM' THEN NULL WHEN 'ERP' THEN json_extract_string(doc, '$.doc.state.to') ELSE json_extract_string(doc, '$.new_state') END AS new_state,
    CASE WHEN source NOT IN ('CRM', 'ERP') THEN CAST(json_extract_string(doc, '$.metadata.k') AS BIGINT) END AS metadata_k,
    CASE source
      WHEN 'CRM' THEN make_timestamp(epoch_us(CAST(json_extract_string(doc, '$.created_date') AS TIMESTAMPTZ)))
      WHEN 'ERP' THEN make_timestamp(1000*CAST(json_extract_string(doc, '$.doc.at') AS BIGINT))
      ELSE coalesce(make_timestamp(1000000*CAST(json_extract_string(doc, '$.occurred_at') AS BIGINT)),
        CAST(replace(json_extract_string(doc, '$.occurredAt'), 'Z', '') AS TIMESTAMP)) END AS occurred_at
  FROM srcs),
judged AS (
  SELECT *, CASE
      WHEN doc IS NULL THEN 'payload: not JSON'
      WHEN source NOT IN ('CRM', 'ERP', 'Engineering Software', 'Quotation System', 'Logistics Platform', 'Manual') THEN 'sourceSystem: unknown source system'
      ELSE concat_ws('; ', CASE WHEN id = '' THEN 'id: must not be empty' END,
        CASE WHEN NOT regexp_matches(request_id, '{S.UUID_PATTERN}') THEN 'requestId: Invalid uuid' END,
        CASE WHEN event_type = '' THEN 'eventType: must not be empty' END,
        CASE WHEN occurred_at IS NULL THEN 'occurredAt: must be a valid date-time' END) END AS reasons
  FROM canon)
"""
