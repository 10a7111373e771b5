"""Ingestion of raw payloads: guard, source, signature, normalization, validation, append.

A payload is parsed once; every field is a lookup in the result. Integration settings are one row
per source system (six at most, by the enumeration), so they are turned into literal expressions
instead of being joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from stagewatch import schema as S
from stagewatch.functions.signing import PREFIX, hmac_sha256, key_blocks
from stagewatch.functions.times import instant, to_utc

TIME_FIELDS = {"occurredAt": ["occurredAt", "occurred_at"], "receivedAt": ["receivedAt", "received_at"]}
_DOC, _BAD = "_doc", "_bad"


def once(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add or replace columns that are computed once per row, whatever reads them later.

    A filter on a projected column is pushed below the projection with the whole expression copied
    into it, here dozens of payload lookups per copy. Nothing is pushed below a generator, so the
    columns come out of a one-element ``inline``.
    """
    kept = [c for c in df.columns if c not in columns]
    row = F.struct(*[value.alias(name) for name, value in columns.items()])
    return df.select(*kept, F.inline(F.array(row)))


def guard_payload_size(df: DataFrame, max_bytes: int = S.MAX_PAYLOAD_BYTES) -> DataFrame:
    """Flag payloads that are too large; ``too_large`` rows go to quarantine."""
    return df.withColumn("too_large", F.coalesce(F.octet_length("raw") > max_bytes, F.lit(False)))


def _spellings(name: str) -> list[str]:
    return TIME_FIELDS.get(name) or [name, *S.FIELD_ALIASES.get(name, [])]


def _segments(path: str) -> list[str] | None:
    """Parts of a dotted path; None for paths that are not rooted at ``$``."""
    return path[2:].split(".") if path.startswith("$.") else None


def parse(df: DataFrame, configs: DataFrame | None = None) -> DataFrame:
    """Parse the payload once, keeping only the top-level members that can matter, as VARIANT.

    These are the canonical names, their other spellings and the roots of the mapped paths. A VARIANT
    member keeps the JSON type and tells JSON null from an absent member. ``is_json`` is false for
    text that is no JSON object.
    """
    names = [s for name in S.CANONICAL_FIELDS for s in _spellings(name)]
    for row in settings(configs) if configs is not None else []:
        for path in (row["normalization_map"] or {}).values():
            names += (_segments(path) or [])[:1]
    # Column names ignore case, JSON members do not: names that clash go to a struct of their own.
    layers: list[dict[str, str]] = []
    for name in dict.fromkeys(names):
        layer = next((x for x in layers if x.get(name.lower(), name) == name), None)
        if layer is None:
            layers.append(layer := {})
        layer[name.lower()] = name
    raw = F.col("raw")
    if "too_large" in df.columns:
        raw = F.when(~F.col("too_large"), raw)
    columns = {}
    for i, layer in enumerate(layers):
        members = [f"`{n}` VARIANT" for n in layer.values()] + ([f"{_BAD} STRING"] if i == 0 else [])
        columns[f"{_DOC}{i}"] = F.from_json(raw, ", ".join(members), {"columnNameOfCorruptRecord": _BAD})
    # Also keeps the optimizer from parsing anew for every member that is read.
    parsed = once(df, columns)
    return parsed.withColumn("is_json", F.col(f"{_DOC}0").isNotNull() & F.col(f"{_DOC}0.{_BAD}").isNull())


class _Payload:
    """Lookups in the parsed payload columns of a frame."""

    def __init__(self, df: DataFrame):
        layers = [c for c in df.columns if c.startswith(_DOC)]
        self.layer = {n: c for c in layers for n in df.schema[c].dataType.names}

    def at(self, path: str) -> Column:
        """The VARIANT at a path: null when absent, a VARIANT null when it is JSON null."""
        head, *rest = _segments(path)
        node = F.col(self.layer[head]).getField(head)
        inside = "$" + "".join(f"['{part}']" for part in rest)
        return F.try_variant_get(node, inside, "variant") if rest else node

    def by_name(self, name: str) -> Column:
        """A field the payload spells itself: the first spelling present, for times the last."""
        nodes = [self.at(f"$.{s}") for s in _spellings(name)]
        return F.coalesce(*(reversed(nodes) if name in TIME_FIELDS else nodes))


def _text(node: Column) -> Column:
    return F.try_variant_get(node, "$", "string")


def _moment(node: Column, as_of: Column | None) -> Column:
    return F.when(node.isNotNull(), to_utc(_text(node), F.schema_of_variant(node), as_of))


def _convert(df: DataFrame, nodes: dict[str, Column], as_of: Column | None) -> DataFrame:
    """Columns of the given payload nodes: first which node, then once its text or time."""
    found = once(df, {f"_at_{name}": node for name, node in nodes.items()})
    values = {
        name: _moment(F.col(f"_at_{name}"), as_of) if name in TIME_FIELDS else _text(F.col(f"_at_{name}"))
        for name in nodes
    }
    return once(found, values).drop(*[f"_at_{name}" for name in nodes])


def resolve_source(df: DataFrame) -> DataFrame:
    """Source system from the payload, else the header, else Manual; and whether it is known."""
    payload = _Payload(df)
    source = F.coalesce(
        _text(payload.at("$.sourceSystem")), _text(payload.at("$.source_system")), F.col("header_source"),
        F.lit(S.DEFAULT_SOURCE),
    )
    return df.withColumn("source", source).withColumn("source_ok", F.col("source").isin(S.SOURCES))


def settings(configs: DataFrame) -> list:
    """Settings of the known sources as rows; a source that occurs twice is refused.

    Settings of other sources are left out first, and no more rows are fetched than show a source twice.
    """
    known = configs.where(F.col("source_system").isin(S.SOURCES))
    twice = known.groupBy("source_system").count().where("count > 1").select("source_system").collect()
    if twice:
        raise ValueError(f"settings given twice: {sorted(r['source_system'] for r in twice)}")
    return known.collect()


def verify_signatures(df: DataFrame, configs: DataFrame) -> DataFrame:
    """``signature_ok``: null without a signature, else whether it fits the source's secret."""
    expected = None
    for row in settings(configs):
        if not row["webhook_secret"]:
            continue
        inner, outer = (F.lit(bytearray(b)) for b in key_blocks(row["webhook_secret"]))
        test, digest = F.col("source") == row["source_system"], hmac_sha256(F.col("raw"), inner, outer)
        expected = F.when(test, digest) if expected is None else expected.when(test, digest)
    if expected is None:
        expected = F.lit(None).cast("string")
    good = F.coalesce(F.col("signature") == F.concat(F.lit(PREFIX), expected), F.lit(False))
    return df.withColumn("signature_ok", F.when(F.col("signature").isNotNull(), good))


def apply_aliases(df: DataFrame) -> DataFrame:
    """Canonical text fields of unmapped payloads, other spellings used only when absent."""
    payload = _Payload(df)
    names = [n for n in S.CANONICAL_FIELDS if n not in TIME_FIELDS and n not in ("pipelineStatus", "failedSteps")]
    return _convert(df, {n: payload.by_name(n) for n in names}, None)


def map_fields(df: DataFrame, configs: DataFrame, as_of=None) -> DataFrame:
    """Canonical fields of every payload: through the source's path map, else by name.

    Only the canonical fields are read, which also strips whatever else a source sends. Manual
    payloads are never mapped. A source with a map yields only the fields the map names. ``as_of``
    stands in for a time that is present but unusable.
    """
    payload = _Payload(df)
    names = [n for n in S.CANONICAL_FIELDS if n not in ("pipelineStatus", "failedSteps", "receivedAt")]
    maps = {
        r["source_system"]: r["normalization_map"]
        for r in settings(configs)
        if r["normalization_map"] is not None and r["source_system"] != S.DEFAULT_SOURCE
    }
    nodes = {}
    for name in names:
        node = payload.by_name(name)
        for source, paths in maps.items():
            path = next((paths[s] for s in _spellings(name) if s in paths and _segments(paths[s])), None)
            mapped = payload.at(path) if path else F.lit(None).cast("variant")
            node = F.when(F.col("source") == source, mapped).otherwise(node)
        nodes[name] = node
    return _convert(df, nodes, instant(as_of) if as_of is not None else None)


def apply_defaults(df: DataFrame, as_of=None) -> DataFrame:
    """Canonical event columns: missing names are empty text, optional ones null.

    ``as_of`` fills a missing event time; without it the time stays null and validation rejects it.
    """
    at = F.col("occurredAt") if as_of is None else F.coalesce("occurredAt", instant(as_of))
    return df.withColumns(
        {
            "id": F.coalesce("id", F.lit("")),
            "request_id": F.coalesce("requestId", F.lit("")),
            "event_type": F.coalesce("eventType", F.lit("")),
            "source_system": F.coalesce("source", F.lit(S.DEFAULT_SOURCE)),
            "department": F.col("department"),
            "triggered_by_user": F.col("triggeredByUserId"),
            "previous_state": F.col("previousState"),
            "new_state": F.col("newState"),
            "metadata": F.col("metadata"),
            "occurred_at": at,
            "pipeline_status": F.lit("pending"),
            "failed_steps": F.array().cast("array<string>"),
        }
    ).drop("requestId", "eventType", "sourceSystem", "triggeredByUserId", "previousState", "newState", "occurredAt")


def normalize(df: DataFrame, configs: DataFrame, default_missing_ts=None) -> DataFrame:
    """Parsed payloads with a resolved source to canonical events (one row per payload)."""
    mapped = map_fields(df, configs, default_missing_ts)
    return apply_defaults(mapped.drop(*[c for c in mapped.columns if c.startswith(_DOC)]), default_missing_ts)


def _errors(checks: list[tuple[Column, str]]) -> Column:
    found = F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(text)) for ok, text in checks])
    return F.filter(found, lambda e: e.isNotNull())


def validate_events(df: DataFrame) -> DataFrame:
    """Add ``errors``: what is wrong with a canonical event; empty when it is valid."""
    return df.withColumn(
        "errors",
        _errors(
            [
                (F.length("id") >= 1, "id: must not be empty"),
                (F.col("request_id").rlike(S.UUID_PATTERN), "requestId: Invalid uuid"),
                (F.length("event_type") >= 1, "eventType: must not be empty"),
                (F.col("source_system").isin(S.SOURCES), "sourceSystem: unknown source system"),
                (F.col("occurred_at").isNotNull(), "occurredAt: must be a valid date-time"),
            ]
        ),
    )


def _short(name: str, least: int = 0) -> Column:
    """Optional text within the length limit."""
    size = F.length(name)
    return F.col(name).isNull() | ((size >= least) & (size <= S.MAX_TEXT))


def validate_strict(df: DataFrame) -> DataFrame:
    """Strict contract of direct submissions: lengths, UUIDs, and a UTC time ending in Z.

    Works on text columns named like the payload fields.
    """
    optional_uuid = F.col("triggeredByUserId").isNull() | F.col("triggeredByUserId").rlike(S.UUID_PATTERN)
    return df.withColumn(
        "errors",
        _errors(
            [
                (F.length("id") >= 1, "id: Event ID is required"),
                (F.col("requestId").rlike(S.UUID_PATTERN), "requestId: Invalid request ID"),
                (F.col("eventType").isNotNull() & _short("eventType", 1), "eventType: Event type is required"),
                (F.col("sourceSystem").isin(S.SOURCES), "sourceSystem: Invalid source system"),
                (_short("department"), "department: too long"),
                (optional_uuid, "triggeredByUserId: Invalid uuid"),
                (_short("previousState"), "previousState: too long"),
                (_short("newState"), "newState: too long"),
                (F.col("occurredAt").rlike(S.ISO_UTC_PATTERN), "occurredAt: must be ISO 8601 UTC"),
            ]
        ),
    )


def validate_requests(df: DataFrame, mode: str) -> DataFrame:
    """Contract of request payloads, ``mode`` being ``create`` or ``patch``.

    For a patch the column ``fields`` lists the supplied field names: at least one, and none that
    may not be changed.
    """
    uuid = F.col("assigned_user_id").isNull() | F.col("assigned_user_id").rlike(S.UUID_PATTERN)
    checks = [
        (_short("customer_name", 1), "customerName: length"),
        (_short("customer_contact"), "customerContact: too long"),
        (_short("request_type", 1), "requestType: length"),
        (_short("assigned_department"), "assignedDepartment: too long"),
        (uuid, "assignedUserId: Invalid user ID"),
    ]
    if mode == "create":
        checks += [
            (F.col("customer_name").isNotNull(), "customerName: Required"),
            (F.col("request_type").isNotNull(), "requestType: Required"),
        ]
    else:
        locked = F.array(*[F.lit(n) for n in ("id", "request_number", "current_stage")])
        checks += [
            (_short("current_status", 1), "currentStatus: length"),
            (F.size("fields") > 0, "At least one field must be provided"),
            (~F.arrays_overlap("fields", locked), "Unrecognized key(s)"),
        ]
    return df.withColumn("errors", _errors(checks))


EVENT_COLUMNS = [f.name for f in S.TABLES["events"].fields]


def append_events(new: DataFrame, existing: DataFrame) -> DataFrame:
    """Events of ``new`` to append: the first arrival of each id that is not stored yet.

    The first arrival is an aggregate, so many copies of one id collapse before the shuffle.
    """
    rest = [c for c in new.columns if c != "id"]
    first = F.min_by(F.struct(*rest), F.struct("received_at", *[c for c in ("delivery_id",) if c in rest]))
    return (
        new.groupBy("id").agg(first.alias("_row")).select("id", "_row.*").select(*new.columns)
        .join(existing.select("id"), "id", "left_anti")
    )


def judge(raw: DataFrame, configs: DataFrame, default_missing_ts=None) -> DataFrame:
    """Canonical event of every payload with ``reasons``, empty when it is valid, and the reject code."""
    checked = verify_signatures(resolve_source(parse(guard_payload_size(raw), configs)), configs)
    events = validate_events(normalize(checked, configs, default_missing_ts))
    reason = (
        F.when(F.col("too_large"), F.array(F.lit("payload: larger than 1 MB")))
        .when(~F.col("is_json"), F.array(F.lit("payload: not JSON")))
        .when(~F.col("source_ok"), F.array(F.lit("sourceSystem: unknown source system")))
        .when(~F.coalesce("signature_ok", F.lit(True)), F.array(F.lit("signature: invalid or missing")))
        .otherwise(F.col("errors"))
    )
    code = (
        F.when(F.col("too_large"), 413)
        .when(F.coalesce("source_ok", F.lit(False)) & ~F.coalesce("signature_ok", F.lit(True)), 401)
        .otherwise(422)
    )
    return events.withColumns({"reasons": reason, "reject_code": code}).drop("errors")


def settle(judged: DataFrame, existing: DataFrame) -> DataFrame:
    """Outcome of judged payloads: accepted, duplicate or invalid, with the HTTP code.

    Of several valid payloads with one event id the first by (received_at, delivery_id) is
    accepted. The winner is found by an aggregate and matched on (id, delivery_id), so the copies
    of one id spread over all tasks.
    """
    valid = judged.where(F.size("reasons") == 0)
    first = valid.groupBy("id").agg(F.min(F.struct("received_at", "delivery_id")).alias("_first"))
    winners = first.join(existing.select("id"), "id", "left_anti").select(
        F.col("id").alias("_id"), F.col("_first.delivery_id").alias("_winner")
    )
    joined = judged.join(
        winners, (judged["id"] == winners["_id"]) & (judged["delivery_id"] == winners["_winner"]), "left"
    )
    status = (
        F.when(F.size("reasons") > 0, "invalid")
        .when(F.col("_winner").isNotNull(), "accepted")
        .otherwise("duplicate")
    )
    code = (
        F.when(F.col("status") == "accepted", 202)
        .when(F.col("status") == "duplicate", 409)
        .otherwise(F.col("reject_code"))
    )
    pipeline = F.when(F.col("status") == "invalid", "partial").otherwise("pending")
    return (
        joined.withColumn("status", status)
        .withColumns({"http_code": code, "pipeline_status": pipeline})
        .drop("_id", "_winner", "reject_code")
    )


def ingest(raw: DataFrame, configs: DataFrame, existing: DataFrame, default_missing_ts=None) -> DataFrame:
    """Outcome of every payload of the ``raw_events`` schema against the stored events."""
    return settle(judge(raw, configs, default_missing_ts), existing)


def accepted_events(outcome: DataFrame) -> DataFrame:
    """The rows of an ingest outcome that are to be stored."""
    return outcome.where(F.col("status") == "accepted").select(*EVENT_COLUMNS)


def pipeline_status(step_results: DataFrame) -> DataFrame:
    """Status per event from its step results: partial with the failed steps, complete, or pending.

    One flag pair per known step is aggregated, so nothing is collected per event.
    """
    failed = [F.bool_or((F.col("step") == s) & ~F.col("ok")).alias(f"f{i}") for i, s in enumerate(S.PIPELINE_STEPS)]
    done = [F.bool_or((F.col("step") == s) & F.col("ok")).alias(f"d{i}") for i, s in enumerate(S.PIPELINE_STEPS)]
    flags = step_results.groupBy("id").agg(*failed, *done)
    names = F.array(*[F.when(F.col(f"f{i}"), F.lit(s)) for i, s in enumerate(S.PIPELINE_STEPS)])
    every = F.lit(True)
    for i in range(len(S.PIPELINE_STEPS)):
        every = every & F.col(f"d{i}")
    return flags.select(
        "id",
        F.filter(names, lambda n: n.isNotNull()).alias("failed_steps"),
        every.alias("all_done"),
    ).select(
        "id",
        F.when(F.size("failed_steps") > 0, "partial").when(F.col("all_done"), "complete").otherwise("pending").alias("pipeline_status"),
        "failed_steps",
    )


def incremental_sync(
    source: DataFrame, configs: DataFrame, existing: DataFrame, by_mark: bool = True
) -> tuple[DataFrame, DataFrame]:
    """Pull what active sources have since their mark: (new events, sync report).

    The mark is a time of arrival, so an event that occurred long before it arrived is still pulled. Without
    ``by_mark`` every event of ``source`` is new to the caller, as in a stream whose checkpoint knows what was read.
    The report counts fetched and duplicate events per source and gives the next mark, which never goes back.
    ``source`` holds canonical events. Settings are bounded by the six source systems, hence the broadcast.
    """
    active = configs.where(F.col("is_active") & F.col("source_system").isin(S.SOURCES)).select(
        "source_system", "last_synced_at"
    )
    fetched = source.join(F.broadcast(active), "source_system")
    if by_mark:
        fetched = fetched.where(F.col("last_synced_at").isNull() | (F.col("received_at") > F.col("last_synced_at")))
    stored = existing.select(F.col("id").alias("_stored"))  # unique by the append contract
    marked = fetched.join(stored, F.col("id") == F.col("_stored"), "left")
    report = marked.groupBy("source_system").agg(
        F.count(F.lit(1)).alias("processed"),
        F.count("_stored").alias("duplicates"),
        F.max("received_at").alias("next_mark"),
    )
    marks = active.join(report, "source_system", "left").select(
        "source_system",
        F.coalesce("processed", F.lit(0)).alias("processed"),
        F.coalesce("duplicates", F.lit(0)).alias("duplicates"),
        F.greatest("next_mark", "last_synced_at").alias("last_synced_at"),
    )
    fresh = append_events(fetched.drop("last_synced_at"), existing)
    return fresh, marks


def archive_older_than(events: DataFrame, cutoff) -> DataFrame:
    """Events before the cutoff, flagged; they stay readable through ``with_archive``."""
    return events.where(F.col("occurred_at") < instant(cutoff)).withColumn("archived", F.lit(True))


def with_archive(live: DataFrame, archived: DataFrame) -> DataFrame:
    """Live and archived events as one table; an event present in both is read once."""
    cold = archived.drop("archived")
    return live.join(cold.select("id"), "id", "left_anti").unionByName(cold)
