"""Ordered request histories."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from stagewatch.plans.sequence import Sequence, sequence


def timeline_positions(events: DataFrame, by: str = "arrival", hot: dict | None = None, **cut) -> DataFrame:
    """Timeline entry per event: 1-based position by arrival or by time of occurrence."""
    at = "received_at" if by == "arrival" else "occurred_at"
    numbered = sequence(events, "request_id", at, "id", Sequence(position="position"), hot, **cut)
    return numbered.select(
        "request_id", F.col("id").alias("event_id"), "position", F.col("received_at").alias("appended_at")
    )


def append_timeline(events: DataFrame, timelines: DataFrame, hot: dict | None = None, **cut) -> DataFrame:
    """Timeline entries of new events: positions go on from the entries a request already has.

    An event that has its entry gets no second one.
    """
    fresh = events.join(
        timelines.select("request_id", F.col("event_id").alias("id")), ["request_id", "id"], "left_anti"
    )
    held = timelines.groupBy("request_id").agg(F.count(F.lit(1)).alias("_held"))
    entries = timeline_positions(fresh, "arrival", hot, **cut)
    return (
        entries.join(held, "request_id", "left")
        .withColumn("position", F.col("position") + F.coalesce("_held", F.lit(0)))
        .select("request_id", "event_id", "position", "appended_at")
    )


def request_timeline(events: DataFrame, timelines: DataFrame, users: DataFrame) -> DataFrame:
    """Timeline entries with event and user; the user is null unless id and e-mail are known.

    Readers order by (occurred_at, event id as text). Users grow with the data, so whether they
    are broadcast is decided by the optimizer from their size.
    """
    who = users.select(F.col("id").alias("_user"), F.col("email").alias("_email"))
    what = events.select(
        F.col("id").alias("event_id"), "event_type", "occurred_at", "department", "triggered_by_user",
        "source_system", "previous_state", "new_state", "metadata",
    )
    joined = timelines.select("request_id", "event_id", "position").join(what, "event_id")
    # Events without a user meet nobody; a key of their own keeps them from sharing one task.
    key = F.coalesce("triggered_by_user", F.concat(F.lit("\0"), "event_id"))
    user = F.when(
        F.col("_email").isNotNull(),
        F.struct(F.col("triggered_by_user").alias("id"), F.col("_email").alias("email")),
    )
    return (
        joined.join(who, key == F.col("_user"), "left")
        .withColumn("triggered_by", user)
        .drop("_user", "_email", "triggered_by_user")
    )


def timeline_of(events: DataFrame, timelines: DataFrame, users: DataFrame, request_id: str) -> DataFrame:
    """The timeline of one request in reading order."""
    one = F.col("request_id") == request_id
    entries = request_timeline(events.where(one), timelines.where(one), users)
    return entries.orderBy("occurred_at", "event_id")


def orphan_events(events: DataFrame, requests: DataFrame) -> DataFrame:
    """Events whose request does not exist."""
    return events.join(requests.select(F.col("id").alias("request_id")), "request_id", "left_anti")


def journey_path(events: DataFrame) -> DataFrame:
    """States of each request in the order first seen.

    First sightings are an aggregate per (request, state); only the distinct states of a request,
    bounded by the state vocabulary, are gathered.
    """
    first = (
        events.where(F.col("new_state").isNotNull() & (F.col("new_state") != ""))
        .groupBy("request_id", "new_state")
        .agg(F.min(F.struct("occurred_at", "id")).alias("seen"))
    )
    path = F.sort_array(F.collect_list(F.struct("seen", "new_state")))
    return first.groupBy("request_id").agg(F.transform(path, lambda p: p["new_state"]).alias("path"))


def current_stage(events: DataFrame) -> DataFrame:
    """State of each request after its last transition, and when it was entered."""
    last = F.max_by(F.struct("new_state", "occurred_at"), F.struct("occurred_at", "id"))
    return (
        events.where(F.col("new_state").isNotNull())
        .groupBy("request_id")
        .agg(last.alias("_last"))
        .select("request_id", F.col("_last.new_state").alias("current_stage"), F.col("_last.occurred_at").alias("entered_at"))
    )


def record_transitions(commands: DataFrame) -> DataFrame:
    """Event rows of audited manual transitions; the stage follows from them by ``current_stage``.

    ``commands(id, request_id, user_id, previous_state, new_state, at)``; nothing else is written, so a
    transition is either recorded whole or not at all.
    """
    event_type = F.col("event_type") if "event_type" in commands.columns else F.lit("state_transition")
    return commands.select(
        "id",
        "request_id",
        F.coalesce(event_type, F.lit("state_transition")).alias("event_type"),
        F.lit("Manual").alias("source_system"),
        F.lit(None).cast("string").alias("department"),
        F.col("user_id").alias("triggered_by_user"),
        "previous_state",
        "new_state",
        F.lit(None).cast("string").alias("metadata"),
        F.date_trunc("MILLISECOND", "at").alias("occurred_at"),
        F.date_trunc("MILLISECOND", "at").alias("received_at"),
        F.lit("complete").alias("pipeline_status"),
        F.array().cast("array<string>").alias("failed_steps"),
    )


def arrival_delay(events: DataFrame) -> DataFrame:
    """Seconds between the occurrence of an event and its arrival."""
    delay = (F.unix_micros("received_at") - F.unix_micros("occurred_at")) / F.lit(1e6)
    return events.withColumn("delay_seconds", delay)
