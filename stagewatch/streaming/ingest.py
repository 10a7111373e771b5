"""Continuous ingestion: raw payloads to stored events and the steps that follow.

Every sink writes a micro-batch as its own partition, so a batch that is replayed after a failure
replaces what it wrote before and the result is the same as if it had run once.
"""

from __future__ import annotations

import logging
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from stagewatch import schema as S
from stagewatch.operators import broadcast, ingest, sla, timeline
from stagewatch.sources.tables import read_batches
from stagewatch.streaming.store import Store, bucket_of, buckets_in, first_day, repeated_ids

ATTEMPTS = 3
PAUSE_SECONDS = 0.2  # before a failed step is tried again, doubled each time
_log = logging.getLogger(__name__)

Step = Callable[[DataFrame, int], None]


def fan_out(batch: DataFrame, batch_id: int, steps: dict[str, Step], attempts: int = ATTEMPTS) -> list[str]:
    """Run every step on the batch; a failing one is retried, then recorded, and the rest go on."""
    failed = []
    for name, step in steps.items():
        for attempt in range(1, attempts + 1):
            try:
                step(batch, batch_id)
                break
            except Exception as error:  # one step must not stop the others
                _log.warning("batch %s, step %s, attempt %s: %s: %s", batch_id, name, attempt, type(error).__name__, error)
                if attempt == attempts:
                    failed.append(name)
                else:
                    time.sleep(PAUSE_SECONDS * 2 ** (attempt - 1))
    return failed


def default_steps(spark: SparkSession, store: Store, rules: DataFrame, within_days: int | None = None) -> dict[str, Step]:
    """The five steps after storing: timeline, SLA evaluation, alerts, messages, event volumes.

    SLA evaluation looks up the latest earlier event of the batch's requests, which reads four
    columns of the store, or of its last ``within_days`` days. For short triggers on a large store
    leave the step out and run ``sla_monitor_stream``, which keeps that event in its state.
    """
    store = store.of("ingest")

    def timeline_step(batch: DataFrame, batch_id: int) -> None:
        """Entries with their positions: a request's count so far goes on, of which only its bucket is read."""
        near = buckets_in(batch, bucket_of("request_id"))
        counts = read_batches(spark, COUNT, store.path("timeline_counts"), store.earlier(batch_id) & near)
        held = counts.groupBy("request_id").agg(F.max("n").alias("_held"))
        entries = timeline.timeline_positions(batch).join(held, "request_id", "left")
        entries = entries.withColumn("position", F.col("position") + F.coalesce("_held", F.lit(0))).select(*ENTRY.names)
        store.write(entries, "timeline_entries", batch_id)
        own = read_batches(spark, ENTRY, store.path("timeline_entries"), store.mine(batch_id))
        reached = own.groupBy("request_id").agg(F.max("position").alias("n")).withColumn("bucket", bucket_of("request_id"))
        store.write(reached, "timeline_counts", batch_id, by="bucket")

    def candidates(batch: DataFrame, batch_id: int) -> DataFrame:
        """Alerts for the stages a batch ends: its events after the latest earlier one per request."""
        earlier = store.before(spark, "events", batch_id, first_day(batch, within_days)).join(
            batch.select("request_id").distinct(), "request_id", "left_semi"
        )
        latest = timeline.current_stage(earlier).select(
            F.concat(F.lit("before-"), "request_id").alias("id"), "request_id",
            F.col("current_stage").alias("new_state"), F.col("entered_at").alias("occurred_at"),
        )
        moves = batch.where(F.col("new_state").isNotNull()).select("id", "request_id", "new_state", "occurred_at")
        # Evaluated as of the last arrival, a value of the batch itself, so a replay gives the same.
        as_of = batch.agg(F.max("received_at")).first()[0]
        dwell = sla.stage_dwell(latest.unionByName(moves), F.lit(as_of).cast("timestamp"))
        found = sla.sla_alert_candidates(sla.sla_evaluate(dwell, rules))
        return sla.dedup_alerts(found, store.alerts_before(spark, batch_id, batch)).withColumn(
            "created_at", F.lit(as_of).cast("timestamp")
        )

    def sla_step(batch: DataFrame, batch_id: int) -> None:
        store.write_alerts(broadcast.create_alerts(candidates(batch, batch_id)), batch_id)

    def alert_step(batch: DataFrame, batch_id: int) -> None:
        none = spark.createDataFrame([], S.TABLES["events"])
        payloads = broadcast.broadcast_payloads(store.of_batch(spark, "alerts", batch_id), none)
        store.write(payloads, "alert_messages", batch_id)

    def broadcast_step(batch: DataFrame, batch_id: int) -> None:
        none = spark.createDataFrame([], S.TABLES["alerts"])
        store.write(broadcast.broadcast_payloads(none, batch), "event_messages", batch_id)

    def analytics_step(batch: DataFrame, batch_id: int) -> None:
        volumes = batch.groupBy(F.date_trunc("DAY", "occurred_at").alias("day"), "department").agg(
            F.count(F.lit(1)).alias("events"), F.min("occurred_at").alias("first"), F.max("occurred_at").alias("last")
        )
        store.write(volumes, "daily_volumes", batch_id)

    return dict(
        zip(S.PIPELINE_STEPS, (timeline_step, sla_step, alert_step, broadcast_step, analytics_step), strict=True)
    )


def ingest_batch(
    raw: DataFrame, batch_id: int, configs: DataFrame, store: Store, steps: dict[str, Step] | None = None,
    default_missing_ts=None, within_days: int | None = None,
) -> None:
    """Process one micro-batch: judge, settle against the store, write, run the steps.

    Duplicates are recognized for all time, by the files of the id index that the batch can hit; a
    source that repeats events only within some days can say so by ``within_days``.
    """
    spark, store = raw.sparkSession, store.of("ingest")
    judged = ingest.judge(raw, configs, default_missing_ts).persist()
    try:
        known = repeated_ids(spark, store, judged, batch_id, first_day(judged, within_days))
        outcome = ingest.settle(judged, known).persist()
        try:
            rejected = outcome.where(F.col("status") != "accepted").select(
                "delivery_id", "raw", "id", "status", "http_code", "reasons", "received_at"
            )
            store.write(rejected, "quarantine", batch_id)
            store.write_events(ingest.accepted_events(outcome), batch_id)
            # Read back: writing into the store drops cached frames that were computed from it.
            accepted = store.of_batch(spark, "events", batch_id)
            failed = fan_out(accepted, batch_id, steps or {})
            status = accepted.select(
                "id",
                F.lit("partial" if failed else "complete" if steps else "pending").alias("pipeline_status"),
                F.array(*[F.lit(f) for f in failed]).cast("array<string>").alias("failed_steps"),
            )
            store.write(status, "event_status", batch_id)
        finally:
            outcome.unpersist()
    finally:
        judged.unpersist()


def start_ingest(
    raw: DataFrame, configs: DataFrame, store: Store, checkpoint: str, steps: dict[str, Step] | None = None,
    continuous: str | None = None, default_missing_ts=None, within_days: int | None = None,
):
    """Start ingestion of a raw stream; one pass over what is there, or every ``continuous`` interval."""
    store = store.of("ingest")
    store.claim(raw.sparkSession, checkpoint)
    writer = raw.writeStream.option("checkpointLocation", checkpoint).foreachBatch(
        lambda batch, batch_id: ingest_batch(batch, batch_id, configs, store, steps, default_missing_ts, within_days)
    )
    writer = writer.trigger(processingTime=continuous) if continuous else writer.trigger(availableNow=True)
    return writer.start()


STATUS = T.StructType(
    [T.StructField("id", T.StringType()), T.StructField("pipeline_status", T.StringType()),
     T.StructField("failed_steps", T.ArrayType(T.StringType()))]
)
ENTRY = T.StructType(
    [T.StructField("request_id", T.StringType()), T.StructField("event_id", T.StringType()),
     T.StructField("position", T.LongType()), T.StructField("appended_at", T.TimestampType())]
)
COUNT = T.StructType([T.StructField("request_id", T.StringType()), T.StructField("n", T.LongType())])


def stored_events(spark: SparkSession, store: Store) -> DataFrame:
    """Stored events with the status their steps ended in."""
    status = read_batches(spark, STATUS, store.path("event_status"))
    return store.read(spark, "events").drop("pipeline_status", "failed_steps").join(status, "id", "left")


def stored_timelines(spark: SparkSession, store: Store) -> DataFrame:
    """Timeline entries with the positions they got on arrival, batch after batch."""
    return read_batches(spark, ENTRY, store.path("timeline_entries"))


def drop_repeats(events: DataFrame, within: str) -> DataFrame:
    """A stream of events without repeats of an id that arrive within the given time."""
    return events.withWatermark("received_at", within).dropDuplicatesWithinWatermark(["id"])


REPORT = T.StructType(
    [T.StructField("source_system", T.StringType()), T.StructField("processed", T.LongType()),
     T.StructField("duplicates", T.LongType()), T.StructField("last_synced_at", T.TimestampType())]
)


def with_marks(spark: SparkSession, store: Store, configs: DataFrame, before: int | None = None) -> DataFrame:
    """The settings with the marks that the reports of the store have reached, or had before a batch."""
    where = None if before is None else ~store.mine(before)
    reports = read_batches(spark, REPORT, store.path("sync_reports"), where)
    marks = reports.groupBy("source_system").agg(F.max("last_synced_at").alias("_mark"))
    joined = configs.join(F.broadcast(marks.where(F.col("source_system").isin(S.SOURCES))), "source_system", "left")
    return joined.withColumn("last_synced_at", F.greatest("last_synced_at", "_mark")).select(*configs.columns)


def start_sync(source: DataFrame, configs: DataFrame, store: Store, checkpoint: str):
    """Incremental pull of canonical events from active sources; each run takes only what is new.

    The checkpoint remembers the files taken, so events that arrive late are taken too; events that are stored
    already count as success, invalid ones go to ``sync_quarantine``. Marks advance on storage: see ``with_marks``.
    """
    store = store.of("sync")
    store.claim(source.sparkSession, checkpoint)

    def pull(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        batch = batch.persist()
        try:
            checked = ingest.validate_events(batch)
            valid = checked.where(F.size("errors") == 0).drop("errors")
            known = repeated_ids(spark, store, valid, batch_id)
            marked = with_marks(spark, store, configs, before=batch_id)
            fresh, report = ingest.incremental_sync(valid, marked, known, by_mark=False)
            store.write(checked.where(F.size("errors") > 0), "sync_quarantine", batch_id)
            store.write_events(fresh.select(*ingest.EVENT_COLUMNS), batch_id)
            store.write(report, "sync_reports", batch_id)
        finally:
            batch.unpersist()

    return source.writeStream.option("checkpointLocation", checkpoint).foreachBatch(pull).trigger(availableNow=True).start()
