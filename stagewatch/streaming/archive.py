"""Moving old events to the archive, and appending predictions, so that a stopped job can simply run again.

Archived events lie by day of arrival, as live ones do. The pointer of a day carries the cutoff up to which its events
were archived: readers take events that occurred before it from the archive and leave the live copies out, so
between the copy, the switch and the purge every event is read exactly once.
"""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from stagewatch import schema as S
from stagewatch.functions.times import instant
from stagewatch.sources import generations
from stagewatch.sources.tables import read_batches
from stagewatch.streaming.store import Store

EVENTS = S.TABLES["events"]
PREDICTIONS = S.TABLES["ai_predictions"]


def _day(column: str) -> F.Column:
    return F.date_format(column, "yyyy-MM-dd")


def _live(spark: SparkSession, store: Store, held: DataFrame) -> DataFrame:
    """Live events that the archive doesn't hold, with ``piece``, their day. Days are few: a pointer each."""
    live = read_batches(spark, EVENTS, store.path("events"), keep=("received_date",)).withColumn("piece", _day("received_date"))
    kept = live.join(F.broadcast(held.select("piece", "mark")), "piece", "left")
    return kept.where(F.col("mark").isNull() | (F.col("occurred_at") >= F.col("mark"))).select(*EVENTS.names, "piece")


def archived_events(spark: SparkSession, store: Store) -> DataFrame:
    return generations.read(spark, EVENTS, store.path("archive")).drop("piece")


def all_events(spark: SparkSession, store: Store) -> DataFrame:
    """Live and archived events, each once."""
    held = generations.pointers(spark, store.path("archive"))
    return _live(spark, store, held).drop("piece").withColumn("archived", F.lit(False)).unionByName(
        generations.read(spark, EVENTS, store.path("archive"), held).drop("piece").withColumn("archived", F.lit(True))
    )


def archive_days(spark: SparkSession, store: Store, cutoff: datetime, closed_before: date | None = None, purge: bool = True) -> int:
    """Archive events that occurred before ``cutoff``; returns how many were moved.

    Only days of arrival before ``closed_before`` (by default the cutoff's day) are touched: to these nothing is added any
    more. Run again after a stop at any point, it goes on from what the pointers say.
    """
    closed = closed_before or cutoff.date()
    path = store.path("archive")
    held = generations.pointers(spark, path)
    old = _live(spark, store, held).where((F.col("piece") < F.lit(closed.isoformat())) & (F.col("occurred_at") < instant(cutoff)))
    counts = {r["piece"]: r["n"] for r in old.groupBy("piece").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a day
    if counts:
        days = F.col("piece").isin(list(counts))
        generation = generations.next_generation(spark, path)
        before = generations.read(spark, EVENTS, path, held)
        generations.copy(before.where(days).unionByName(old.where(days)), path, generation)
        moved = spark.createDataFrame([(d, cutoff) for d in counts], "piece string, mark timestamp")
        generations.switch(moved, path, generation)
    if purge:
        purge_archived(spark, store)
    return sum(counts.values())


def purge_archived(spark: SparkSession, store: Store) -> list[str]:
    """Empty the live files of which every event is archived; returns their folders. A stop in between does no harm."""
    held = generations.pointers(spark, store.path("archive")).select("piece", "mark")
    keep = ("received_date", "stream", "batch_id")
    kind = T.StructType([f for f in EVENTS.fields if f.name == "occurred_at"])
    live = read_batches(spark, kind, store.path("events"), keep=keep).withColumn("piece", _day("received_date"))
    gone = live.join(F.broadcast(held), "piece").groupBy(*keep).agg(F.max(F.col("occurred_at") - F.col("mark")).alias("_last"))
    emptied = []
    # One folder per batch and day that was moved; each gets a file without rows in place of its own.
    for r in gone.where("_last < INTERVAL '0' SECOND").select(*keep).collect():
        folder = f"{store.path('events')}/received_date={r['received_date']}/stream={r['stream']}/batch_id={r['batch_id']}"
        spark.createDataFrame([], EVENTS).coalesce(1).write.mode("overwrite").parquet(folder)
        emptied.append(folder)
    return emptied


def append_predictions(spark: SparkSession, store: Store, predictions: DataFrame, run: str) -> None:
    """Append the rows of a refresh to the prediction log; the same ``run`` again replaces its rows."""
    path = store.path("predictions")
    generation = generations.next_generation(spark, path)
    generations.copy(predictions.select(*PREDICTIONS.names).withColumn("piece", F.lit(run)), path, generation)
    generations.switch(spark.createDataFrame([(run, None)], "piece string, mark timestamp"), path, generation)


def stored_predictions(spark: SparkSession, store: Store) -> DataFrame:
    return generations.read(spark, PREDICTIONS, store.path("predictions")).drop("piece")
