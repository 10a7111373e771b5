"""Streams give what the batch operators give, and replays change nothing."""

import json
from datetime import datetime, timedelta

import pandas as pd
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from stagewatch import schema as S
from stagewatch.operators import ingest, lifecycle, sla
from stagewatch.sources import bulk, tables
from stagewatch.streaming import alerts as alert_stream, ingest as stream, sla_monitor, snapshots
from tests.conftest import SMALL

RAW = [f.name for f in S.TABLES["raw_events"].fields]


def land(df, path, order="received_at", files=3):
    """Write a frame as files of increasing time, the way payloads land."""
    rows = df.orderBy(order).toPandas()
    size = -(-len(rows) // files)
    for i in range(files):
        part = rows.iloc[i * size : (i + 1) * size].copy()
        for c in part.columns:
            if str(part[c].dtype).startswith("datetime"):
                part[c] = part[c].dt.strftime("%Y-%m-%dT%H:%M:%S.%fZ")
        (path / f"part-{i}.json").write_text("\n".join(json.dumps({k: v for k, v in r.items() if v is not None}) for r in part.to_dict("records")))


def same(left, right):
    return left.exceptAll(right).count() == 0 and right.exceptAll(left).count() == 0


def test_stream_ingest_equals_batch(spark, tmp_path):
    landing, root = tmp_path / "landing", str(tmp_path / "store")
    landing.mkdir()
    raw = bulk.raw_events(spark, SMALL).drop("id", "occurred_at").select(*RAW)
    land(raw, landing)
    store = stream.Store(root)
    steps = stream.default_steps(spark, store, bulk.rules(spark))
    source = tables.read_raw_events(spark, str(landing), files_per_trigger=1)
    stream.start_ingest(source, bulk.configs(spark), store, str(tmp_path / "ckpt"), steps).awaitTermination()

    expected = ingest.ingest(raw, bulk.configs(spark), spark.createDataFrame([], "id string"))
    stored = store.read(spark, "events")
    key = ["id", "request_id", "occurred_at", "received_at", "source_system"]
    assert same(stored.select(*key), ingest.accepted_events(expected).select(*key))
    quarantine = spark.read.parquet(store.path("quarantine"))
    refused = expected.where("status <> 'accepted'").select("delivery_id", "status", "http_code")
    assert same(quarantine.select("delivery_id", "status", "http_code"), refused)
    status = stream.stored_events(spark, store).groupBy("pipeline_status").count().collect()
    assert [r[0] for r in status] == ["complete"]
    entries = stream.stored_timelines(spark, store)
    places = entries.groupBy("request_id").agg(F.count("*").alias("n"), F.max("position").alias("m"), F.min("position").alias("l"))
    assert places.where("n <> m or l <> 1").count() == 0 and entries.count() == stored.count()
    assert spark.read.parquet(store.path("event_messages")).count() == stored.count()

    # The same payloads landing again add nothing.
    again = tmp_path / "again"
    again.mkdir()
    land(raw.withColumn("delivery_id", F.concat("delivery_id", F.lit("r"))), again)
    late = stream.Store(root, "second")
    source = tables.read_raw_events(spark, str(again))
    stream.start_ingest(source, bulk.configs(spark), late, str(tmp_path / "ckpt2"), within_days=60).awaitTermination()
    assert store.read(spark, "events").count() == stored.count() == stored.select("id").distinct().count()


def test_replayed_batch_replaces_itself(spark, tmp_path):
    store = stream.Store(str(tmp_path / "store"))
    raw = bulk.raw_events(spark, SMALL).drop("id", "occurred_at").select(*RAW)
    for _ in range(2):
        stream.ingest_batch(raw, 0, bulk.configs(spark), store)
    events = store.read(spark, "events")
    assert events.count() == events.select("id").distinct().count() > 0


def test_repeats_within_a_window(spark, tmp_path):
    at = datetime(2024, 1, 1)
    rows = [("a", at), ("b", at), ("a", at + timedelta(minutes=5)), ("c", at + timedelta(minutes=6))]
    events = spark.createDataFrame(rows, "id string, received_at timestamp")
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    kept = stream.drop_repeats(source, "1 hour")
    kept.writeStream.format("memory").queryName("kept").trigger(availableNow=True).start().awaitTermination()
    assert sorted(r.id for r in spark.table("kept").collect()) == ["a", "b", "c"]


def test_failing_step_is_recorded_and_the_rest_run(spark, tmp_path):
    store, calls = stream.Store(str(tmp_path / "store")), []

    def broken(batch, batch_id):
        calls.append("broken")
        raise RuntimeError("step down")

    steps = {"timeline-update": broken, "sla-evaluate": lambda b, i: calls.append("sla")}
    raw = bulk.raw_events(spark, SMALL).drop("id", "occurred_at").select(*RAW)
    stream.ingest_batch(raw, 0, bulk.configs(spark), store, steps)
    assert calls == ["broken"] * 3 + ["sla"]
    row = stream.stored_events(spark, store).first()
    assert (row.pipeline_status, row.failed_steps) == ("partial", ["timeline-update"])


def test_sync_stream_takes_each_file_once(spark, tmp_path):
    landing = tmp_path / "in"
    events = bulk.ops_events(spark, SMALL).select(*ingest.EVENT_COLUMNS)
    events.coalesce(2).write.parquet(str(landing))
    store = stream.Store(str(tmp_path / "store"), "sync")
    source = spark.readStream.schema(S.TABLES["events"]).parquet(str(landing))
    for _ in range(2):
        stream.start_sync(source, bulk.configs(spark), store, str(tmp_path / "ckpt")).awaitTermination()
    none = spark.createDataFrame([], "id string")
    fresh, report = ingest.incremental_sync(events, bulk.configs(spark), none, by_mark=False)
    assert same(store.read(spark, "events").select("id"), fresh.select("id"))
    assert spark.read.parquet(store.path("sync_reports")).agg(F.sum("processed")).first()[0] == report.agg(F.sum("processed")).first()[0]

    # The marks stand at the last arrival; an event that arrived before them in a file read later, and a bad one.
    marks = {r.source_system: r.last_synced_at for r in stream.with_marks(spark, store, bulk.configs(spark)).collect()}
    assert all(marks[r.source_system] == r.last_synced_at for r in report.collect())
    late = events.where("source_system = 'CRM'").orderBy("received_at").limit(1)
    late = late.withColumn("id", F.lit("late")).unionByName(late.withColumns({"id": F.lit("bad"), "request_id": F.lit("x")}))
    late.write.mode("append").parquet(str(landing))
    stream.start_sync(source, bulk.configs(spark), store, str(tmp_path / "ckpt")).awaitTermination()
    assert store.read(spark, "events").where("id IN ('late', 'bad')").select("id").first().id == "late"
    assert [r.id for r in spark.read.parquet(store.path("sync_quarantine")).where("id = 'bad'").collect()] == ["bad"]
    assert {r.source_system: r.last_synced_at for r in stream.with_marks(spark, store, bulk.configs(spark)).collect()} == marks


def test_sla_stream_equals_batch(spark, tmp_path):
    landing = tmp_path / "events"
    landing.mkdir()
    # Dispatch has no rule here; a last event moves the watermark past all timers.
    rules = bulk.rules(spark).where("journey_stage <> 'Dispatch'")
    events = bulk.ops_events(spark, SMALL).select("id", "request_id", "occurred_at", "new_state")
    beat = spark.createDataFrame([("beat", "beat", datetime(2024, 3, 1), "Completed")], events.schema)
    kind = events.schema
    parts = [events.where("day(occurred_at) < 11"), events.where("day(occurred_at) >= 11"), beat]
    for i, part in enumerate(parts):
        part.coalesce(1).write.parquet(str(landing / f"p{i}"))
    source = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(landing))
    fired = sla_monitor.sla_monitor_stream(source, rules, "1 hour")
    out = str(tmp_path / "out")
    fired.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "ckpt")).trigger(availableNow=True).start(out).awaitTermination()
    got = spark.read.parquet(out).select("request_id", "journey_stage", "severity")

    far = sla.sla_evaluate(sla.stage_dwell(events, datetime(2024, 3, 1)), rules)
    expected = sla.sla_alert_candidates(far).select("request_id", "journey_stage", "severity")
    warned = expected.where("severity = 'Critical'").withColumn("severity", F.lit("Warning"))
    assert same(got, expected.unionByName(warned).distinct())


def test_sla_monitor_sink(spark, tmp_path):
    rows = [("e1", "r", datetime(2024, 1, 1), "Inquiry"), ("e2", "r", datetime(2024, 1, 3), "Completed"), ("beat", "beat", datetime(2024, 3, 1), "Completed")]
    events = spark.createDataFrame(rows, "id string, request_id string, occurred_at timestamp, new_state string")
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    store = stream.Store(str(tmp_path / "store"), "monitor")
    for name in ("one", "two"):  # the second run starts over and finds its alerts stored
        source = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
        again = stream.Store(store.root, name)
        sla_monitor.start_sla_monitor(source, bulk.rules(spark), again, str(tmp_path / name)).awaitTermination()
    alerts = {(r.severity, r.created_at) for r in store.read(spark, "alerts").collect()}
    assert alerts == {("Warning", datetime(2024, 1, 1, 19, 12)), ("Critical", datetime(2024, 1, 2))}
    assert store.read(spark, "alerts").count() == spark.read.parquet(store.path("alert_messages")).count() == 2


def test_archived_alert_is_raised_again(spark, tmp_path):
    """Archive, enter the stage again: a second alert with an id and a state of its own."""
    store = stream.Store(str(tmp_path / "store"), "monitor")
    schema = "id string, request_id string, occurred_at timestamp, new_state string"
    first = [("e1", "r", datetime(2024, 1, 1), "Inquiry"), ("e2", "r", datetime(2024, 1, 3), "Sales Review"), ("t", "beat", datetime(2024, 1, 4), "Completed")]
    second = [("e3", "r", datetime(2024, 2, 1), "Inquiry"), ("e4", "r", datetime(2024, 2, 3), "Completed"), ("u", "beat", datetime(2024, 3, 1), "Completed")]

    def monitor(rows, name):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / name))
        source = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        sla_monitor.start_sla_monitor(source, bulk.rules(spark), store, str(tmp_path / "ckpt")).awaitTermination()

    def present():
        rows = alert_stream.current_alerts(spark, store.read(spark, "alerts"), store).collect()
        return {r.id: r.lifecycle_state for r in rows if "Inquiry|Critical" in r.id}

    monitor(first, "one")
    assert present() == {"r|Inquiry|Critical": "Created"}
    at = datetime(2024, 1, 5)
    plan = enumerate(("acknowledge", "resolve", "archive"))
    commands = [(f"c{i}", "r|Inquiry|Critical", action, "u1", at + timedelta(hours=i)) for i, action in plan]
    alert_stream.command_batch(spark.createDataFrame(commands, S.TABLES["alert_commands"]), 0, store.read(spark, "alerts"), stream.Store(store.root, "commands"))
    assert present() == {"r|Inquiry|Critical": "Archived"}
    monitor(second, "two")
    assert present() == {"r|Inquiry|Critical": "Archived", "r|Inquiry|Critical|2": "Created"}
    raised = store.read(spark, "alerts")
    assert raised.count() == raised.select("id").distinct().count()
    text = raised.where("id = 'r|Inquiry|Critical|2'").first()
    assert text.message == 'SLA breached for request r at stage "Inquiry". Elapsed: 24.00h / Threshold: 24h.'
    assert '"percentUsed":1.0' in text.metadata and '"elapsedHours":24.0' in text.metadata


HOURS = st.lists(st.floats(0, 400, allow_nan=False).map(lambda h: round(h, 2)), min_size=1, max_size=14)


@settings(max_examples=150, deadline=None)
@given(HOURS, st.integers(1, 5))
def test_reduced_runs_fire_like_plain_evaluation(hours, pieces):
    """Splitting, reducing and advancing in steps fires what the sorted events call for."""
    limits = {stage: float(h) for stage, h, _ in S.SLA_SEED}
    start = pd.Timestamp("2024-01-01")
    events = [(f"e{i:02d}", start + pd.Timedelta(hours=h), S.STAGES[i % 7]) for i, h in enumerate(hours)]
    pdf = pd.DataFrame([(i, "r", at, s) for i, at, s in events], columns=["id", "request_id", "occurred_at", "new_state"])
    runs = []
    for p in range(pieces):
        piece = sla_monitor.reduce_runs(pdf.iloc[p::pieces], limits)
        runs += [[int(s.value // 1000), int(e.value // 1000), i, g] for s, e, i, g in zip(piece["start_at"], piece["end_at"], piece["event_id"], piece["journey_stage"])]
    emitted, got, held = set(), set(), []
    base = int(start.value // 1000)
    for day in (0, 3, 7, 12, 60):
        mark = base + day * 24 * sla_monitor.HOUR
        # Rows arrive no later than the watermark allows: those up to the next mark, in any order.
        ready = [r for r in runs if r[1] <= mark + 5 * 24 * sla_monitor.HOUR]
        runs = [r for r in runs if r not in ready]
        alerts, held, _ = sla_monitor.watch(held + ready, emitted, mark if not runs or day == 0 else min(mark, min(r[0] for r in runs)), limits)
        got |= {(a[0], a[1]) for a in alerts}
    events.sort(key=lambda e: (e[1], e[0]))
    want = set()
    for i, (_, at, stage) in enumerate(events):
        end = events[i + 1][1] if i + 1 < len(events) else start + pd.Timedelta(days=60)
        used = (end - at) / pd.Timedelta(hours=limits[stage])
        want |= {(stage, s) for share, s in ((0.8, "Warning"), (1.0, "Critical")) if used >= share}
    assert got == want


def test_alert_commands_stream(spark, tmp_path):
    rows = [("a1", None, S.SLA_BREACH, "Critical", "Created", "m", None, datetime(2024, 1, 1), None, None, None, None, None)] + [
        (f"b{i}", None, S.SLA_BREACH, "Warning", "Created", "m", None, datetime(2024, 1, 1), None, None, None, None, None) for i in range(5)
    ]
    alerts = spark.createDataFrame(rows, S.TABLES["alerts"])
    at = datetime(2024, 1, 2)
    plan = [("acknowledge", 0), ("archive", 1), ("resolve", 2), ("archive", 3), ("resolve", 4)]
    commands = [(f"c{h}", "a1", action, "u1", at + timedelta(hours=h)) for action, h in plan] + [("x", "nope", "resolve", "u1", at), ("y", "b0", "escalate", "u1", at)]
    df = spark.createDataFrame(commands, S.TABLES["alert_commands"])
    landing = tmp_path / "commands"
    landing.mkdir()
    land(df, landing, order="at")
    store = stream.Store(str(tmp_path / "store"), "commands")
    source = spark.readStream.schema(S.TABLES["alert_commands"]).option("maxFilesPerTrigger", 1).json(str(landing))
    alert_stream.alert_state_stream(source, alerts, store, str(tmp_path / "ckpt")).awaitTermination()
    after, rejects = lifecycle.apply_transitions(alerts, df)
    assert same(alert_stream.current_alerts(spark, alerts, store), after)
    seen = spark.read.parquet(store.path("alert_rejects")).select(*rejects.columns)
    assert same(seen, rejects) and rejects.count() == 4
    assert after.where("id = 'a1'").first().lifecycle_state == "Archived"


@pytest.mark.parametrize("kind", ["Daily", "Weekly", "Monthly"])
def test_period_volumes_stream(spark, tmp_path, kind):
    requests = bulk.requests(spark, SMALL).select("id", "created_at", "sla_breached")
    beat = spark.createDataFrame([("beat", datetime(2024, 6, 1), False)], requests.schema)
    requests.coalesce(1).write.parquet(str(tmp_path / "in/a"))
    beat.coalesce(1).write.parquet(str(tmp_path / "in/b"))
    source = spark.readStream.schema(requests.schema).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    name = f"volumes_{kind}"
    mode = "append" if kind in snapshots.WINDOWS else "update"
    snapshots.period_volumes(source, kind).writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    unit = {"Daily": "DAY", "Weekly": "WEEK", "Monthly": "MONTH"}[kind]
    expected = requests.groupBy(F.date_trunc(unit, "created_at").alias("period_start")).agg(F.count("*").alias("requests"))
    got = spark.table(name).where("period_start < '2024-05-01'").select("period_start", "requests")
    assert same(got, expected)
