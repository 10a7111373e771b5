"""The shared store: names, id buckets, alert buckets, generations, archive."""

from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from stagewatch import schema as S
from stagewatch.operators import analytics, ingest, lifecycle, predict, sla, timeline
from stagewatch.sources import bulk, generations, tables
from stagewatch.streaming import alerts as alert_stream, archive, ingest as stream, requests, sla_monitor, store as stores
from tests.conftest import SMALL
from tests.test_streaming import RAW, land, same

EVENTS = [f.name for f in S.TABLES["events"].fields]


@pytest.fixture(autouse=True)
def few_buckets(monkeypatch):
    monkeypatch.setattr(stores, "BUCKETS", 8)


def event_rows(n, day=1, prefix="e", occurred=None):
    at = datetime(2024, 1, day)
    return [(f"{prefix}{i}", f"r{i % 7}", "stage_change", "Manual", "Sales", None, None, "Inquiry", None, occurred or at, at + timedelta(minutes=i), "pending", None) for i in range(n)]


def events_of(spark, rows):
    return spark.createDataFrame(rows, S.TABLES["events"])


# Names


def test_jobs_of_one_store_lose_nothing(spark, tmp_path):
    """Ingest, sync and monitor, all with the default name and their own batch 0."""
    raw = bulk.raw_events(spark, SMALL).drop("id", "occurred_at").select(*RAW)
    landing = tmp_path / "raw"
    landing.mkdir()
    land(raw, landing, files=1)
    store = stream.Store(str(tmp_path / "store"))
    source = tables.read_raw_events(spark, str(landing))
    stream.start_ingest(source, bulk.configs(spark), store, str(tmp_path / "c1")).awaitTermination()
    ingested = {r.id for r in store.read(spark, "events").select("id").collect()}

    pulled = bulk.ops_events(spark, SMALL).select(*EVENTS).withColumn("id", F.concat(F.lit("s"), F.col("id")))
    pulled.coalesce(1).write.parquet(str(tmp_path / "sync"))
    files = spark.readStream.schema(S.TABLES["events"]).parquet(str(tmp_path / "sync"))
    stream.start_sync(files, bulk.configs(spark), store, str(tmp_path / "c2")).awaitTermination()
    beat = spark.createDataFrame([("e1", "r", datetime(2024, 1, 1), "Inquiry"), ("b", "beat", datetime(2024, 3, 1), "Completed")], "id string, request_id string, occurred_at timestamp, new_state string")
    beat.coalesce(1).write.parquet(str(tmp_path / "mon"))
    watched = spark.readStream.schema(beat.schema).parquet(str(tmp_path / "mon"))
    sla_monitor.start_sla_monitor(watched, bulk.rules(spark), store, str(tmp_path / "c3")).awaitTermination()

    stored = {r.id for r in store.read(spark, "events").select("id").collect()}
    assert ingested and ingested < stored and any(i.startswith("s") for i in stored)
    assert store.read(spark, "alerts").count() == 2
    with pytest.raises(ValueError, match="belongs to the checkpoint"):
        stream.start_ingest(source, bulk.configs(spark), store, str(tmp_path / "c9"))


# Ids


def test_id_index_reads_the_files_it_can_hit(spark, tmp_path):
    store = stream.Store(str(tmp_path / "store"), kind="ingest")
    for batch in range(4):
        store.write_events(events_of(spark, event_rows(300, prefix=f"b{batch}-")), batch)
    every = spark.read.parquet(store.path("event_ids")).select(F.input_file_name().alias("f")).distinct().count()
    asked = spark.createDataFrame([("b1-7",), ("b3-12",), ("new1",), ("new2",)], "id string")
    where = stores.candidate_files(spark, store, asked, 9)
    read = tables.read_batches(spark, stores.ID, store.path("event_ids"), where, keep=("stream", "batch_id"))
    files = {r.f for r in read.select(F.input_file_name().alias("f")).distinct().collect()}
    assert every == 32 and 2 <= len(files) <= 4  # the two that hold the ids, and now and then a false hit
    assert {r.id for r in stores.known_ids(spark, store, asked, 9).collect()} == {"b1-7", "b3-12"}
    # Its own earlier write is not what a replayed batch meets.
    assert {r.id for r in stores.known_ids(spark, store, asked, 3).collect()} == {"b1-7"}
    assert stores.known_ids(spark, store, spark.createDataFrame([], "id string"), 9).count() == 0


@pytest.mark.parametrize("most_files", [5000, 3])
def test_id_index_equals_the_scan(spark, tmp_path, monkeypatch, most_files):
    monkeypatch.setattr(stores, "MAX_FILES", most_files)
    store = stream.Store(str(tmp_path / "store"), kind="ingest")
    rows = event_rows(500)
    for batch in range(3):
        store.write_events(events_of(spark, rows[batch * 150 : batch * 150 + 150]), batch)
    asked = spark.createDataFrame([(r[0],) for r in rows[::3]] + [(f"x{i}",) for i in range(200)], "id string")
    for batch in (9, 1):
        scan = store.before(spark, "events", batch).select("id").join(asked, "id", "left_semi")
        assert same(stores.known_ids(spark, store, asked, batch), scan)


def test_index_of_an_older_store(spark, tmp_path):
    old, new = (stream.Store(str(tmp_path / n), kind="ingest") for n in ("old", "new"))
    rows = event_rows(120)
    for batch in range(2):
        part = events_of(spark, rows[batch * 60 : batch * 60 + 60])
        new.write_events(part, batch)
        old.write(part.withColumn("received_date", F.to_date("received_at")), "events", batch, by="received_date")
    asked = spark.createDataFrame([(f"e{i}",) for i in range(0, 200, 7)], "id string")
    assert stores.known_ids(spark, old, asked, 9).count() == 0
    stores.index_events(spark, old)
    for batch in (0, 9):
        assert same(stores.known_ids(spark, old, asked, batch), stores.known_ids(spark, new, asked, batch))


# Alerts


def command_set(spark):
    alerts = [(f"q{i}|Inquiry|Critical", f"q{i}", S.SLA_BREACH, "Critical", S.LIFECYCLE[i % 3], "m", None, datetime(2024, 1, 1), None, None, None, None, None) for i in range(12)]
    at = datetime(2024, 1, 2)
    actions = ["resolve", "acknowledge", "archive", "acknowledge", "resolve", "escalate", "archive", "resolve"]
    commands = [(f"c{i}-{k}", f"q{i}|Inquiry|Critical", a, f"u{k}", at + timedelta(minutes=(7 * k + i) % 40)) for i in range(12) for k, a in enumerate(actions)]
    commands += [("x1", "nope", "resolve", "u1", at)]
    return spark.createDataFrame(alerts, S.TABLES["alerts"]), commands


@pytest.mark.parametrize("parts", [1, 3])
def test_commands_out_of_order_equal_the_batch(spark, tmp_path, parts):
    alerts, rows = command_set(spark)
    shape = S.TABLES["alert_commands"]
    store = stream.Store(str(tmp_path / "store"))
    store.of("monitor").write_alerts(alerts, 0)
    for i in range(parts):
        batch = spark.createDataFrame(rows[::-1][i::parts], shape)
        for _ in range(1 + (i == 1)):  # one is replayed
            alert_stream.command_batch(batch, i, alert_stream.stored_alerts(spark, store), store, timedelta(hours=2))
    beat = spark.createDataFrame([("beat", "beat", "archive", None, datetime(2024, 2, 1))], shape)
    assert alert_stream.waiting_commands(spark, store).count() > 0
    alert_stream.command_batch(beat, parts, alert_stream.stored_alerts(spark, store), store, timedelta(hours=2))
    after, rejects = lifecycle.apply_transitions(alerts, spark.createDataFrame(rows, shape))
    assert same(alert_stream.current_alerts(spark, store.read(spark, "alerts"), store), after)
    assert same(spark.read.parquet(store.path("alert_rejects")).select(*rejects.columns), rejects)
    assert [r.command_id for r in alert_stream.waiting_commands(spark, store).collect()] == ["beat"]


def test_hot_alerts_fold_the_same(spark):
    alerts, rows = command_set(spark)
    commands = spark.createDataFrame(rows, S.TABLES["alert_commands"])
    plain = lifecycle.apply_transitions(alerts, commands, hot={})
    hot = lifecycle.apply_transitions(alerts, commands, hot={"q1|Inquiry|Critical": 9, "q3|Inquiry|Critical": 9, "nope": 5})
    assert all(same(a, b) for a, b in zip(plain, hot))
    states = {r.id: r.lifecycle_state for r in plain[0].collect()}
    assert set(states.values()) == {"Archived"} and plain[1].where("command_id = 'x1'").count() == 1


def test_transitions_exchange_once(spark):
    alerts, rows = command_set(spark)
    commands = spark.createDataFrame(rows, S.TABLES["alert_commands"])
    for df in lifecycle.apply_transitions(alerts, commands, hot={}):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


# Requests


def test_request_states_equal_the_batch_after_disorder(spark, tmp_path):
    rules = bulk.rules(spark).where("journey_stage <> 'Dispatch'")
    events = bulk.ops_events(spark, SMALL).select("id", "request_id", "occurred_at", "new_state", "department", "received_at")
    events = events.withColumn("new_state", F.when(F.crc32("id") % 9 == 0, None).otherwise(F.col("new_state")))
    # They arrive up to ten days late, in three files by arrival.
    late = events.withColumn("received_at", F.timestamp_micros(F.unix_micros("occurred_at") + F.crc32(F.concat("id", F.lit("x"))) % 240 * 3_600_000_000)).cache()
    cuts = [datetime(2024, 1, 1), datetime(2024, 1, 12), datetime(2024, 1, 22), datetime(2024, 3, 1)]
    for i in range(3):
        part = late.where((F.col("received_at") >= F.lit(cuts[i])) & (F.col("received_at") < F.lit(cuts[i + 1])))
        part.coalesce(1).write.parquet(str(tmp_path / f"in/p{i}"))
    beat = spark.createDataFrame([("beat", "beat", datetime(2024, 3, 1), "Completed", None, datetime(2024, 3, 1, 1))], late.schema)
    beat.coalesce(1).write.parquet(str(tmp_path / "in/p9"))
    store = stream.Store(str(tmp_path / "store"))
    source = spark.readStream.schema(late.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    requests.start_request_states(source, rules, store, str(tmp_path / "ckpt")).awaitTermination()
    got = requests.stored_requests(spark, store).where("request_id <> 'beat'")
    want = sla.request_states(late, rules, datetime(2024, 3, 1))
    assert want.where("sla_breached").count() > 10 and want.where("not sla_breached").count() > 10
    assert same(got.select(*want.columns), want)
    # Day totals took back what each change replaced: they equal a recount.
    totals = requests.day_totals(spark, store).where("day < '2024-02-15'")
    created = F.date_trunc("DAY", "created_at").alias("day")
    recount = want.groupBy(created, F.col("assigned_department").alias("department"), F.col("current_stage").alias("stage")).agg(F.count("*").alias("requests"), F.count_if("sla_breached").alias("breached"))
    assert same(totals, recount)
    assert spark.read.parquet(store.path("day_changes")).where("requests < 0").count() > 0
    start, end = datetime(2024, 1, 3), datetime(2024, 1, 20, 23, 59, 59, 999000)
    assert same(requests.trends_of(totals, start, end), analytics.trends(want, start, end))
    by = {r.department: (r.total, r.breached) for r in requests.compliance_of(totals, "department").collect()}
    assert by["Unassigned"] == (want.where("assigned_department IS NULL").count(), want.where("assigned_department IS NULL AND sla_breached").count())
    some = want.select("request_id").limit(3)
    assert same(requests.stored_requests(spark, store, some), got.join(some, "request_id", "left_semi").select(*got.columns))


def test_late_event_takes_back_a_breach():
    limits, hour = {"Inquiry": 24.0, "Approval": 24.0}, sla_monitor.HOUR
    def run(t, event, stage):
        return {"start_at": t * hour, "end_at": t * hour, "event_id": event, "journey_stage": stage, "department": None}
    def first(t, event):
        return {**run(t, event, None), "department": "Sales"}
    state, due = requests.advance({}, [first(0, "a"), run(0, "a", "Inquiry")], 0, 1000 * hour, limits)
    assert state["breach"] is None and due == 24 * hour
    state, _ = requests.advance(state, [], 30 * hour, 1000 * hour, limits)
    assert requests.shown("r", state, 1)[5:8] == [24 * hour, True, 24 * hour]
    state, due = requests.advance(state, [first(20, "b"), run(20, "b", "Approval")], 31 * hour, 1000 * hour, limits)
    assert state["breach"] is None and due == 44 * hour and requests.shown("r", state, 2)[1] == "Approval"
    state, _ = requests.advance(state, [first(10, "c"), run(10, "c", "Inquiry")], 31 * hour, 0, limits)
    assert requests.shown("r", state, 3)[1:5] == ["Approval", 20 * hour, "Sales", 0]


def test_positions_go_on_from_batch_to_batch(spark, tmp_path):
    store = stream.Store(str(tmp_path / "store"))
    step = stream.default_steps(spark, store, bulk.rules(spark))["timeline-update"]
    rows = event_rows(60)
    for batch in (0, 1, 2, 1):  # the second one is replayed
        step(events_of(spark, rows[batch * 20 : batch * 20 + 20]), batch)
    want = timeline.timeline_positions(events_of(spark, rows))
    assert same(stream.stored_timelines(spark, store), want)


def test_pages_end_to_end_are_the_listing(spark, tmp_path):
    store = stream.Store(str(tmp_path / "store"), kind="ingest")
    rows = [r for d in range(1, 8) for r in event_rows(9, d, f"d{d}-")]
    rows += event_rows(4, 7, "late-", occurred=datetime(2024, 1, 3, 12))  # arrived four days late
    for batch in range(3):
        store.write_events(events_of(spark, rows[batch::3]), batch)
    want = [(r.occurred_at, r.id) for r in store.read(spark, "events").orderBy(F.desc("occurred_at"), "id").collect()]
    got, last = [], None
    for number in range(20):
        page = stores.events_after(spark, store, 7, last)
        if number == 1:
            plan = page._jdf.queryExecution().executedPlan().toString()
            assert "received_date" in plan.split("PartitionFilters:")[1].split("]")[0]
        found = [(r.occurred_at, r.id) for r in page.collect()]
        if not found:
            break
        got += found
        last = found[-1]
    assert got == want and len(got) == 67


# Generations


def test_archive_survives_a_stop(spark, tmp_path, monkeypatch):
    store = stream.Store(str(tmp_path / "store"), kind="ingest")
    for batch, day in enumerate((1, 2, 3)):
        rows = event_rows(20, day, f"d{day}-") + event_rows(5, day, f"l{day}-", occurred=datetime(2024, 1, 2, 12))
        store.write_events(events_of(spark, rows), batch)
    every = store.read(spark, "events").select("id").collect()

    def state():
        rows = archive.all_events(spark, store).select("id", "archived").collect()
        assert sorted(r.id for r in rows) == sorted(r.id for r in every)
        return sum(r.archived for r in rows)

    assert state() == 0
    switch = generations.switch
    monkeypatch.setattr(generations, "switch", lambda *_: (_ for _ in ()).throw(RuntimeError("stopped")))
    with pytest.raises(RuntimeError):
        archive.archive_days(spark, store, datetime(2024, 1, 2), date(2024, 1, 4))
    assert state() == 0
    monkeypatch.setattr(generations, "switch", switch)
    assert archive.archive_days(spark, store, datetime(2024, 1, 2), date(2024, 1, 4), purge=False) == state() == 20
    assert archive.archive_days(spark, store, datetime(2024, 1, 2), date(2024, 1, 4), purge=False) == 0
    # A later cutoff moves the rest of a day that has a generation; purging takes the live copies away.
    assert archive.archive_days(spark, store, datetime(2024, 1, 2, 13), date(2024, 1, 4)) == 20 + 15
    assert state() == 55 and store.read(spark, "events").count() == 25
    assert archive.purge_archived(spark, store) == [] and state() == 55
    assert stores.known_ids(spark, store, spark.createDataFrame([("d1-3",)], "id string"), 9).count() == 1


def test_predictions_append_once(spark, tmp_path):
    store = stream.Store(str(tmp_path / "store"))
    assert archive.stored_predictions(spark, store).count() == 0
    now = datetime(2024, 1, 30)
    rows = predict.refresh_predictions(bulk.requests(spark, SMALL), now)
    for run in ("one", "one", "two"):
        archive.append_predictions(spark, store, rows, run)
    got = archive.stored_predictions(spark, store)
    assert got.count() == 2 * rows.count() and same(got.distinct(), rows.distinct())


def test_a_missing_table_is_empty(spark, tmp_path):
    found = tables.read_batches(spark, stores.ID, str(tmp_path / "none"), keep=("stream",))
    assert found.count() == 0 and found.columns == ["id", "stream"]


def test_settled_batch_is_replayed_alike(spark, tmp_path):
    raw = bulk.raw_events(spark, SMALL).drop("id", "occurred_at").select(*RAW)
    store = stream.Store(str(tmp_path / "store"))
    stream.ingest_batch(raw.where("pmod(crc32(delivery_id), 2) = 0"), 0, bulk.configs(spark), store)
    for _ in range(2):
        stream.ingest_batch(raw, 1, bulk.configs(spark), store)
    want = ingest.ingest(raw, bulk.configs(spark), spark.createDataFrame([], "id string")).where("status = 'accepted'")
    got = store.read(spark, "events")
    assert same(got.select("id"), want.select("id"))
