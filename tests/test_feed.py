import datetime as dt

import pytest
from pyspark.sql import functions as F

from helpers import as_set
from veilframe.operators import metrics as mt
from veilframe.operators import status as st
from veilframe.sources.events import EVENT_TYPES, read_event_stream, run_batches, utc, write_event_stream
from veilframe.storage import new_path
from veilframe.streaming import rounds as sr

FEED = "ts timestamp_ntz, seq bigint, client_id string, kind string, value double"


def feed(spark, *rows):
    day = dt.datetime(2024, 1, 1)
    return spark.createDataFrame([(day + dt.timedelta(seconds=i), i, c, k, v) for i, (c, k, v) in enumerate(rows)], FEED)


def test_client_status_folds(spark):
    rows = [("a", "TRAINING", 1.0), ("b", "SENT", 2.0), (None, "reset", None), ("b", "threat_mitm", 3.0), ("a", "READY", 4.0)]
    assert as_set(st.client_status(feed(spark, *rows)), "client_id", "status", "value") == {("a", "READY", 4.0), ("b", "IDLE", 0.0)}
    everybody = [*rows, (None, "ENCRYPTING", None), ("b", "SENT", 9.0)]
    assert as_set(st.client_status(feed(spark, *everybody)), "client_id", "status") == {("a", "ENCRYPTING"), ("b", "SENT")}
    assert as_set(st.client_status(feed(spark, ("a", "TRAINING", 1.0))), "client_id", "status") == {("a", "TRAINING")}


def test_severity(spark):
    def level(*kinds):
        return st.severity(feed(spark, *[("a", k, 0.0) for k in kinds])).first()[0]

    assert level("READY") == "LOW" and level("threat_mitm", "odd") == "HIGH"
    assert level("threat_quantum", "threat_mitm") == "HIGH" and level("threat_mitm", "reset") == "LOW"


def test_last_lines(spark):
    rows = feed(spark, *[("ab"[i % 2], "READY", float(i)) for i in range(100)])
    assert as_set(st.last_n(rows), "seq") == {(i,) for i in range(60, 100)}
    assert as_set(st.last_n(rows, 2, ["client_id"]), "seq") == {(96,), (97,), (98,), (99,)}


def test_round_spans(spark):
    rows = spark.createDataFrame(
        [(dt.datetime(2024, 1, 1, 0, 0, s), r, k) for s, r, k in [(0, 1, "round_start"), (9, 1, "round_complete"), (10, 2, "round_start")]],
        "ts timestamp_ntz, round int, kind string",
    )
    assert as_set(st.rounds_from_events(rows), "round", "seconds", "status") == {(1, 9.0, "completed"), (2, None, "aborted")}


METRICS = "run string, round int, accuracy double, total_time double, training_time double, encryption_time double, aggregation_time double, communication_size_bytes bigint"


def test_comparison(spark):
    rows = [("p", 1, 0.5, 2.0, 1.0, 0.0, 0.1, 1024), ("p", 2, 0.8, 4.0, 1.0, 0.0, 0.1, 1024), ("h", 1, 0.7, 6.0, 1.0, 2.5, 0.2, 3072)]
    summary = mt.run_summary(spark.createDataFrame(rows, METRICS))
    c = mt.compare_runs(summary, "p", "h").first()
    assert c.accuracy_difference == pytest.approx(-0.1) and c.time_overhead_percentage == pytest.approx(100)
    assert c.communication_overhead_percentage == pytest.approx(50) and c.encryption_overhead_seconds == 2.5
    text = {r.metric: tuple(r)[2:] for r in mt.format_summary(summary, mt.compare_runs(summary, "p", "h"), "p", "h").collect()}
    assert text["Final Accuracy"] == ("0.8000", "0.7000", "-0.1000") and text["Avg Round Time"] == ("3.00s", "6.00s", "100.0%")
    free = spark.createDataFrame([("p", 1, 0.5, 0.0, 0.0, 0.0, 0.0, 0), rows[2]], METRICS)
    zero = mt.compare_runs(mt.run_summary(free), "p", "h").first()
    assert zero.time_overhead_percentage is None and zero.communication_overhead_percentage is None


def test_fixed_text(spark):
    values = [0.0, -0.04, -0.05, 12.345, 1e6, None]
    got = spark.createDataFrame([(v,) for v in values], "v double").select(mt.fixed_text(F.col("v"), 1)).collect()
    assert [r[0] for r in got] == ["0.0", "0.0", "-0.1", "12.3", "1000000.0", None]


# ---- streams ----


def updates(spark, *rows):
    schema = "ts timestamp, client_id string, param string, idx int, value double, num_samples bigint"
    day = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    return spark.createDataFrame([(day + dt.timedelta(days=d), c, "W", 0, v, n) for d, c, v, n in rows], schema)


def test_late_update_is_dropped_after_its_round_closed(spark):
    source, checkpoint = new_path(spark, "late"), new_path(spark, "late-check")
    closed = {}

    def keep(batch, _):
        for r in batch.collect():
            closed[r.round_start.day] = r.value

    arrivals = [
        [(0, "a", 1.0, 1), (0, "b", 5.0, 3)],
        [(3, "a", 2.0, 1)],  # closes day 0
        [(0, "c", 100.0, 50), (8, "a", 3.0, 1)],  # day 0 comes too late; day 3 closes
        [(20, "a", 4.0, 1)],
    ]
    for rows in arrivals:
        updates(spark, *rows).coalesce(1).write.mode("append").parquet(source)
        stream = read_event_stream(spark, source, updates(spark, (0, "a", 1.0, 1)).schema)
        run_batches(sr.stream_combine(stream, "1 day", "1 day"), keep, checkpoint, "append")
    assert closed == {1: 4.0, 4: 2.0, 9: 3.0}


def test_event_types_pass_through_a_file_sink(spark):
    schema = "event_id bigint, ts timestamp_ntz, event_type string, props string"
    rows = [(i, dt.datetime(2024, 1, 1), t, '{"round": %d}' % i) for i, t in enumerate(EVENT_TYPES)]
    source, out, checkpoint = (new_path(spark, n) for n in ("src", "dst", "chk"))
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(source)
    for _ in range(2):  # a second start finds nothing new
        events = read_event_stream(spark, source, schema, props="round int").withColumn("at", utc("ts"))
        write_event_stream(events.select("event_id", "event_type", "props.round", "at"), out, checkpoint).awaitTermination()
    got = spark.read.parquet(out)
    assert as_set(got, "event_id", "event_type", "round") == {(i, t, i) for i, t in enumerate(EVENT_TYPES)}
    assert got.select(F.unix_seconds("at")).first()[0] == 1704067200


def test_a_stream_with_an_interval_keeps_running(spark, tmp_path):
    from veilframe.sources import events as ev

    source, sink = tmp_path / "in", tmp_path / "out"
    spark.range(3).write.parquet(str(source))
    query = ev.write_event_stream(ev.read_event_stream(spark, str(source), "id bigint"), str(sink), str(tmp_path / "cp"), every="1 second")
    try:
        query.processAllAvailable()
        spark.range(3, 5).write.mode("append").parquet(str(source))
        query.processAllAvailable()
        assert query.isActive and spark.read.parquet(str(sink)).count() == 5
    finally:
        query.stop()
