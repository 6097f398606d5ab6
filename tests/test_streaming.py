import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from plumbline.operators import validate
from plumbline.plans.report import WindowReport
from plumbline.plans.views import feature_events
from plumbline.schemas import EVENT, LABEL, PREDICTION
from plumbline.settings import AlertSettings, PhaseSettings, Settings
from plumbline.sources import records, tables
from plumbline.streaming.monitor import StreamMonitor
from plumbline.streaming.windows import match_label_stream, with_window


def work_off(stream, path, checkpoint, mode="append"):
    run = (
        stream.writeStream.format("parquet").outputMode(mode).option("path", path)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )
    run.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def test_decode_bad_records(spark):
    texts = [
        '{"event_id":"a","age":"unknown","purchase_amount":1.5}', '{"age":34.5}', '{"age":3000000000}',
        "not json", '{"event_id":"b","age":1', "[1]", "", None, '{"event_id":"c","extra":1,"age":7}',
    ]
    raw = spark.createDataFrame([(t,) for t in texts], "value string")
    got = records.decode(raw, EVENT, corrupt_flag="corrupt").collect()
    assert got[0]["age"] is None and got[0]["purchase_amount"] == 1.5 and got[0]["event_id"] == "a"
    assert got[1]["age"] is None and got[2]["age"] is None
    assert all(got[i][c] is None for i in (3, 5, 6, 7) for c in EVENT.names)
    assert got[3]["corrupt"] and not got[8]["corrupt"] and got[8]["age"] == 7
    assert records.decode(raw).columns == EVENT.names


def test_metadata_columns(spark):
    raw = spark.createDataFrame([('{"event_id":"a"}', 7, 1, dt.datetime(2024, 1, 1))], "value string, offset long, partition int, timestamp timestamp")
    r = records.decode(raw).first()
    assert (r["event_id"], r["offset"], r["partition"], r["kafka_ts"]) == ("a", 7, 1, dt.datetime(2024, 1, 1))


def test_json_array_file(spark, tmp_path):
    events = [{"event_id": "e1", "age": 34, "timestamp": 1713139200000}, {"_comment": "x"}, {"event_id": "e2", "age": None, "device_type": "smartwatch"}]
    (tmp_path / "sample.json").write_text(json.dumps(events, indent=1))
    got = records.with_event_time(records.read_json_array(spark, str(tmp_path / "sample.json"))).collect()
    assert [r["event_id"] for r in got] == ["e1", None, "e2"]
    assert got[0]["event_ts"] == dt.datetime(2024, 4, 15) and all(got[1][c] is None for c in EVENT.names)


def test_alert_log_and_missing_tables(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = [(dt.datetime(2024, 1, 1, 0, 0, i), i, f"t{i}") for i in range(4)]
    tables.append_alert_log(spark.createDataFrame(rows, "timestamp timestamp, batch_id long, alert_type string"), path)
    spark.createDataFrame([("{oops",)], "value string").write.mode("append").text(path)
    assert [r["alert_type"] for r in tables.read_alert_log(spark, path, 2).collect()] == ["t3", "t2"]
    assert tables.read_table(spark, str(tmp_path / "none"), EVENT).count() == 0


def test_windowed_stream_equals_batch_and_drops_late_rows(spark, sf_dir, tmp_path):
    events = feature_events(spark, sf_dir).drop("w").withColumn("ts", F.col("ts").cast("timestamp"))
    source = str(tmp_path / "in")
    days = [1, 2, 3, 20]
    for day in days:  # one write after the other keeps the files in time order
        events.where(F.dayofmonth("ts") == day).coalesce(1).write.mode("append").parquet(source)
    late = events.where(F.dayofmonth("ts") == 1).limit(3)
    late.coalesce(1).write.mode("append").parquet(source)
    stream = records.file_stream(spark, source, events.schema, "parquet", maxFilesPerTrigger="1")
    windowed = with_window(stream, "ts", "1 day", delay="1 hour")
    got = work_off(validate.Validation(windowed, ["w"]).validity(), str(tmp_path / "out"), str(tmp_path / "cp"))
    batch = validate.Validation(with_window(events, "ts", "1 day"), ["w"]).validity()
    expected = {r["w"]["start"]: r["total"] for r in batch.collect()}
    closed = {r["w"]["start"]: r["total"] for r in got.collect()}
    assert {d.day for d in closed} == {1, 2, 3}
    assert all(expected[start] == total for start, total in closed.items())
    sliding = with_window(events, "ts", "2 days", "1 day")
    assert validate.Validation(sliding, ["w"]).validity().count() > batch.count()


def test_label_stream_join(spark, tmp_path):
    t = lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)
    p, lab = str(tmp_path / "p"), str(tmp_path / "l")
    ps, ls = "event_id string, ts timestamp, predicted_label int", "event_id string, label_ts timestamp, true_label int"
    for rows in ([("a", t(0), 1), ("b", t(1), 0), ("c", t(2), 1)], [("z", t(200), 1)], [("y", t(400), 1)]):
        spark.createDataFrame(rows, ps).coalesce(1).write.mode("append").parquet(p)
    for rows in ([("a", t(5), 1), ("b", t(60), 1)], [("z", t(201), 0)], [("y", t(401), 0)]):
        spark.createDataFrame(rows, ls).coalesce(1).write.mode("append").parquet(lab)
    left = spark.readStream.schema(ps).option("maxFilesPerTrigger", 1).parquet(p)
    right = spark.readStream.schema(ls).option("maxFilesPerTrigger", 1).parquet(lab)
    joined = match_label_stream(left, right, "24 hours", "1 hour", how="left_outer")
    got = {r["event_id"]: r["true_label"] for r in work_off(joined, str(tmp_path / "o"), str(tmp_path / "c")).collect()}
    # b's label is past the horizon; c never got one.
    assert {k: got[k] for k in ("a", "b", "c", "z")} == {"a": 1, "b": None, "c": None, "z": 0}


@pytest.fixture(scope="module")
def monitored(spark, sf_dir, tmp_path_factory):
    """Two warm-up, one calibrate and four monitoring days, one file per day."""
    root = tmp_path_factory.mktemp("monitor")
    days = [1, 2, 6, 11, 26, 27, 28]
    events = feature_events(spark, sf_dir).where(F.dayofmonth("ts").isin(days)).withColumn("ts", F.col("ts").cast("timestamp"))
    for day in days:
        events.where(F.dayofmonth("ts") == day).coalesce(1).write.mode("append").parquet(str(root / "in"))
    settings = Settings(phases=PhaseSettings(warmup_windows=2, calibrate_windows=1), alerts=AlertSettings(cooldown_seconds=0.0))
    stream = records.file_stream(spark, str(root / "in"), events.schema, "parquet", maxFilesPerTrigger="1")
    monitor = StreamMonitor(spark, str(root / "state"), ["event_id"], settings, event_time="ts")
    monitor.start(stream, str(root / "cp"), interval=None).awaitTermination()
    return monitor, events, settings, days


def test_monitor_phases_and_scores_equal_the_batch_report(spark, monitored):
    monitor, events, settings, days = monitored
    rows = monitor.metrics().orderBy("batch_id").collect()
    assert [r["phase"] for r in rows] == ["warmup"] * 2 + ["calibrate"] + ["monitoring"] * 4
    report = WindowReport(events.drop("ts").withColumn("w", F.col("w")), "w", ["event_id"], settings)
    expected = report.metrics().orderBy("w").collect()
    for got, want in zip(rows, expected, strict=True):
        assert got["row_count"] == want["row_count"] and got["issue_count"] == want["issue_count"]
        assert got["validity_rate"] == pytest.approx(want["validity_rate"])
        if want["mmd_score"] is None:
            assert got["mmd_score"] is None
        else:
            assert got["mmd_score"] == pytest.approx(want["mmd_score"])
    assert [r["mmd_drift"] for r in rows][-3:] == [True] * 3
    seen = spark.read.parquet(monitor.table("drift")).where("method = 'ks'").groupBy("batch").count().count()
    assert seen == 4


def test_monitor_alerts_and_repeated_batch(spark, monitored):
    monitor, events, _, days = monitored
    shown = lambda: sorted(
        (r["batch_id"], r["alert_type"], r["what"], r["timestamp"]) for r in spark.read.json(monitor.table("alerts")).collect()
    )
    first = shown()
    flags = [r["mmd_drift"] for r in monitor.metrics().orderBy("batch_id").collect()]
    count, fired = 0, []
    for batch, flag in enumerate(flags):
        count = count + 1 if flag else 0
        if count == 2:
            fired.append(batch)
            count = 0
    assert fired and sorted({b for b, t, _, _ in first if t == "rff_mmd_drift"}) == fired
    monitor.process(events.where(F.dayofmonth("ts") == days[-1]), len(days) - 1)
    assert shown() == first and monitor.metrics().count() == len(days)


def test_empty_batch_is_skipped(spark, monitored, tmp_path):
    _, events, settings, _ = monitored
    monitor = StreamMonitor(spark, str(tmp_path / "s"), ["event_id"], settings)
    monitor.process(events.limit(0), 0)
    assert monitor.metrics().count() == 0


def test_model_record_layouts(spark):
    row = spark.createDataFrame([("e", 1, 0.5, "v1", 3)], PREDICTION)
    assert records.decode(records.as_messages(row, PREDICTION.names), PREDICTION).first() == row.first()
    label = spark.createDataFrame([("e", 1, 3)], LABEL)
    assert records.decode(records.as_messages(label, LABEL.names), LABEL).first() == label.first()
