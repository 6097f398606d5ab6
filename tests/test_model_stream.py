"""The streaming model monitor and the label stream in which the last label wins."""

import datetime as dt
import shutil

import pytest
from pyspark.sql import functions as F

from plumbline.operators import model
from plumbline.plans.views import labels, predictions
from plumbline.settings import ModelSettings
from plumbline.streaming.model_monitor import ModelMonitor
from plumbline.streaming.windows import heartbeat, latest_label_stream

SETTINGS = ModelSettings(window_batches=1, rows_per_batch=60)


def hour(h):
    return dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)


def stream(spark, path, schema, *files):
    for rows in files:
        frame = spark.createDataFrame(rows, schema) if isinstance(rows, list) else rows
        frame.coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


PREDICTION = "event_id string, ts timestamp, predicted_label int"
LABEL = "event_id string, label_ts timestamp, true_label int"


def run_labels(spark, tmp_path, prediction_files, label_files, **options):
    schemas = [spark.createDataFrame([], s).schema for s in (PREDICTION, LABEL)]
    beats = [heartbeat(spark, s, t, hour(9000)) for s, t in zip(schemas, ("ts", "label_ts"), strict=True)]
    left = stream(spark, str(tmp_path / "p"), schemas[0], *prediction_files, beats[0], beats[0])
    right = stream(spark, str(tmp_path / "l"), schemas[1], *label_files, beats[1], beats[1])
    held = latest_label_stream(left, right, "24 hours", "1 hour", "12 hours")
    batches = []

    def keep(batch, batch_id):
        batches.append(sorted((tuple(r) for r in batch.collect()), key=str))

    run = held.writeStream.foreachBatch(keep).option("checkpointLocation", str(tmp_path / "c"))
    run = run.trigger(availableNow=True).start()
    run.awaitTermination()
    return batches, run


def test_the_last_label_wins_whatever_its_arrival(spark, tmp_path):
    prediction_files = [
        [("a", hour(1), 1), ("b", hour(2), 0), ("c", hour(3), 1), ("a", hour(1), 1)],
        [("d", hour(13), 1), ("e", hour(14), 0)],
        [("f", hour(30), 1)],
    ]
    label_files = [
        # The later label of a comes first; b has two labels of one time; c's label is past the horizon.
        [("a", hour(9), 0), ("b", hour(5), 0), ("b", hour(5), 1)],
        [("a", hour(8), 1), ("d", hour(14), 0), ("x", hour(14), 1)],
        [("c", hour(28), 1), ("d", hour(30), 1)],
    ]
    batches, _ = run_labels(spark, tmp_path, prediction_files, label_files)
    found = [row for batch in batches for row in batch]
    assert sorted((r[0], r[2], r[3], r[4]) for r in found) == [
        ("a", 1, 0, hour(9)), ("b", 0, 1, hour(5)), ("c", 1, None, None), ("d", 1, 1, hour(30)), ("e", 0, None, None), ("f", 1, None, None),
    ]
    assert {r[0]: r[1] for r in found}["a"] == hour(1)
    # A window comes out of one batch, and no batch before that of an earlier window.
    windows = [(row[1] - hour(0)) // dt.timedelta(hours=12) for batch in batches for row in batch]
    assert sum(len({(row[1] - hour(0)) // dt.timedelta(hours=12) for row in batch}) for batch in batches) == len(set(windows))
    assert max(windows[:3]) == 0


def test_state_is_bounded_by_window_and_horizon(spark, tmp_path):
    """Forty days of rows leave no more state than the last days' rows."""
    files = [[(f"{d}-{i}", hour(24 * d + i % 24), 1) for i in range(50)] for d in range(0, 40, 4)]
    labels = [[(e, t + dt.timedelta(hours=1), 0) for e, t, _ in rows] for rows in files]
    batches, run = run_labels(spark, tmp_path, files, labels)
    assert sum(map(len, batches)) == 500
    held = [max(op["numRowsTotal"] for op in p["stateOperators"]) for p in run.recentProgress if p["stateOperators"]]
    assert max(held) <= 220


@pytest.fixture(scope="module")
def tables(spark, sf_dir):
    return predictions(spark, sf_dir).cache(), labels(spark, sf_dir).cache()


def closed(tables, first, last):
    """The rows that come out of the label stream when these days have closed."""
    scored, told = tables
    return scored.where(F.dayofmonth("ts").between(first, last)).join(told, "event_id", "left")


def shown(report):
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in report.select(*sorted(report.columns)).collect()), key=str)


@pytest.mark.parametrize("cuts", [(0, 31), (0, 1, 5, 5, 20, 31), (0, 3, 28, 31)])
def test_reports_equal_the_batch_report(spark, tables, tmp_path, cuts):
    monitor = ModelMonitor(spark, str(tmp_path / "m"), settings=SETTINGS)
    for batch, (low, high) in enumerate(zip(cuts, cuts[1:])):
        monitor.process(closed(tables, low + 1, high), batch + 7)
    scored, told = tables
    expected = model.model_report(scored, told, "w", ["ts", "event_id"], SETTINGS)
    assert shown(monitor.report()) == shown(expected)


def test_repeated_batch_changes_nothing_and_lost_state_raises(spark, tables, tmp_path):
    monitor = ModelMonitor(spark, str(tmp_path / "m"), settings=SETTINGS)
    days = [(1, 4), (5, 12), (13, 20)]
    for batch, (low, high) in enumerate(days):
        monitor.process(closed(tables, low, high), batch)
    before = shown(monitor.report())
    ring = monitor.versions.table("ring")
    kept = spark.read.parquet(f"{ring}/batch=2").count()
    assert kept == SETTINGS.window_rows
    for batch in (2, 1, 2):  # as after a failure; batch 1 starts from what batch 0 left
        monitor.process(closed(tables, *days[batch]), batch)
        assert shown(monitor.report()) == before
    # A new monitor on the same folder goes on where this one stopped.
    again = ModelMonitor(spark, str(tmp_path / "m"), settings=SETTINGS)
    again.process(closed(tables, 21, 31), 3)
    scored, told = tables
    assert shown(again.report()) == shown(model.model_report(scored, told, "w", ["ts", "event_id"], SETTINGS))
    shutil.rmtree(tmp_path / "m" / "state" / "batch=3")
    with pytest.raises(RuntimeError, match="state before batch 4"):
        again.process(closed(tables, 21, 31), 4)


def test_without_labels_there_is_no_accuracy(spark, tables, tmp_path):
    monitor = ModelMonitor(spark, str(tmp_path / "m"), settings=SETTINGS)
    scored, told = tables
    for batch, (low, high) in enumerate([(1, 4), (5, 6)]):
        rows = scored.where(F.dayofmonth("ts").between(low, high)).join(told.limit(0), "event_id", "left")
        monitor.process(rows, batch)
    found = monitor.report().where("phase = 'monitoring'").collect()
    assert len(found) == 3
    assert all(r["window_size"] == 0 and r["accuracy"] is None and r["baseline_accuracy"] is None and not r["is_degraded"] for r in found)
