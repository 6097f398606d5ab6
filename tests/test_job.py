"""Jobs from a configuration, and the options for the reference and the calibration."""

import datetime as dt
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from plumbline.operators.phases import add_phases, window_phases
from plumbline.plans.report import WindowReport
from plumbline.plans.views import feature_events
from plumbline.schemas import EVENT
from plumbline.settings import PhaseSettings, Settings
from plumbline.sources.records import as_messages
from plumbline.sources.routing import handed_over
from plumbline.streaming.job import job_from_mapping, source_from_mapping

PHASES = {"window_batches": 1, "calibration_batches": 1}


def test_a_job_runs_from_a_mapping(spark, sf_dir, tmp_path):
    events = feature_events(spark, sf_dir).where(F.dayofmonth("ts").isin(1, 2, 21, 28))
    events = events.select(*[F.col(c).cast(EVENT[c].dataType).alias(c) for c in EVENT.names if c in events.columns], F.dayofmonth("ts").alias("day"))
    for day in (1, 2, 21, 28):
        rows = as_messages(events.where(F.col("day") == day).drop("day"), [c for c in EVENT.names if c in events.columns])
        rows.coalesce(1).write.mode("append").text(str(tmp_path / "in"))
    config = {
        "app_name": "job",
        "files": {"path": str(tmp_path / "in"), "max_files_per_trigger": 1},
        "spark": {"trigger_interval": "once", "state_location": str(tmp_path / "state"), "checkpoint_location": str(tmp_path / "cp")},
        "warmup": PHASES,
        "alerts": {"log_file": "x", "hysteresis": {"required_consecutive": 1, "cooldown_seconds": 0}},
    }
    job = job_from_mapping(spark, config)
    assert job.interval is None and [h.name for h in job.monitor.handlers] == ["log", "file"]
    job.start().awaitTermination()
    metrics = job.monitor.metrics().orderBy("batch_id").collect()
    assert [r["phase"] for r in metrics] == ["warmup", "calibrate", "monitoring", "monitoring"]
    assert all(r["row_count"] > 0 for r in metrics)
    fired = spark.read.json(job.monitor.table("alerts")).count()
    assert fired > 0
    for handler in ("log", "file"):
        assert handed_over(spark, job.monitor.table("routed"), handler).count() == fired


def test_a_configuration_needs_a_source_and_has_a_shared_home(spark, tmp_path):
    with pytest.raises(ValueError, match="neither"):
        source_from_mapping(spark, {})
    (tmp_path / "in").mkdir()
    job = job_from_mapping(spark, {"app_name": "a", "files": {"path": str(tmp_path / "in")}})
    assert job.checkpoint.endswith("/a/checkpoint") and job.interval == "30 seconds"
    assert job.checkpoint.startswith(spark.conf.get("spark.checkpoint.dir"))


def day(n):
    return dt.date(2024, 1, n)


def test_windows_under_the_validity_floor_do_not_calibrate(spark):
    rates = [0.1, 1.0, 0.2, 0.9, 0.3, 1.0, 0.2, 1.0]
    rows = spark.createDataFrame([(day(i + 1), 5, v) for i, v in enumerate(rates)], "w date, complete_rows long, validity_rate double")
    settings = PhaseSettings(warmup_windows=2, calibrate_windows=2, validity_floor=0.8)
    found = add_phases(rows, "w", settings).orderBy("w").collect()
    assert [r["phase"] for r in found] == ["warmup"] * 2 + ["calibrate"] * 4 + ["monitoring"] * 2
    assert [r["calibrates"] for r in found] == [True, True, False, True, False, True, False, True]
    assert [r["windows_after"] for r in found] == [1, 2, 2, 3, 3, 4, 4, 5]
    without = add_phases(rows, "w", replace(settings, validity_floor=None)).orderBy("w").collect()
    assert [r["phase"] for r in without] == ["warmup"] * 2 + ["calibrate"] * 2 + ["monitoring"] * 4
    with pytest.raises(ValueError):
        window_phases(rows, "w", [], settings)


def test_the_report_leaves_bad_windows_out_of_the_threshold(spark, sf_dir):
    """Day 22 and 23 hold impossible values: as calibrate windows they would raise the threshold."""
    events = feature_events(spark, sf_dir).where(F.dayofmonth("w").isin(1, 2, 22, 23, 11, 12, 13))
    order = F.when(F.dayofmonth("w") < 3, F.col("w")).when(F.dayofmonth("w") > 20, F.date_sub("w", 19)).otherwise(F.col("w"))
    events = events.withColumn("w", order)  # 1, 2, 3 (22), 4 (23), 11, 12, 13
    phases = PhaseSettings(warmup_windows=2, calibrate_windows=2, validity_floor=0.8)
    report = WindowReport(events, "w", ["event_id"], Settings(phases=phases))
    found = {r["w"].day: r for r in report.scores.collect()}
    assert [found[d]["phase"] for d in (1, 2, 3, 4, 11, 12, 13)] == ["warmup"] * 2 + ["calibrate"] * 4 + ["monitoring"]
    counted = [found[d]["mmd_score"] for d in (11, 12)]
    low, high = sorted(counted)
    assert found[13]["mmd_threshold"] == pytest.approx(low + 0.99 * (high - low))


def test_the_reference_of_a_single_window(spark, sf_dir):
    events = feature_events(spark, sf_dir).where(F.dayofmonth("w") <= 9)
    phases = PhaseSettings(warmup_windows=3, calibrate_windows=2)
    one = WindowReport(events, "w", ["event_id"], Settings(phases=phases, single_window_reference=True))
    assert [r["w"] for r in one.reference_windows.collect()] == [day(4)]
    rows = events.where(F.dayofmonth("w") == 4)
    amount = one.reference.values.groupBy("feature").agg(F.sum("n").alias("n")).collect()
    assert {r["feature"]: r["n"] for r in amount} == {f: rows.where(F.col(f).isNotNull()).count() for f in Settings().numeric}
    assert one.ks().agg(F.max("n_reference")).first()[0] == rows.count()
