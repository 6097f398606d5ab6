import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from plumbline.functions.scalars import mmd_band, severity_from_mmd, severity_from_rate, validity_band
from plumbline.operators import alerts, render
from plumbline.settings import AlertSettings

START = dt.datetime(2024, 1, 1)


def fold(spark, flags, every=30, settings=AlertSettings(), key="k"):
    """Window number -> (violations, fired) for a list of violation flags."""
    windows = spark.createDataFrame([(i,) for i in range(len(flags))], "w int")
    bad = spark.createDataFrame([(key, i) for i, flag in enumerate(flags) if flag], "alert_key string, w int")
    at = F.timestamp_seconds(F.lit(1704067200) + F.col("w") * every)
    return {r["w"]: (r["violations"], r["fired"]) for r in alerts.hysteresis(bad, windows, "w", at, settings).collect()}


def model(flags, every, required, cooldown, reset):
    count, last, out = 0, None, {}
    for i, flag in enumerate(flags):
        if not flag:
            count = 0 if reset else count
            continue
        count += 1
        fires = not (last is not None and i * every - last < cooldown) and count >= required
        if fires:
            last, count = i * every, 0
        out[i] = (count, fires)
    return out


def fired(result):
    return [w for w, (_, fires) in sorted(result.items()) if fires]


def test_known_sequences(spark):
    assert fired(fold(spark, [1, 1, 1])) == [1]
    assert fired(fold(spark, [1, 0, 1, 1])) == [3]
    assert fired(fold(spark, [1] * 6)) == [1, 5]


def test_option_without_reset(spark):
    assert fired(fold(spark, [1, 0, 1], settings=AlertSettings(reset_on_good=False))) == [2]


@pytest.mark.parametrize("seed", range(3))
def test_fold_and_single_steps_match_a_plain_model(spark, seed):
    rng = random.Random(seed)
    flags = [rng.random() < 0.7 for _ in range(14)]
    settings = AlertSettings(required_consecutive=rng.choice([1, 2, 3]), cooldown_seconds=rng.choice([0, 60, 150]), reset_on_good=seed != 2)
    expected = model(flags, 30, settings.required_consecutive, settings.cooldown_seconds, settings.reset_on_good)
    assert fold(spark, flags, settings=settings) == expected
    state = spark.createDataFrame([], "alert_key string, violations int, seen long, fired_at double, batch long")
    for i, flag in enumerate(flags[:6]):
        hits = spark.createDataFrame([("k",)] if flag else [], "alert_key string")
        at = START + dt.timedelta(seconds=30 * i)
        rows = alerts.step_hysteresis(state, hits, i + 1, at, settings).collect()
        if flag:
            assert (rows[0]["violations"], rows[0]["fired"]) == expected[i]
        state = spark.createDataFrame(rows, "alert_key string, violations int, seen long, fired_at double, fired boolean")


def test_counters_after_the_last_window(spark):
    windows = spark.createDataFrame([(i,) for i in range(4)], "w int")
    bad = spark.createDataFrame([("a", 3), ("b", 1)], "alert_key string, w int")
    folded = alerts.hysteresis(bad, windows, "w", F.timestamp_seconds(F.col("w") * 30))
    got = {r["alert_key"]: r["violations"] for r in alerts.key_counters(folded, windows, "w").collect()}
    assert got == {"a": 1, "b": 0}


def test_severity_and_bands(spark):
    values = [(0.04, "low"), (0.05, "medium"), (0.15, "high"), (0.3, "critical")]
    df = spark.createDataFrame(values, "rate double, expected string")
    assert df.where(severity_from_rate(F.col("rate")) != F.col("expected")).count() == 0
    ratios = [(0.5, 1.0, "low"), (1.0, 1.0, "medium"), (2.0, 1.0, "high"), (3.0, 1.0, "critical"), (9.0, 0.0, "medium"), (9.0, None, "medium")]
    df = spark.createDataFrame(ratios, "s double, t double, expected string")
    assert df.where(severity_from_mmd(F.col("s"), F.col("t")) != F.col("expected")).count() == 0
    one = spark.range(1).select(
        validity_band(F.lit(0.96)).alias("a"), validity_band(F.lit(0.95)).alias("b"), validity_band(F.lit(0.8)).alias("c"),
        mmd_band(F.lit(None).cast("double"), F.lit(1.0)).alias("d"), mmd_band(F.lit(1.0), F.lit(1.0)).alias("e"),
    ).first()
    assert tuple(one) == ("ok", "warn", "crit", None, "ok")


def history(spark, n=3):
    issues = spark.createDataFrame(
        [(i, "age", "null_value", 33, 100, None, None, 0.33) for i in range(n)],
        "w int, feature string, issue_type string, count long, total long, rule string, allowed array<string>, rate double",
    )
    found = alerts.validation_candidates(issues, "w")
    at = F.timestamp_seconds(F.lit(1704067200) + F.col("w") * 30)
    return alerts.alerts(found, issues.select("w"), "w", at)


def test_payload_and_texts(spark):
    r = history(spark).first()
    assert r["what"] == "Feature 'age' has null_value in 33 rows (33.0%)"
    assert r["why"] == "Null Value detected above threshold"
    assert r["message"] == f"{r['what']} — {r['why']}"
    assert (r["severity"], r["alert_type"], r["metric_value"]) == ("critical", "validation_null_value", 0.33)
    assert r["details"] == {"feature": "age", "issue_type": "null_value", "count": "33", "rate": "0.33"}


def test_disabled_alerts(spark):
    found = spark.createDataFrame([("k", 0), ("k", 1)], "alert_key string, w int")
    for c in ("alert_type", "severity", "what", "why"):
        found = found.withColumn(c, F.lit("x"))
    found = found.withColumn("metric_value", F.lit(1.0)).withColumn("details", F.create_map(F.lit("a"), F.lit("b")))
    at = F.timestamp_seconds(F.col("w"))
    assert alerts.alerts(found, found, "w", at).count() == 1
    assert alerts.alerts(found, found, "w", at, AlertSettings(enabled=False)).count() == 0


def test_renderings(spark):
    import json

    fired_alerts = history(spark)
    message = json.loads(render.chat_messages(fired_alerts, "w").first()["message"])
    kinds = [b["type"] for b in message["blocks"]]
    assert kinds == ["header", "section", "section", "context"]
    assert message["blocks"][0]["text"]["text"] == ":red_circle: Data Quality Alert — validation_null_value"
    no_metric = render.chat_messages(fired_alerts.withColumn("metric_value", F.lit(None).cast("double")), "w").first()
    assert len(json.loads(no_metric["message"])["blocks"]) == 3
    mail = render.mails(fired_alerts, "w").first()
    assert mail["subject"] == "[CRITICAL] Data Quality Alert — validation_null_value (batch 1)"
    lines = mail["body"].split("\n")
    assert lines[0] == "Alert Type : validation_null_value" and "METRIC     : 0.33" in lines
    assert lines[lines.index("Details:") + 1] == "  count: 33"
    log = render.log_lines(fired_alerts, "w").first()
    assert log["level"] == "CRITICAL" and log["line"].startswith("[ALERT:CRITICAL] batch=1 type=validation_null_value | what=")


def test_dashboard_frames(spark):
    many = spark.range(300).select(
        F.timestamp_seconds("id").alias("timestamp"), F.col("id").alias("w"), F.lit("t").alias("alert_type"), F.lit("x").alias("what")
    )
    kept = alerts.latest_alerts(many, "w").collect()
    assert [kept[0]["w"], kept[-1]["w"], len(kept)] == [299, 250, 50]
    metrics = alerts.latest_metrics(many, "w").collect()
    assert [metrics[0]["w"], metrics[-1]["w"], len(metrics)] == [100, 299, 200]
    r = alerts.dashboard_summary(many, many, "w", "timestamp").first()
    assert (r["last_batch"], r["total_alerts"]) == (299, 300)
