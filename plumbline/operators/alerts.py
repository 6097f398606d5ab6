"""From findings to alerts: candidate texts, severity, hysteresis and cooldown.

A candidate is one violation of one key in one window. Whether it fires depends
on the earlier violations of its key, so the candidates of a key are folded in
window order. Candidates are reduced rows: at most one per key and window.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.scalars import number_text, severity_from_mmd, severity_from_rate
from plumbline.operators.drift import MMD
from plumbline.settings import AlertSettings

# Layouts of the alert texts and keys.
VALIDATION_TYPE = "validation_%s"
VALIDATION_KEY = "validation_%s_%s"
VALIDATION_WHAT = "Feature '%s' has %s in %d rows (%.1f%%)"
VALIDATION_WHY = "%s detected above threshold"
MMD_TYPE = "rff_mmd_drift"
MMD_WHAT = "RFF-MMD drift score=%.6f exceeds threshold=%.6f"
MMD_WHY = "Feature distribution has shifted significantly from baseline"
DRIFT_TYPE = "drift_%s"
DRIFT_KEY = "drift_%s_%s"
DRIFT_WHAT = "[%s] Feature '%s' distribution drift"
DRIFT_WHY = "%s test flagged significant distribution change"
MESSAGE = "%s — %s"

CANDIDATE_COLUMNS = ("alert_key", "alert_type", "severity", "what", "why", "metric_value", "details")


def text_map(**columns: Column) -> Column:
    """A map of the non-null columns as text; ``number_text`` belongs around floating-point ones."""
    entries = F.array(*[F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in columns.items()])
    return F.map_from_entries(F.filter(entries, lambda e: e["value"].isNotNull()))


def validation_candidates(issues: DataFrame, window: str) -> DataFrame:
    kind, feature, rate = F.col("issue_type"), F.col("feature"), F.col("rate")
    title = F.initcap(F.replace(kind, F.lit("_"), F.lit(" ")))
    return issues.select(
        window,
        F.format_string(VALIDATION_KEY, kind, feature).alias("alert_key"),
        F.format_string(VALIDATION_TYPE, kind).alias("alert_type"),
        severity_from_rate(rate).alias("severity"),
        F.format_string(VALIDATION_WHAT, feature, kind, F.col("count"), rate * 100).alias("what"),
        F.format_string(VALIDATION_WHY, title).alias("why"),
        rate.alias("metric_value"),
        text_map(
            feature=feature,
            issue_type=kind,
            count=F.col("count"),
            rate=number_text(F.round(rate, 4)),
            rule=F.col("rule"),
            allowed=F.array_join("allowed", ", "),
        ).alias("details"),
    )


def mmd_candidates(scores: DataFrame, window: str) -> DataFrame:
    """``scores`` has (window, mmd_score, mmd_threshold, mmd_drift, ratio)."""
    score, threshold = F.col("mmd_score"), F.col("mmd_threshold")
    return scores.where("mmd_drift").select(
        window,
        F.lit(MMD_TYPE).alias("alert_key"),
        F.lit(MMD_TYPE).alias("alert_type"),
        severity_from_mmd(score, threshold).alias("severity"),
        F.format_string(MMD_WHAT, score, threshold).alias("what"),
        F.lit(MMD_WHY).alias("why"),
        score.alias("metric_value"),
        text_map(threshold=number_text(F.round(threshold, 6)), ratio=number_text(F.round("ratio", 3))).alias("details"),
    )


def drift_candidates(report: DataFrame, window: str) -> DataFrame:
    """Candidates of the per-feature checks in the long report. The metric is the
    statistic of the method, null where it is 0 and for chi-squared."""
    method, feature = F.col("method"), F.col("feature")
    upper = F.upper(method)
    metric = F.when(method != "chi2", F.nullif(F.col("statistic"), F.lit(0.0)))
    return report.where(F.col("drifted") & ~F.col("skipped") & (method != MMD)).select(
        window,
        F.format_string(DRIFT_KEY, method, feature).alias("alert_key"),
        F.format_string(DRIFT_TYPE, method).alias("alert_type"),
        F.lit("medium").alias("severity"),
        F.format_string(DRIFT_WHAT, upper, feature).alias("what"),
        F.format_string(DRIFT_WHY, upper).alias("why"),
        metric.alias("metric_value"),
        F.map_concat(
            text_map(feature=feature, method=method, p_value=number_text(F.round("p_value", 6)), level=F.col("level")),
            F.transform_values("details", lambda _, v: number_text(F.round(v, 4))),
        ).alias("details"),
    )


def number_windows(windows: DataFrame, window: str) -> DataFrame:
    """(window, window_no): the windows in order; one row per window."""
    return windows.select(window).distinct().withColumn("window_no", F.row_number().over(Window.orderBy(window)))


def hysteresis(
    candidates: DataFrame,
    windows: DataFrame,
    window: str,
    ended_at: Column,
    settings: AlertSettings = AlertSettings(),
) -> DataFrame:
    """Add ``violations`` (the count of the key after this window) and ``fired``.

    ``windows`` lists every window, so that one without a violation is seen and
    resets the count; no row per (key, good window) is built. ``ended_at`` is the
    time of the window that the cooldown is measured on. Keys are spread over tasks,
    and a task walks its candidates in order, in time linear in their number.
    """
    numbered = candidates.join(number_windows(windows, window), window).select(
        "alert_key", window, "window_no", ended_at.cast("timestamp").cast("double").alias("at")
    )
    ordered = numbered.repartition("alert_key").sortWithinPartitions("alert_key", "window_no")
    fields = [numbered.schema["alert_key"], numbered.schema[window]]
    folded = T.StructType(
        [*fields, T.StructField("violations", T.IntegerType()), T.StructField("fired", T.BooleanType())]
    )
    return ordered.mapInArrow(_fold(window, settings), folded)


def _fold(window: str, settings: AlertSettings):
    """Walks the candidates of a partition in order with the state of one key at a time."""
    required, cooldown, resets = settings.required_consecutive, settings.cooldown_seconds, settings.reset_on_good

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: tuple = ()
        count, seen, fired_at = 0, None, None
        for batch in batches:
            keys, numbers, times = (batch.column(c).to_pylist() for c in ("alert_key", "window_no", "at"))
            violations, fired = [], []
            for key, number, at in zip(keys, numbers, times, strict=True):
                if state != (key,):
                    state, count, seen, fired_at = (key,), 0, None, None
                count = count + 1 if not resets or (seen is not None and number == seen + 1) else 1
                cooling = fired_at is not None and at - fired_at < cooldown
                fires = not cooling and count >= required
                if fires:
                    count, fired_at = 0, at
                seen = number
                violations.append(count)
                fired.append(fires)
            yield pa.RecordBatch.from_arrays(
                [batch.column("alert_key"), batch.column(window), pa.array(violations, pa.int32()), pa.array(fired, pa.bool_())],
                names=["alert_key", window, "violations", "fired"],
            )

    return run


def step_hysteresis(
    state: DataFrame, candidates: DataFrame, window_no: int, at, settings: AlertSettings = AlertSettings()
) -> DataFrame:
    """One window of the same rule, from the state after the window before it:
    (alert_key, violations, seen, fired_at, fired) of every key met so far."""
    now = F.lit(at).cast("timestamp").cast("double")
    hits = candidates.select("alert_key", F.lit(True).alias("hit")).distinct()
    joined = state.select("alert_key", "violations", "seen", "fired_at").join(hits, "alert_key", "full_outer")
    hit = F.coalesce("hit", F.lit(False))
    in_a_row = F.lit(not settings.reset_on_good) | (F.col("seen") == window_no - 1)
    count = F.when(F.coalesce(in_a_row, F.lit(False)), F.coalesce("violations", F.lit(0))).otherwise(F.lit(0)) + 1
    cooling = F.coalesce(now - F.col("fired_at") < settings.cooldown_seconds, F.lit(False))
    fires = hit & ~cooling & (count >= settings.required_consecutive)
    return joined.select(
        "alert_key",
        F.when(fires, F.lit(0)).when(hit, count).otherwise(F.col("violations")).cast("int").alias("violations"),
        F.when(hit, F.lit(window_no)).otherwise(F.col("seen")).cast("long").alias("seen"),
        F.when(fires, now).otherwise(F.col("fired_at")).alias("fired_at"),
        fires.alias("fired"),
    )


def key_counters(
    folded: DataFrame, windows: DataFrame, window: str, settings: AlertSettings = AlertSettings()
) -> DataFrame:
    """(alert_key, violations): the counters after the last window."""
    last = windows.agg(F.max(window).alias("_last")).select("_last").scalar()
    final = folded.groupBy("alert_key").agg(
        F.max(window).alias("_seen"), F.max_by("violations", window).alias("violations")
    )
    if not settings.reset_on_good:
        return final.select("alert_key", "violations")
    return final.select(
        "alert_key", F.when(F.col("_seen") == last, F.col("violations")).otherwise(F.lit(0)).alias("violations")
    )


def alerts(
    candidates: DataFrame,
    windows: DataFrame,
    window: str,
    ended_at: Column,
    settings: AlertSettings = AlertSettings(),
) -> DataFrame:
    """The alerts that fire, with the payload fields: timestamp, window, alert_type,
    severity, message, what, why, metric_value, details."""
    usable = candidates if settings.enabled else candidates.where(F.lit(False))
    fired = hysteresis(usable, windows, window, ended_at, settings).where("fired").select("alert_key", window)
    return payload(usable.join(fired, ["alert_key", window]), window, ended_at)


def payload(candidates: DataFrame, window: str, at: Column) -> DataFrame:
    return candidates.select(
        at.cast("timestamp").alias("timestamp"),
        window,
        "alert_type",
        "severity",
        F.format_string(MESSAGE, F.col("what"), F.col("why")).alias("message"),
        "what",
        "why",
        F.round("metric_value", 6).alias("metric_value"),
        "details",
    )


def latest_alerts(history: DataFrame, window: str, settings: AlertSettings = AlertSettings()) -> DataFrame:
    """The newest alerts first; ties by type and text so the cut is stable."""
    return history.orderBy(F.desc("timestamp"), F.desc(window), "alert_type", "what").limit(settings.kept_alerts)


def latest_metrics(metrics: DataFrame, window: str, settings: AlertSettings = AlertSettings()) -> DataFrame:
    """The newest metrics rows, oldest first."""
    return metrics.orderBy(F.desc(window)).limit(settings.kept_metrics).orderBy(window)


def dashboard_summary(
    metrics: DataFrame, history: DataFrame, window: str, time: str, settings: AlertSettings = AlertSettings()
) -> DataFrame:
    """One row: last_batch, last_updated, total_alerts (all of them, however many a list keeps)."""
    kept = history.agg(F.count(F.lit(1)).alias("n")).select("n").scalar()
    return metrics.agg(
        F.max_by(window, F.struct(time, window)).alias("last_batch"), F.max(time).alias("last_updated")
    ).withColumn("total_alerts", kept)
