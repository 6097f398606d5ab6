"""Alert candidates, hysteresis, dashboard frames and renderings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.base import FE, ISSUES, NUMERIC, VALIDITY, q6, query, r6, report
from checks.drifting import COMPLEMENTARY_PARTS, MMD_PARTS, ctes
from plumbline.functions.scalars import severity_from_mmd, severity_from_rate
from plumbline.operators import alerts, render
from plumbline.operators.validate import Validation
from plumbline.plans.report import WindowReport
from plumbline.plans.views import feature_events
from plumbline.session import scratch_path, settle
from plumbline.settings import AlertSettings
from plumbline.sources import routing

SEVERITY_RATE = "CASE WHEN rate >= 0.30 THEN 'critical' WHEN rate >= 0.15 THEN 'high' WHEN rate >= 0.05 THEN 'medium' ELSE 'low' END"
RATIO = "coalesce(mmd_score / mmd_threshold, 1.0e0)"
SEVERITY_MMD = f"CASE WHEN {RATIO} >= 3 THEN 'critical' WHEN {RATIO} >= 2 THEN 'high' WHEN {RATIO} >= 1 THEN 'medium' ELSE 'low' END"
TITLE = (
    "CASE issue_type WHEN 'null_value' THEN 'Null Value' WHEN 'range_violation' THEN 'Range Violation' "
    "WHEN 'invalid_category' THEN 'Invalid Category' END"
)
VCAND = f"""vcand AS (SELECT w, 'validation_' || issue_type || '_' || feature AS alert_key, 'validation_' || issue_type AS alert_type,
    {SEVERITY_RATE} AS severity, printf('Feature ''%s'' has %s in %d rows (%.1f%%)', feature, issue_type, count, rate * 100) AS what,
    {TITLE} || ' detected above threshold' AS why, rate AS metric_value FROM issues)"""
MCAND = f"""mcand AS (SELECT w, 'rff_mmd_drift' AS alert_key, 'rff_mmd_drift' AS alert_type, {SEVERITY_MMD} AS severity,
    printf('RFF-MMD drift score=%.6f exceeds threshold=%.6f', mmd_score, mmd_threshold) AS what,
    'Feature distribution has shifted significantly from baseline' AS why, mmd_score AS metric_value FROM sc WHERE mmd_drift)"""
DCAND = """dcand AS (SELECT w, 'drift_' || method || '_' || feature AS alert_key, 'drift_' || method AS alert_type, 'medium' AS severity,
    '[' || upper(method) || '] Feature ''' || feature || ''' distribution drift' AS what,
    upper(method) || ' test flagged significant distribution change' AS why,
    CASE WHEN method <> 'chi2' THEN nullif(statistic, 0) END AS metric_value FROM comp WHERE drifted AND NOT skipped)"""


def fold_sql(source: str, cooldown: int = 120) -> str:
    return f"""
wins AS (SELECT w, row_number() OVER (ORDER BY w) AS idx FROM (SELECT DISTINCT w FROM fe)),
steps AS (SELECT alert_key, w, idx, epoch(w + INTERVAL '1' DAY) AS ended, row_number() OVER (PARTITION BY alert_key ORDER BY idx) AS rn
          FROM {source} JOIN wins USING (w)),
fold AS (
  SELECT alert_key, w, idx, rn, 1 AS violations, false AS fired, CAST(NULL AS DOUBLE) AS fired_at FROM steps WHERE rn = 1
  UNION ALL
  SELECT alert_key, w, idx, rn, CASE WHEN fires THEN 0 ELSE n END, fires, CASE WHEN fires THEN ended ELSE fired_at END
  FROM (SELECT *, n >= 2 AND NOT coalesce(ended - fired_at < {cooldown}, false) AS fires
        FROM (SELECT s.alert_key, s.w, s.idx, s.rn, s.ended, f.fired_at,
                     CASE WHEN s.idx = f.idx + 1 THEN f.violations ELSE 0 END + 1 AS n
              FROM fold f JOIN steps s ON s.alert_key = f.alert_key AND s.rn = f.rn + 1)))"""


V_PARTS = (FE, ISSUES, VCAND)
ALL_PARTS = (FE, ISSUES, *MMD_PARTS, *COMPLEMENTARY_PARTS, VCAND, MCAND, DCAND,
             "cand AS (SELECT * FROM vcand UNION ALL SELECT * FROM mcand UNION ALL SELECT * FROM dcand)")
CAND_COLUMNS = f"w, alert_key, alert_type, severity, what, why, {q6('metric_value')} AS metric_value"
DAY_END = "date_add(w, 1)"


def _candidate_rows(found: DataFrame) -> DataFrame:
    return found.select("w", "alert_key", "alert_type", "severity", "what", "why", r6("metric_value"))


def _validation(spark: SparkSession, sf: str) -> Validation:
    return Validation(feature_events(spark, sf), ["w"])


def _validation_alerts(spark: SparkSession, sf: str, settings: AlertSettings = AlertSettings()) -> DataFrame:
    checked = _validation(spark, sf)
    found = alerts.validation_candidates(checked.issues(), "w")
    return alerts.alerts(found, checked.counts.select("w"), "w", F.expr(DAY_END), settings)


def _all_alerts(r: WindowReport) -> DataFrame:
    return alerts.alerts(r.candidates, r.phases.select("w"), "w", F.expr(DAY_END))


@query("a1_severity_from_rate", f"WITH {FE}, {ISSUES} SELECT w, feature, issue_type, {SEVERITY_RATE} AS severity FROM issues")
def _(spark, sf):
    return _validation(spark, sf).issues().select(
        "w", "feature", "issue_type", severity_from_rate(F.col("rate")).alias("severity")
    )


@query("a2_severity_from_mmd", f"WITH {ctes(*MMD_PARTS)} SELECT w, {SEVERITY_MMD} AS severity FROM sc")
def _(spark, sf):
    return report(spark, sf).scores.select(
        "w", severity_from_mmd(F.col("mmd_score"), F.col("mmd_threshold")).alias("severity")
    )


@query("a3_hysteresis", f"WITH RECURSIVE {ctes(*V_PARTS)}, {fold_sql('vcand')} SELECT alert_key, w, violations, fired FROM fold")
def _(spark, sf):
    checked = _validation(spark, sf)
    found = alerts.validation_candidates(checked.issues(), "w")
    return alerts.hysteresis(found, checked.counts.select("w"), "w", F.expr(DAY_END))


@query(
    "a4_cooldown",
    f"WITH RECURSIVE {ctes(*ALL_PARTS)}, {fold_sql('cand', 4 * 86400)} SELECT alert_key, w, violations, fired FROM fold",
)
def _(spark, sf):
    """Daily windows with a cooldown of four days."""
    r = report(spark, sf)
    settings = AlertSettings(cooldown_seconds=4 * 86400)
    return alerts.hysteresis(r.candidates, r.phases.select("w"), "w", F.expr(DAY_END), settings)


@query(
    "a5_counters",
    f"""WITH RECURSIVE {ctes(*ALL_PARTS)}, {fold_sql('cand')}
    SELECT alert_key, CASE WHEN max(w) = (SELECT max(w) FROM fe) THEN arg_max(violations, w) ELSE 0 END AS violations FROM fold GROUP BY alert_key""",
)
def _(spark, sf):
    r = report(spark, sf)
    windows = r.phases.select("w")
    return alerts.key_counters(alerts.hysteresis(r.candidates, windows, "w", F.expr(DAY_END)), windows, "w")


PAYLOAD = f"""CAST(w + INTERVAL '1' DAY AS TIMESTAMP) AS "timestamp", w, alert_type, severity, what || ' — ' || why AS message,
  what, why, {q6('metric_value')} AS metric_value"""


def _payload_rows(found: DataFrame) -> DataFrame:
    return found.select(
        F.col("timestamp").cast("timestamp_ntz").alias("timestamp"), "w", "alert_type", "severity", "message", "what", "why",
        r6("metric_value"),
    )


@query(
    "a6_payload",
    f"""WITH RECURSIVE {ctes(*V_PARTS)}, {fold_sql('vcand')}
    SELECT w, alert_type, severity, what || ' — ' || why AS message,
      coalesce('allowed=' || allowed || ';', '') || 'count=' || count || ';feature=' || feature || ';issue_type=' || issue_type || ';rate=' || round(rate, 4)
        || coalesce(';rule=' || rule, '') AS details
    FROM (SELECT v.*, i.count, i.feature, i.issue_type, i.rate, i.rule, i.allowed FROM vcand v JOIN issues i ON v.w = i.w
          AND v.alert_key = 'validation_' || i.issue_type || '_' || i.feature)
    JOIN fold USING (alert_key, w) WHERE fired""",
)
def _(spark, sf):
    entries = F.transform(
        F.array_sort(F.map_entries("details")), lambda e: F.concat(e["key"], F.lit("="), e["value"])
    )
    return _validation_alerts(spark, sf).select(
        "w", "alert_type", "severity", "message", F.array_join(entries, ";").alias("details")
    )


@query("a7_validation_alerts", f"WITH RECURSIVE {ctes(*V_PARTS)}, {fold_sql('vcand')} SELECT {PAYLOAD} FROM vcand JOIN fold USING (alert_key, w) WHERE fired")
def _(spark, sf):
    return _payload_rows(_validation_alerts(spark, sf))


@query("a8_mmd_candidates", f"WITH {ctes(*MMD_PARTS, MCAND)} SELECT {CAND_COLUMNS} FROM mcand")
def _(spark, sf):
    return _candidate_rows(alerts.mmd_candidates(report(spark, sf).scores, "w"))


@query("a9_drift_candidates", f"WITH {ctes(*COMPLEMENTARY_PARTS, DCAND)} SELECT {CAND_COLUMNS} FROM dcand")
def _(spark, sf):
    return _candidate_rows(alerts.drift_candidates(report(spark, sf).complementary, "w"))


ALL_ALERTS = f"WITH RECURSIVE {ctes(*ALL_PARTS)}, {fold_sql('cand')}, al AS (SELECT cand.* FROM cand JOIN fold USING (alert_key, w) WHERE fired)"


@query("a10_dispatch", f"{ALL_ALERTS} SELECT {PAYLOAD} FROM al")
def _(spark, sf):
    return _payload_rows(_all_alerts(report(spark, sf)))


@query(
    "a10_routed",
    f"{ALL_ALERTS} SELECT handler, w, alert_type, count(*) AS n FROM al CROSS JOIN (VALUES ('log'), ('file'), ('chat'), ('mail')) h(handler) GROUP BY handler, w, alert_type",
)
def _(spark, sf):
    """Two batches; in the second the mail handler fails at first and the batch is repeated."""
    path, found = scratch_path(spark, "routed"), settle(_all_alerts(report(spark, sf)), "alerts")
    mail, tries = routing.mail_handler(["oncall@example.com"]), []

    def write(rows: DataFrame, folder: str) -> None:
        tries.append(folder)
        if len(tries) == 2:
            raise OSError("no connection")
        mail.write(rows, folder)

    handlers = [routing.LOG, routing.FILE, routing.Handler("mail", mail.render, write), routing.CHAT]
    late = F.col("w") >= F.lit("2024-01-20").cast("date")
    routing.route(found.where(~late), path, 0, "w", handlers)
    try:
        routing.route(found.where(late), path, 1, "w", handlers)
    except routing.RoutingError:
        routing.route(found.where(late), path, 1, "w", handlers)
    rows = [
        routing.handed_over(spark, path, h.name).select(F.lit(h.name).alias("handler"), F.col("w").cast("date").alias("w"), "alert_type")
        for h in handlers
    ]
    return reduce(DataFrame.unionByName, rows).groupBy("handler", "w", "alert_type").agg(F.count(F.lit(1)).alias("n"))


@query("a11_alert_history", f"{ALL_ALERTS} SELECT alert_type, severity, count(*) AS n FROM al GROUP BY alert_type, severity")
def _(spark, sf):
    return _all_alerts(report(spark, sf)).groupBy("alert_type", "severity").agg(F.count(F.lit(1)).alias("n"))


NULL_COLUMNS = ", ".join(
    f"{q6(f'avg(CASE WHEN {c} IS NULL THEN 1.0e0 ELSE 0.0e0 END)')} AS null_rate_{c}" for c in NUMERIC
)
METRICS_PARTS = (FE, ISSUES, VALIDITY, *MMD_PARTS, f"nls AS (SELECT w, {NULL_COLUMNS} FROM fe GROUP BY w)")
METRICS_COLUMNS = (
    f"w, phase, {q6('mmd_score')} AS mmd_score, {q6('mmd_threshold')} AS mmd_threshold, mmd_drift, {q6('validity_rate')} AS validity_rate, "
    "issue_count, total AS row_count, " + ", ".join(f"null_rate_{c}" for c in NUMERIC)
)
METRICS_FROM = "FROM sc JOIN validity USING (w) JOIN nls USING (w)"


def _metrics_rows(found: DataFrame) -> DataFrame:
    return found.select(
        "w", "phase", r6("mmd_score"), r6("mmd_threshold"), "mmd_drift", r6("validity_rate"), "issue_count", "row_count",
        *[r6(f"null_rate_{c}") for c in NUMERIC],
    )


@query("a12_metrics", f"WITH {ctes(*METRICS_PARTS)} SELECT {METRICS_COLUMNS} {METRICS_FROM}")
def _(spark, sf):
    return _metrics_rows(report(spark, sf).metrics())


@query(
    "a13_latest_alerts",
    f"""{ALL_ALERTS} SELECT {PAYLOAD} FROM (SELECT * FROM al ORDER BY w DESC, alert_type, what LIMIT 50)""",
)
def _(spark, sf):
    return _payload_rows(alerts.latest_alerts(_all_alerts(report(spark, sf)), "w"))


@query(
    "a14_latest_metrics",
    f"WITH {ctes(*METRICS_PARTS)} SELECT * FROM (SELECT {METRICS_COLUMNS} {METRICS_FROM} ORDER BY w DESC LIMIT 200)",
)
def _(spark, sf):
    return _metrics_rows(alerts.latest_metrics(report(spark, sf).metrics(), "w"))


@query(
    "a15_dashboard_summary",
    f"""{ALL_ALERTS} SELECT max(w) AS last_batch, max(w) + INTERVAL '1' DAY AS last_updated,
      (SELECT count(*) FROM al) AS total_alerts FROM fe""",
)
def _(spark, sf):
    r = report(spark, sf)
    metrics = r.metrics().withColumn("at", F.expr(DAY_END).cast("timestamp_ntz"))
    return alerts.dashboard_summary(metrics, _all_alerts(r), "w", "at")


@query(
    "a16_batch_lines",
    f"""WITH {ctes(*METRICS_PARTS)} SELECT w, '[batch ' || w || '] phase=' || phase || ' mmd=' || coalesce(printf('%.5f', mmd_score), 'N/A')
      || ' threshold=' || coalesce(printf('%.5f', mmd_threshold), 'N/A') || ' val_issues=' || issue_count || ' rows=' || total AS line {METRICS_FROM}""",
)
def _(spark, sf):
    return render.batch_lines(report(spark, sf).metrics(), "w")


@query(
    "f7_score_summary",
    f"""WITH {ctes(*MMD_PARTS)} SELECT CASE WHEN w >= DATE '2024-01-20' THEN 'faulty' ELSE 'normal' END AS kind, count(*) AS windows,
      {q6('avg(mmd_score)')} AS mean, {q6('min(mmd_score)')} AS min, {q6('max(mmd_score)')} AS max,
      count(*) FILTER (WHERE mmd_score > mmd_threshold) AS flagged
    FROM sc WHERE mmd_score IS NOT NULL GROUP BY 1""",
)
def _(spark, sf):
    from plumbline.operators.stats import score_summary

    kind = F.when(F.col("w") >= F.lit("2024-01-20").cast("date"), F.lit("faulty")).otherwise(F.lit("normal"))
    found = score_summary(report(spark, sf).scores.withColumn("kind", kind), "kind", "mmd_score", "mmd_threshold")
    return found.select("kind", "windows", r6("mean"), r6("min"), r6("max"), "flagged")


# renderings -----------------------------------------------------------------------------
VALIDATION_ALERTS = f"WITH RECURSIVE {ctes(*V_PARTS)}, {fold_sql('vcand')}, al AS (SELECT vcand.*, round(metric_value, 6) AS metric FROM vcand JOIN fold USING (alert_key, w) WHERE fired)"
ISO = "strftime(w + INTERVAL '1' DAY, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00'"


@query(
    "s14_chat_message",
    f"""{VALIDATION_ALERTS} SELECT w, alert_type, what, '{{"blocks":['
      || '{{"type":"header","text":{{"type":"plain_text","text":"' || CASE severity WHEN 'low' THEN ':information_source:' WHEN 'medium' THEN ':warning:'
           WHEN 'high' THEN ':large_orange_circle:' ELSE ':red_circle:' END || ' Data Quality Alert — ' || alert_type || '"}}}},'
      || '{{"type":"section","fields":[{{"type":"mrkdwn","text":"*Severity:*\\n`' || upper(severity) || '`"}},{{"type":"mrkdwn","text":"*Batch:*\\n`' || w
      || '`"}},{{"type":"mrkdwn","text":"*What:*\\n' || what || '"}},{{"type":"mrkdwn","text":"*Why:*\\n' || why || '"}}]}},'
      || '{{"type":"section","text":{{"type":"mrkdwn","text":"*Metric value:* `' || metric || '`"}}}},'
      || '{{"type":"context","elements":[{{"type":"mrkdwn","text":"Time: ' || {ISO} || '"}}]}}]}}' AS message FROM al""",
)
def _(spark, sf):
    fired = _validation_alerts(spark, sf)
    return render.chat_messages(fired, "w", keep=["what"])


@query(
    "s15_mail",
    f"""{VALIDATION_ALERTS}, det AS (
      SELECT al.*, coalesce('  allowed: ' || i.allowed || chr(10), '') || '  count: ' || i.count || chr(10) || '  feature: ' || i.feature || chr(10)
        || '  issue_type: ' || i.issue_type || chr(10) || '  rate: ' || round(i.rate, 4) || coalesce(chr(10) || '  rule: ' || i.rule, '') AS details
      FROM al JOIN issues i ON al.w = i.w AND al.alert_key = 'validation_' || i.issue_type || '_' || i.feature)
    SELECT w, what, '[' || upper(severity) || '] Data Quality Alert — ' || alert_type || ' (batch ' || w || ')' AS subject,
      'Alert Type : ' || alert_type || chr(10) || 'Severity   : ' || upper(severity) || chr(10) || 'Batch      : ' || w || chr(10)
      || 'Time       : ' || {ISO} || chr(10) || chr(10) || 'WHAT       : ' || what || chr(10) || 'WHY        : ' || why || chr(10)
      || 'METRIC     : ' || metric || chr(10) || chr(10) || 'Details:' || chr(10) || details AS body FROM det""",
)
def _(spark, sf):
    return render.mails(_validation_alerts(spark, sf), "w", keep=["what"]).select("w", "what", "subject", "body")


@query(
    "s16_log_line",
    f"""{VALIDATION_ALERTS} SELECT w, alert_type, CASE severity WHEN 'low' THEN 'INFO' WHEN 'critical' THEN 'CRITICAL' ELSE 'WARNING' END AS level,
      '[ALERT:' || upper(severity) || '] batch=' || w || ' type=' || alert_type || ' | what=' || what || ' | why=' || why || ' | value=' || metric AS line FROM al""",
)
def _(spark, sf):
    return render.log_lines(_validation_alerts(spark, sf), "w")


