"""Registration of the checked queries: a Spark query and, where the result can be
stated in SQL, the SQL text that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.plans.report import WindowReport
from plumbline.plans.views import FEATURE_EVENTS, LABELS, PREDICTIONS, feature_events

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

NUMERIC = ("age", "purchase_amount", "session_duration", "page_views")
COLUMNS = ("event_id", "user_id", *NUMERIC, "device_type", "timestamp")


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return register


def r6(column: Column | str, name: str | None = None) -> Column:
    """Rounded to 6 places (and never -0.0), under its own or the given name."""
    value = F.col(column) if isinstance(column, str) else column
    rounded = F.round(value, 6) + F.lit(0.0)
    return rounded.alias(name or column) if name or isinstance(column, str) else rounded


def report(spark: SparkSession, sf_dir: str) -> WindowReport:
    return WindowReport(feature_events(spark, sf_dir), "w", ["event_id"], null_columns=COLUMNS)


# SQL building blocks -----------------------------------------------------------
FE = "fe AS (" + FEATURE_EVENTS.format(
    events="events", json_k="json_extract_string(props, '$.k')", millis="epoch_us(ts) // 1000"
) + ")"
PRED = "pred AS (" + PREDICTIONS.format(events="events") + ")"
LAB = "lab AS (" + LABELS.format(events="events") + ")"


def q6(expression: str) -> str:
    return f"round({expression}, 6) + 0.0e0"


PHASES = """
ph AS (
  SELECT w, n, complete_rows, before, before + CAST(complete_rows > 0 AS INT) AS after,
         CASE WHEN before < 5 THEN 'warmup' WHEN before < 10 THEN 'calibrate' ELSE 'monitoring' END AS phase
  FROM (SELECT w, n, complete_rows,
               coalesce(sum(CAST(complete_rows > 0 AS INT)) OVER (
                 ORDER BY w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
        FROM (SELECT w, count(*) AS n,
                     count(*) FILTER (WHERE age IS NOT NULL AND purchase_amount IS NOT NULL
                                      AND session_duration IS NOT NULL AND page_views IS NOT NULL) AS complete_rows
              FROM fe GROUP BY w)))
"""

LNG = "lng AS (" + " UNION ALL ".join(
    f"SELECT w, event_id, '{c}' AS feature, CAST({c} AS DOUBLE) AS value FROM fe WHERE {c} IS NOT NULL" for c in NUMERIC
) + ")"

# (feature, issue, condition, rule text, allowed text)
CHECKS = [
    ("user_id", "null_value", "user_id IS NULL", None, None),
    ("age", "null_value", "age IS NULL", None, None),
    ("age", "range_violation", "age < 0 OR age > 120", "[0, 120]", None),
    ("purchase_amount", "null_value", "purchase_amount IS NULL", None, None),
    ("purchase_amount", "range_violation", "purchase_amount < 0", "[0.0, None]", None),
    ("session_duration", "null_value", "session_duration IS NULL", None, None),
    ("session_duration", "range_violation", "session_duration < 0", "[0, None]", None),
    ("page_views", "null_value", "page_views IS NULL", None, None),
    ("page_views", "range_violation", "page_views < 0", "[0, None]", None),
    ("device_type", "null_value", "device_type IS NULL", None, None),
    (
        "device_type",
        "invalid_category",
        "device_type NOT IN ('mobile', 'desktop', 'tablet')",
        None,
        "mobile, desktop, tablet",
    ),
    ("timestamp", "null_value", '"timestamp" IS NULL', None, None),
    ("timestamp", "range_violation", '"timestamp" < 0', "[0, None]", None),
]


def _text(value: str | None) -> str:
    return "CAST(NULL AS VARCHAR)" if value is None else f"'{value}'"


ISSUES = "allchecks AS (" + " UNION ALL ".join(
    f"SELECT w, '{f}' AS feature, '{i}' AS issue_type, count(*) FILTER (WHERE {cond}) AS count, "
    f"count(*) AS total, {_text(rule)} AS rule, {_text(allowed)} AS allowed FROM fe GROUP BY w"
    for f, i, cond, rule, allowed in CHECKS
) + "), issues AS (SELECT *, count * 1.0e0 / total AS rate FROM allchecks WHERE count > 0)"

ANY_BAD = " OR ".join(f"coalesce({cond}, false)" for _, _, cond, _, _ in CHECKS)
VALIDITY = f"""
validity AS (
  SELECT t.w, t.total, coalesce(i.issue_count, 0) AS issue_count,
         greatest(0, t.total - coalesce(i.found, 0)) * 1.0e0 / t.total AS validity_rate,
         (t.total - t.bad) * 1.0e0 / t.total AS row_validity_rate
  FROM (SELECT w, count(*) AS total, count(*) FILTER (WHERE {ANY_BAD}) AS bad FROM fe GROUP BY w) t
  LEFT JOIN (SELECT w, count(*) AS issue_count, CAST(sum(count) AS BIGINT) AS found FROM issues GROUP BY w) i
  ON t.w = i.w)
"""
