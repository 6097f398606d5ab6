"""Alert and batch texts for log lines, chat messages and e-mails."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.scalars import number_text

# Log levels and emoji of the severities, and the text layouts.
LOG_LEVELS = {"low": "INFO", "medium": "WARNING", "high": "WARNING", "critical": "CRITICAL"}
EMOJI = {
    "low": ":information_source:",
    "medium": ":warning:",
    "high": ":large_orange_circle:",
    "critical": ":red_circle:",
}
OTHER_LEVEL = "WARNING"
OTHER_EMOJI = ":bell:"
LOG_LINE = "[ALERT:%s] batch=%s type=%s | what=%s | why=%s | value=%s"
CHAT_HEADER = "%s Data Quality Alert — %s"
MAIL_SUBJECT = "[%s] Data Quality Alert — %s (batch %s)"
MAIL_LINES = (
    "Alert Type : %s",
    "Severity   : %s",
    "Batch      : %s",
    "Time       : %s",
    "",
    "WHAT       : %s",
    "WHY        : %s",
)
MAIL_METRIC = "METRIC     : %s"
MAIL_DETAILS = "Details:"
MAIL_DETAIL = "  %s: %s"
BATCH_LINE = "[batch %s] phase=%s mmd=%s threshold=%s val_issues=%d rows=%d"
ISO_TIME = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx"


def _mapped(key: Column, table: dict[str, str], otherwise: str) -> Column:
    cases = [F.when(key == name, F.lit(text)) for name, text in table.items()]
    return F.coalesce(*cases, F.lit(otherwise))


def iso_time(at: Column) -> Column:
    return F.date_format(at, ISO_TIME)


def value_text(value: Column) -> Column:
    return F.coalesce(number_text(value), F.lit("None"))


def log_lines(history: DataFrame, window: str) -> DataFrame:
    """(window, alert_type, level, line)."""
    severity = F.col("severity")
    line = F.format_string(
        LOG_LINE,
        F.upper(severity),
        F.col(window).cast("string"),
        F.col("alert_type"),
        F.col("what"),
        F.col("why"),
        value_text(F.col("metric_value")),
    )
    return history.select(window, "alert_type", _mapped(severity, LOG_LEVELS, OTHER_LEVEL).alias("level"), line.alias("line"))


def _markdown(label: str, text: Column) -> Column:
    return F.struct(F.lit("mrkdwn").alias("type"), F.concat(F.lit(f"*{label}:*\n"), text).alias("text"))


def chat_messages(history: DataFrame, window: str, keep: Sequence[str] = ()) -> DataFrame:
    """(window, alert_type, kept columns, message): the blocks of a chat message as JSON."""
    severity = F.col("severity")
    quoted = lambda text: F.concat(F.lit("`"), text, F.lit("`"))
    header = F.struct(
        F.lit("header").alias("type"),
        F.struct(
            F.lit("plain_text").alias("type"),
            F.format_string(CHAT_HEADER, _mapped(severity, EMOJI, OTHER_EMOJI), F.col("alert_type")).alias("text"),
        ).alias("text"),
    )
    section = F.struct(
        F.lit("section").alias("type"),
        F.array(
            _markdown("Severity", quoted(F.upper(severity))),
            _markdown("Batch", quoted(F.col(window).cast("string"))),
            _markdown("What", F.col("what")),
            _markdown("Why", F.col("why")),
        ).alias("fields"),
    )
    metric = F.struct(
        F.lit("section").alias("type"),
        F.struct(
            F.lit("mrkdwn").alias("type"),
            F.concat(F.lit("*Metric value:* `"), number_text(F.col("metric_value")), F.lit("`")).alias("text"),
        ).alias("text"),
    )
    context = F.struct(
        F.lit("context").alias("type"),
        F.array(
            F.struct(
                F.lit("mrkdwn").alias("type"), F.concat(F.lit("Time: "), iso_time(F.col("timestamp"))).alias("text")
            )
        ).alias("elements"),
    )
    # Blocks differ in layout, so each becomes JSON text before they are joined.
    blocks = F.array(
        F.to_json(header),
        F.to_json(section),
        F.when(F.col("metric_value").isNotNull(), F.to_json(metric)),
        F.to_json(context),
    )
    message = F.concat(F.lit('{"blocks":['), F.array_join(blocks, ","), F.lit("]}"))
    return history.select(window, "alert_type", *keep, message.alias("message"))


def mails(history: DataFrame, window: str, keep: Sequence[str] = ()) -> DataFrame:
    """(window, alert_type, kept columns, subject, body)."""
    severity = F.upper("severity")
    batch = F.col(window).cast("string")
    subject = F.format_string(MAIL_SUBJECT, severity, F.col("alert_type"), batch)
    values = iter((F.col("alert_type"), severity, batch, iso_time(F.col("timestamp")), F.col("what"), F.col("why")))
    fixed = [F.format_string(text, next(values)) if "%s" in text else F.lit(text) for text in MAIL_LINES]
    metric = F.when(F.col("metric_value").isNotNull(), F.format_string(MAIL_METRIC, number_text(F.col("metric_value"))))
    entries = F.transform(
        F.array_sort(F.map_entries("details")), lambda e: F.format_string(MAIL_DETAIL, e["key"], e["value"])
    )
    details = F.when(
        F.size("details") > 0, F.concat(F.array(F.lit(""), F.lit(MAIL_DETAILS)), entries)
    ).otherwise(F.array().cast("array<string>"))
    lines = F.concat(F.array(*fixed), F.array_compact(F.array(metric)), details)
    return history.select(window, "alert_type", *keep, subject.alias("subject"), F.array_join(lines, "\n").alias("body"))


def batch_lines(metrics: DataFrame, window: str) -> DataFrame:
    """(window, line): one summary line per window."""

    def number(name: str) -> Column:
        return F.coalesce(F.format_string("%.5f", F.col(name)), F.lit("N/A"))

    line = F.format_string(
        BATCH_LINE,
        F.col(window).cast("string"),
        F.col("phase"),
        F.when(F.col("mmd_score").isNull(), F.lit("N/A")).otherwise(number("mmd_score")),
        F.when(F.col("mmd_threshold").isNull(), F.lit("N/A")).otherwise(number("mmd_threshold")),
        F.col("issue_count"),
        F.col("row_count"),
    )
    return metrics.select(window, line.alias("line"))
