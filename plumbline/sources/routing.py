"""Routing of fired alerts to handlers.

A batch's alerts are written once. Every active handler then gets them in its own form, in a
table of its own, and a line in the batch's commit log once that table is whole. A repeated
batch takes the stored alerts and serves only the handlers that have no line yet, so a
failure halfway neither loses nor doubles an alert. Readers see committed tables only.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.operators import render
from plumbline.sources.tables import read_table, write_batch

STORED = "stored"  # the line of the batch's alerts themselves
COMMIT = T.StructType(
    [
        T.StructField("alerts", T.LongType()),
        T.StructField("committed_at", T.TimestampType()),
        T.StructField("batch", T.LongType()),
        T.StructField("handler", T.StringType()),
    ]
)


class RoutingError(RuntimeError):
    """Some handlers of a batch failed; the others are committed. Repeat the batch."""


@dataclass(frozen=True)
class Handler:
    """``render`` turns (alerts, window column) into the handler's rows, ``write`` takes them with the
    folder of the batch; it must replace what an earlier try left there."""

    name: str
    render: Callable[[DataFrame, str], DataFrame]
    write: Callable[[DataFrame, str], None] = lambda rows, path: rows.write.mode("overwrite").json(path)


LOG = Handler("log", render.log_lines)
FILE = Handler("file", lambda alerts, window: alerts)
DASHBOARD = Handler("dashboard", lambda alerts, window: alerts)
CHAT = Handler("chat", render.chat_messages)


def mail_handler(recipients: Sequence[str], sender: str = "") -> Handler:
    def mails(alerts: DataFrame, window: str) -> DataFrame:
        to = F.array(*[F.lit(r) for r in recipients])
        return render.mails(alerts, window).withColumns({"sender": F.lit(sender), "recipients": to})

    return Handler("mail", mails)


def handlers_from_mapping(config: Mapping[str, Any]) -> tuple[Handler, ...]:
    """The active handlers of a configuration: the log always, others where they are set up."""
    alerts = config.get("alerts", {})
    mail = alerts.get("email") or {}
    found = [LOG]
    if alerts.get("log_file"):
        found.append(FILE)
    if alerts.get("dashboard_state_path"):
        found.append(DASHBOARD)
    if alerts.get("slack_webhook_url"):
        found.append(CHAT)
    if mail.get("enabled") and mail.get("recipients"):
        found.append(mail_handler(mail["recipients"], mail.get("sender", "")))
    return tuple(found)


def commits(spark: SparkSession, path: str) -> DataFrame:
    """(batch, handler, alerts, committed_at): what has been handed over."""
    return read_table(spark, f"{path}/commits", COMMIT)


def route(alerts: DataFrame, path: str, batch_id: int, window: str, handlers: Sequence[Handler]) -> None:
    """Hand the alerts of a batch to every handler that has not had them.

    The alerts that count are those of the first try of the batch. A handler that fails does not
    keep the others from their alerts; ``RoutingError`` at the end names those that failed.
    """
    spark, path = alerts.sparkSession, path.rstrip("/")
    if len({STORED, *[h.name for h in handlers]}) != len(handlers) + 1:
        raise ValueError("handlers must have different names")
    done = {r["handler"] for r in commits(spark, path).where(F.col("batch") == batch_id).select("handler").collect()}
    if STORED not in done:
        write_batch(alerts, f"{path}/fired", batch_id)
    fired = spark.read.schema(alerts.schema).parquet(f"{path}/fired/batch={batch_id}")
    n = fired.count()

    def commit(name: str) -> None:
        line = spark.range(1).select(F.lit(n).alias("alerts"), F.current_timestamp().alias("committed_at"))
        line.coalesce(1).write.mode("overwrite").parquet(f"{path}/commits/batch={batch_id}/handler={name}")

    if STORED not in done:
        commit(STORED)
    failed = {}
    for handler in handlers:
        if handler.name in done:
            continue
        try:
            handler.write(handler.render(fired, window), f"{path}/{handler.name}/batch={batch_id}")
        except Exception as error:  # whatever a handler raises, the others still get their alerts
            failed[handler.name] = error
            continue
        commit(handler.name)
    if failed:
        raise RoutingError(f"batch {batch_id}: " + "; ".join(f"{name}: {error}" for name, error in failed.items()))


def handed_over(spark: SparkSession, path: str, handler: str) -> DataFrame:
    """The rows of a handler's committed batches, with ``batch``; tables that were not finished are left out."""
    path = path.rstrip("/")
    known = commits(spark, path).where((F.col("handler") == handler) & (F.col("alerts") > 0)).select("batch").collect()
    folders = [f"{path}/{handler}/batch={row['batch']}" for row in known]
    if not folders:
        return spark.createDataFrame([], "batch long")
    return spark.read.option("basePath", f"{path}/{handler}").json(folders)
