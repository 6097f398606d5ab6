"""Result tables: alert logs, metrics and references, written so that a repeated
batch replaces its own rows instead of adding them twice."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from plumbline.operators.alerts import dashboard_summary, latest_alerts, latest_metrics
from plumbline.schemas import ALERT
from plumbline.settings import AlertSettings


def append_alert_log(alerts: DataFrame, path: str) -> None:
    """Append alerts as JSON lines."""
    alerts.write.mode("append").json(path)


def read_alert_log(spark: SparkSession, path: str, limit: int = 50, schema: T.StructType = ALERT) -> DataFrame:
    """The newest alerts of a JSON-lines log; lines that are no alert are skipped."""
    lines = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    return lines.where(F.col("timestamp").isNotNull()).orderBy(F.desc("timestamp"), "alert_type", "what").limit(limit)


def write_batch(rows: DataFrame, path: str, batch_id: int, file_format: str = "parquet") -> None:
    """Write the rows of one batch into its own folder, replacing an earlier try."""
    rows.write.mode("overwrite").format(file_format).save(f"{path.rstrip('/')}/batch={batch_id}")


def read_table(
    spark: SparkSession, path: str, schema: T.StructType, file_format: str = "parquet"
) -> DataFrame:
    """A table written by ``write_batch``; empty if nothing was written yet."""
    try:
        return spark.read.schema(schema).format(file_format).load(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def dashboard_state(
    metrics: DataFrame, alerts: DataFrame, window: str, time: str, settings: AlertSettings = AlertSettings()
) -> dict[str, DataFrame]:
    """The three frames a dashboard shows: alerts, metrics_history and summary."""
    return {
        "alerts": latest_alerts(alerts, window, settings),
        "metrics_history": latest_metrics(metrics, window, settings),
        "summary": dashboard_summary(metrics, alerts, window, time, settings),
    }
