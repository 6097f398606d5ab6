"""Sources, sinks and streams. Streams read the given tables as files that have
arrived, work them off and stop; what they wrote is the result."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.alerting import ALL_ALERTS, METRICS_COLUMNS, METRICS_FROM, METRICS_PARTS, VALIDATION_ALERTS, _all_alerts
from checks.alerting import _metrics_rows, _validation_alerts
from checks.base import FE, ISSUES, LAB, PRED, VALIDITY, q6, query, r6, report
from checks.drifting import ORACLE_REFERENCE, ctes, reference_rows
from checks.modelling import LATEST_LABELS_SQL, MODEL_REPORT_SQL, corrected_labels, report_columns
from plumbline.operators.registry import REFERENCE_PARTS, load_reference, save_reference
from plumbline.operators.validate import Validation
from plumbline.plans.views import FEATURE_EVENTS, LABELS, PREDICTIONS, feature_events, labels, predictions
from plumbline.schemas import EVENT, LABEL, PREDICTION
from plumbline.session import scratch_path
from plumbline.sources import records, tables
from plumbline.streaming.model_monitor import ModelMonitor
from plumbline.streaming.windows import heartbeat, latest_label_stream, match_label_stream, with_window

MESSAGE_COLUMNS = ("event_id", "user_id", "age", "purchase_amount", "session_duration", "page_views", "device_type", "timestamp")


def _event_stream(spark: SparkSession, sf: str) -> DataFrame:
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)


def _feature_stream(spark: SparkSession, sf: str) -> DataFrame:
    text = FEATURE_EVENTS.format(
        events="{events}", json_k="get_json_object(props, '$.k')", millis="unix_millis(CAST(ts AS TIMESTAMP))"
    )
    return spark.sql(text, events=_event_stream(spark, sf))


def _work_off(stream: DataFrame, name: str) -> DataFrame:
    """Append a stream to a table until its input is used up, and read the table."""
    spark = stream.sparkSession
    path, checkpoint = scratch_path(spark, name), scratch_path(spark, f"{name}-checkpoint")
    query_run = (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query_run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def _messages(features: DataFrame) -> DataFrame:
    """Feature rows as they arrive from a topic: JSON text with source metadata."""
    value = F.to_json(F.struct(*[F.col(c).cast(EVENT[c].dataType).alias(c) for c in MESSAGE_COLUMNS]))
    return features.select(
        value.alias("value"),
        (F.col("event_id") % 4).cast("int").alias("partition"),
        F.floor(F.col("event_id") / 4).alias("offset"),
        F.col("ts").cast("timestamp").alias("timestamp"),
    )


EVENT_SQL = """SELECT CAST(event_id AS VARCHAR) AS event_id, CAST(user_id AS VARCHAR) AS user_id, age, purchase_amount,
  session_duration, page_views, device_type, "timestamp" """


@query("s1_event_stream", f"WITH {FE} {EVENT_SQL} FROM fe")
def _(spark, sf):
    """A stream of messages, decoded and appended to a table."""
    decoded = records.decode(_messages(_feature_stream(spark, sf)))
    return _work_off(decoded, "events").select(*MESSAGE_COLUMNS)


@query(
    "s3_source_metadata",
    f"""WITH {FE} SELECT CAST(event_id AS VARCHAR) AS event_id, event_id // 4 AS "offset", CAST(event_id % 4 AS INT) AS "partition", ts AS kafka_ts FROM fe""",
)
def _(spark, sf):
    decoded = records.decode(_messages(feature_events(spark, sf)))
    return decoded.select("event_id", "offset", "partition", F.col("kafka_ts").cast("timestamp_ntz").alias("kafka_ts"))


@query(
    "s4_micro_batches",
    f"WITH {FE}, {ISSUES}, {VALIDITY} SELECT w, total, issue_count, {q6('validity_rate')} AS validity_rate FROM validity",
)
def _(spark, sf):
    """Every micro-batch is validated and written under its batch id."""
    path = scratch_path(spark, "validity")

    def handle(batch: DataFrame, batch_id: int) -> None:
        tables.write_batch(Validation(batch, ["w"]).validity(), path, batch_id)

    run = (
        _feature_stream(spark, sf)
        .writeStream.foreachBatch(handle)
        .option("checkpointLocation", scratch_path(spark, "validity-checkpoint"))
        .trigger(availableNow=True)
        .start()
    )
    run.awaitTermination()
    return spark.read.parquet(path).select("w", "total", "issue_count", r6("validity_rate"))


@query(
    "s4_windowed_stream",
    f"WITH {FE}, {ISSUES}, {VALIDITY} SELECT CAST(w AS TIMESTAMP) AS start, total, issue_count, {q6('row_validity_rate')} AS row_validity_rate FROM validity",
)
def _(spark, sf):
    """Validation as a streaming aggregation over tumbling event-time windows."""
    windowed = with_window(_feature_stream(spark, sf).drop("w"), "ts", "1 day", delay="1 hour")
    path = scratch_path(spark, "windows")
    run = (
        Validation(windowed, ["w"])
        .validity()
        .writeStream.outputMode("complete")
        .foreachBatch(lambda batch, batch_id: batch.write.mode("overwrite").parquet(path))
        .option("checkpointLocation", scratch_path(spark, "windows-checkpoint"))
        .trigger(availableNow=True)
        .start()
    )
    run.awaitTermination()
    return spark.read.parquet(path).select(
        F.col("w.start").cast("timestamp_ntz").alias("start"), "total", "issue_count", r6("row_validity_rate")
    )


@query("s5_alert_log", f"{VALIDATION_ALERTS} SELECT w, alert_type, severity, what, metric AS metric_value FROM al")
def _(spark, sf):
    fired = _validation_alerts(spark, sf)
    path = scratch_path(spark, "alert-log")
    tables.append_alert_log(fired, path)
    return spark.read.schema(fired.schema).json(path).select("w", "alert_type", "severity", "what", "metric_value")


@query("s6_metrics_table", f"WITH {ctes(*METRICS_PARTS)} SELECT {METRICS_COLUMNS} {METRICS_FROM}")
def _(spark, sf):
    """Written twice under the same batch id: the second write replaces the first."""
    found = report(spark, sf).metrics()
    path = scratch_path(spark, "metrics")
    tables.write_batch(found, path, 0)
    tables.write_batch(found, path, 0)
    return _metrics_rows(tables.read_table(spark, path, found.schema))


@query("s7_latest_alert_log", f"{VALIDATION_ALERTS} SELECT alert_type, severity, what FROM (SELECT * FROM al ORDER BY w DESC, alert_type, what LIMIT 5)")
def _(spark, sf):
    path = scratch_path(spark, "alert-log")
    tables.append_alert_log(_validation_alerts(spark, sf), path)
    spark.read.parquet(f"{sf}/events.parquet").limit(1).select(F.lit("{broken").alias("value")).write.mode("append").text(path)
    return tables.read_alert_log(spark, path, 5).select("alert_type", "severity", "what")


@query(
    "s8_dashboard_state",
    f"""{ALL_ALERTS} SELECT 'alert' AS part, w, alert_type AS item, {q6('metric_value')} AS amount
    FROM (SELECT * FROM al ORDER BY w DESC, alert_type, what LIMIT 50)
    UNION ALL SELECT 'metrics', w, phase, {q6('mmd_score')} FROM sc""",
)
def _(spark, sf):
    r = report(spark, sf)
    metrics = r.metrics().withColumn("at", F.expr("date_add(w, 1)"))
    state = tables.dashboard_state(metrics, _all_alerts(r), "w", "at")
    shown = state["alerts"].select(F.lit("alert").alias("part"), "w", F.col("alert_type").alias("item"), r6("metric_value", "amount"))
    return shown.unionByName(
        state["metrics_history"].select(
            F.lit("metrics").alias("part"), "w", F.col("phase").alias("item"), r6("mmd_score", "amount")
        )
    )


def _saved_reference(spark: SparkSession, sf: str) -> str:
    path = scratch_path(spark, "reference")
    save_reference(report(spark, sf).reference.parts(), path)
    return path


@query("s9_save_reference", ORACLE_REFERENCE)
def _(spark, sf):
    path = _saved_reference(spark, sf)
    return reference_rows({part: spark.read.parquet(f"{path}/{part}") for part in REFERENCE_PARTS})


@query("s10_load_reference", ORACLE_REFERENCE)
def _(spark, sf):
    return reference_rows(load_reference(spark, _saved_reference(spark, sf)))


def _as_messages(rows: DataFrame, time: str, schema) -> DataFrame:
    millis = F.unix_millis(F.col(time).cast("timestamp")).alias("timestamp")
    shaped = rows.select(*[F.col(c).cast(schema[c].dataType).alias(c) for c in schema.names if c != "timestamp"], millis)
    return records.as_messages(shaped, schema.names)


@query(
    "s11_prediction_stream",
    f"""WITH {PRED} SELECT CAST(event_id AS VARCHAR) AS event_id, predicted_label, {q6('predicted_score')} AS predicted_score, model_version,
      epoch_us(ts) // 1000 AS "timestamp" FROM pred""",
)
def _(spark, sf):
    stream = spark.sql(PREDICTIONS, events=_event_stream(spark, sf))
    found = _work_off(records.decode(_as_messages(stream, "ts", PREDICTION), PREDICTION), "predictions")
    return found.select("event_id", "predicted_label", r6("predicted_score"), "model_version", "timestamp")


@query(
    "s12_label_stream",
    f"""WITH {LAB} SELECT CAST(event_id AS VARCHAR) AS event_id, true_label, epoch_us(label_ts) // 1000 AS "timestamp" FROM lab""",
)
def _(spark, sf):
    stream = spark.sql(LABELS, events=_event_stream(spark, sf))
    return _work_off(records.decode(_as_messages(stream, "label_ts", LABEL), LABEL), "labels")


@query(
    "s13_json_array",
    f"WITH {FE}, a AS ({EVENT_SQL} FROM fe) SELECT event_id, age, device_type FROM a UNION ALL SELECT NULL, NULL, NULL FROM a",
)
def _(spark, sf):
    """Arrays of an event and an object that only has a comment."""
    text = F.concat(F.lit("["), F.col("value"), F.lit(',{"_comment":"no event"}]'))
    arrays = _messages(feature_events(spark, sf)).select(text.alias("value"))
    return records.decode_array(arrays).select("event_id", "age", "device_type")


@query(
    "j2_label_stream_join",
    f"WITH {PRED}, {LAB} SELECT event_id, predicted_label, true_label FROM pred JOIN lab USING (event_id)",
)
def _(spark, sf):
    """Labels come within a day of their prediction; both sides are streams."""
    left = spark.sql(PREDICTIONS, events=_event_stream(spark, sf))
    right = spark.sql(LABELS, events=_event_stream(spark, sf))
    joined = match_label_stream(left, right, "1 day", "2 days")
    return _work_off(joined.select("event_id", "predicted_label", "true_label"), "pairs")



PAST, FAR = datetime(1970, 1, 1), datetime(2100, 1, 1)
DAYS = ((1, 8), (9, 16), (17, 24), (25, 31))


def _arriving(rows: DataFrame, time: str, name: str) -> DataFrame:
    """Rows as a stream of several arrivals in the order of their time, with a heartbeat at the end.

    An arrival is one micro-batch. It has as many files as the table has splits, so that no task writes
    or reads all of it; heartbeats from long ago, which add nothing, stand in for files without rows.
    Two heartbeats: the first moves the watermark, the second makes a batch that sees it.
    """
    spark = rows.sparkSession
    path = scratch_path(spark, name)
    files = max(1, min(rows.rdd.getNumPartitions(), spark.sparkContext.defaultParallelism))
    written = 0
    for first, last in DAYS:
        part = rows.where(F.dayofmonth(time).between(first, last)).repartition(files)
        part.write.mode("append").option("maxRecordsPerFile", 0).parquet(path)
        found = len(spark.read.schema(rows.schema).parquet(path).inputFiles())
        written += files
        if found < written:
            heartbeat(spark, rows.schema, time, PAST, written - found).write.mode("append").parquet(path)
    for _ in range(2):
        beats = heartbeat(spark, rows.schema, time, FAR, files)
        (beats.coalesce(1) if files == 1 else beats).write.mode("append").parquet(path)
    return records.file_stream(spark, path, rows.schema, "parquet", maxFilesPerTrigger=str(files))


@query("j2_latest_label_stream", f"{LATEST_LABELS_SQL} SELECT event_id, predicted_label, latest.true_label, latest.label_ts FROM pred LEFT JOIN latest USING (event_id)")
def _(spark, sf):
    """Predictions and labels in several files; a third of the events get a second, later label, which wins."""
    left = _arriving(predictions(spark, sf), "ts", "arriving-predictions")
    right = _arriving(corrected_labels(spark, sf), "label_ts", "arriving-labels")
    found = _work_off(latest_label_stream(left, right, "1 day", "2 days", "1 day"), "latest-labels")
    return found.select("event_id", "predicted_label", "true_label", F.col("label_ts").cast("timestamp_ntz").alias("label_ts"))


@query("m9_streamed_report", MODEL_REPORT_SQL)
def _(spark, sf):
    """The model monitor on both streams, several micro-batches each."""
    monitor = ModelMonitor(spark, scratch_path(spark, "model-monitor"))
    run = monitor.start(
        _arriving(predictions(spark, sf), "ts", "arriving-predictions"),
        _arriving(labels(spark, sf), "label_ts", "arriving-labels"),
        scratch_path(spark, "model-monitor-checkpoint"),
        horizon="1 day",
        delay="2 days",
        width="1 day",
        interval=None,
    )
    run.awaitTermination()
    return report_columns(monitor.report())
