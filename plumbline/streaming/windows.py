"""Event-time windows and stream-stream joins."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def with_window(
    df: DataFrame, time: str, width: str, slide: str | None = None, delay: str | None = None, name: str = "w"
) -> DataFrame:
    """Add a tumbling (or, with ``slide``, sliding) event-time window column. With
    ``delay`` the stream gets a watermark, so that windows close and rows that come
    later than that are dropped."""
    stamped = df.withColumn(time, F.col(time).cast("timestamp"))
    if delay is not None:
        stamped = stamped.withWatermark(time, delay)
    return stamped.withColumn(name, F.window(time, width, slide) if slide else F.window(time, width))


def match_label_stream(
    predictions: DataFrame,
    labels: DataFrame,
    horizon: str,
    delay: str,
    prediction_time: str = "ts",
    label_time: str = "label_ts",
    how: str = "inner",
) -> DataFrame:
    """Join a prediction stream with a label stream whose labels come up to
    ``horizon`` after the prediction.

    Both sides carry a watermark and the join has a time range, so Spark drops the
    state of events that can no longer match. With ``left_outer`` a prediction
    without a label comes out once its horizon has passed. Every label of an event
    is matched; ``latest_label_stream`` keeps the newest.
    """
    return _joined(predictions, labels, horizon, delay, prediction_time, label_time, how)


def _joined(
    predictions: DataFrame,
    labels: DataFrame,
    horizon: str,
    delay: str,
    prediction_time: str,
    label_time: str,
    how: str,
    heartbeats: bool = False,
) -> DataFrame:
    """``heartbeats``: rows with a null event are joined too. An equality would have them
    dropped before they are seen by the watermark."""
    left = predictions.withColumn(prediction_time, F.col(prediction_time).cast("timestamp")).withWatermark(
        prediction_time, delay
    )
    right = (
        labels.withColumnRenamed("event_id", "_label_event")
        .withColumn(label_time, F.col(label_time).cast("timestamp"))
        .withWatermark(label_time, delay)
    )
    in_time = (F.col(label_time) >= F.col(prediction_time)) & (
        F.col(label_time) <= F.col(prediction_time) + F.expr(f"INTERVAL {horizon}")
    )
    event, label_event = F.col("event_id"), F.col("_label_event")
    same = event.eqNullSafe(label_event) if heartbeats else event == label_event
    return left.join(right, same & in_time, how).drop("_label_event")


def latest_label_stream(
    predictions: DataFrame,
    labels: DataFrame,
    horizon: str,
    delay: str,
    width: str,
    prediction_time: str = "ts",
    label_time: str = "label_ts",
) -> DataFrame:
    """Every prediction once, with the newest of its labels: the columns of ``predictions``
    (the time as a timestamp), ``true_label`` and ``label_ts``, both null without a label.

    A prediction is held until its window of ``width`` and the horizon after it have passed;
    a label that comes earlier in the stream but has a later time wins, equal times go to
    the larger label. All predictions of a window come out of the same micro-batch. A
    prediction that arrives twice comes out once. State is keyed by event, so no key is
    hot, and is bounded: the join drops both sides after the horizon, the window's rows
    go when it closes. Windows close in the order of their time.

    A stream's last windows stay open until later rows arrive; ``heartbeat`` rows (a null
    ``event_id``) move the time on without adding anything.
    """
    columns = predictions.columns
    joined = _joined(predictions, labels, horizon, delay, prediction_time, label_time, "left_outer", heartbeats=True)
    # Only the window carries the stream's time from here on; other times are numbers while they are keys.
    flat = joined.select(
        F.window(prediction_time, width).alias("_held"),
        *[(F.unix_micros(c) if c == prediction_time else F.col(c)).alias(c) for c in columns],
        F.struct(F.unix_micros(label_time).alias("at"), "true_label").alias("_label"),
    )
    newest = F.max(F.when(F.col("_label.at").isNotNull(), F.col("_label")))
    # Heartbeats are left out by an aggregate, as a filter on the event would move below the watermark.
    real = F.max(F.col("event_id").isNotNull())
    held = flat.groupBy("_held", *columns).agg(newest.alias("_label"), real.alias("_real")).where("_real")
    return held.select(
        *[(F.timestamp_micros(c) if c == prediction_time else F.col(c)).alias(c) for c in columns],
        F.col("_label.true_label").alias("true_label"),
        F.timestamp_micros("_label.at").alias(label_time),
    )


def heartbeat(spark: SparkSession, schema: T.StructType, time: str, at: datetime, files: int = 1) -> DataFrame:
    """One row of nulls but for the time: it moves the watermark of a stream that has gone quiet.
    ``files`` gives as many such rows, each in a partition (and, when written, a file) of its own."""
    row = spark.createDataFrame([(at,)], "at timestamp") if files == 1 else spark.range(0, files, 1, files).withColumn("at", F.lit(at))
    return row.select(
        *[(F.col("at") if f.name == time else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields]
    )
