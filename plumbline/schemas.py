"""Record layouts of the streams and of the tables the library writes."""

from __future__ import annotations

from pyspark.sql import types as T

# Field names and types of the input records.
EVENT = T.StructType(
    [
        T.StructField("event_id", T.StringType()),
        T.StructField("user_id", T.StringType()),
        T.StructField("age", T.IntegerType()),
        T.StructField("purchase_amount", T.DoubleType()),
        T.StructField("session_duration", T.IntegerType()),
        T.StructField("page_views", T.IntegerType()),
        T.StructField("device_type", T.StringType()),
        T.StructField("timestamp", T.LongType()),
    ]
)
PREDICTION = T.StructType(
    [
        T.StructField("event_id", T.StringType()),
        T.StructField("predicted_label", T.IntegerType()),
        T.StructField("predicted_score", T.DoubleType()),
        T.StructField("model_version", T.StringType()),
        T.StructField("timestamp", T.LongType()),
    ]
)
LABEL = T.StructType(
    [
        T.StructField("event_id", T.StringType()),
        T.StructField("true_label", T.IntegerType()),
        T.StructField("timestamp", T.LongType()),
    ]
)
ALERT = T.StructType(
    [
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("batch_id", T.LongType()),
        T.StructField("alert_type", T.StringType()),
        T.StructField("severity", T.StringType()),
        T.StructField("message", T.StringType()),
        T.StructField("what", T.StringType()),
        T.StructField("why", T.StringType()),
        T.StructField("metric_value", T.DoubleType()),
        T.StructField("details", T.MapType(T.StringType(), T.StringType())),
    ]
)


def metrics_schema(numeric) -> T.StructType:
    """One row per window; a null-rate column for every numeric feature."""
    return T.StructType(
        [
            T.StructField("batch_id", T.LongType()),
            T.StructField("timestamp", T.TimestampType()),
            T.StructField("phase", T.StringType()),
            T.StructField("mmd_score", T.DoubleType()),
            T.StructField("mmd_threshold", T.DoubleType()),
            T.StructField("mmd_drift", T.BooleanType()),
            T.StructField("validity_rate", T.DoubleType()),
            T.StructField("row_count", T.LongType()),
        ]
        + [T.StructField(f"null_rate_{name}", T.DoubleType()) for name in numeric]
    )
