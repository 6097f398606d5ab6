"""Event, prediction and label records from JSON: message streams and files."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.schemas import EVENT, LABEL, PREDICTION

METADATA = ("offset", "partition")


def decode(raw: DataFrame, schema: T.StructType = EVENT, corrupt_flag: str | None = None) -> DataFrame:
    """The record fields of a ``value`` column, next to the source metadata.

    A field that does not fit its type becomes null, unknown fields are dropped,
    and text that is no JSON object gives a row of nulls. ``corrupt_flag`` names a
    boolean column for the last case.
    """
    metadata = {c: c for c in METADATA if c in raw.columns}
    if "timestamp" in raw.columns:
        metadata["timestamp"] = "kafka_ts"
    fields = list(schema.fields) + ([T.StructField("_corrupt_record", T.StringType())] if corrupt_flag else [])
    parsed = raw.select(
        F.from_json(F.col("value").cast("string"), T.StructType(fields)).alias("d"),
        *[F.col(source).alias(name) for source, name in metadata.items()],
    ).select("d.*", *metadata.values())
    if corrupt_flag is None:
        return parsed
    return parsed.withColumn(corrupt_flag, F.col("_corrupt_record").isNotNull()).drop("_corrupt_record")


def decode_array(raw: DataFrame, schema: T.StructType = EVENT) -> DataFrame:
    """One row per element of the JSON arrays in a ``value`` column."""
    parsed = raw.select(F.from_json(F.col("value").cast("string"), T.ArrayType(schema)).alias("items"))
    return parsed.select(F.inline("items"))


def message_stream(
    spark: SparkSession,
    servers: str,
    topic: str,
    schema: T.StructType = EVENT,
    starting_offsets: str = "latest",
    options: Mapping[str, str] | None = None,
) -> DataFrame:
    """A decoded stream of one Kafka topic (needs Spark's Kafka connector)."""
    reader = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", starting_offsets)
        .option("failOnDataLoss", "false")
        .options(**dict(options or {}))
    )
    return decode(reader.load(), schema)


# Default topics of the model streams.
def prediction_stream(spark: SparkSession, servers: str, topic: str = "ml-predictions", **options: str) -> DataFrame:
    return message_stream(spark, servers, topic, PREDICTION, options=options)


def label_stream(spark: SparkSession, servers: str, topic: str = "ml-labels", **options: str) -> DataFrame:
    return message_stream(spark, servers, topic, LABEL, options=options)


def file_stream(
    spark: SparkSession, path: str, schema: T.StructType, file_format: str = "json", **options: str
) -> DataFrame:
    """A stream over files that arrive in a folder."""
    return spark.readStream.schema(schema).format(file_format).options(**options).load(path)


def read_json_array(spark: SparkSession, path: str, schema: T.StructType = EVENT) -> DataFrame:
    """Files that hold one JSON array each; elements without known fields give nulls."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def with_event_time(df: DataFrame, millis: str = "timestamp", name: str = "event_ts") -> DataFrame:
    return df.withColumn(name, F.timestamp_millis(millis))


def as_messages(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The reverse of ``decode``: rows as JSON text in a ``value`` column."""
    return df.select(F.to_json(F.struct(*columns)).alias("value"))
