"""Session helpers."""

from __future__ import annotations

import gc
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"


def build_session(app_name: str = "plumbline", **conf: str) -> SparkSession:
    """A session with the settings the operators rely on (UTC, adaptive plans)."""
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named in ``spark.checkpoint.dir``.

    Where that setting is unset, a folder below the session's warehouse is used, which
    the driver and all executors share as well.
    """
    named = spark.conf.get(CHECKPOINT_CONF, None)
    if not named:
        named = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_runs"
        spark.conf.set(CHECKPOINT_CONF, named)
    return named


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path for one run below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write a reduced frame to the shared folder and read it back.

    Later plans start from the written rows: they do not repeat the scan, they
    survive the loss of any executor, and Spark knows the exact size when it
    chooses between a broadcast and a shuffled join.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*frames: DataFrame) -> None:
    """Delete the tables behind settled frames that nothing reads any more.

    A collection is then asked for, because Spark removes the shuffle files of finished
    plans when the driver has collected them. Only paths below the shared folder go.
    """
    if not frames:
        return
    spark = frames[0].sparkSession
    root = shared_dir(spark).rstrip("/").removeprefix("file://")
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    for frame in frames:
        for folder in {name.rpartition("/")[0] for name in frame.inputFiles()}:
            if f"{root}/" in folder:
                path = hadoop.Path(folder)
                path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    collect_garbage(spark)


def collect_garbage(spark: SparkSession) -> None:
    """Let the driver collect finished plans; Spark then removes their shuffle files."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def settle_bucketed(df: DataFrame, name: str, column: str, **options: str) -> DataFrame:
    """``settle`` as a table bucketed by a column: later joins on it move no row of the table."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    table = path.rpartition("/")[2].replace("-", "_")
    buckets = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    df.write.bucketBy(buckets, column).options(**options).option("path", path).saveAsTable(table)
    return spark.table(table)
