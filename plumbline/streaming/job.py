"""A monitoring job from a configuration mapping: source, trigger, checkpoint, monitor, handlers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from plumbline.schemas import EVENT
from plumbline.session import shared_dir
from plumbline.settings import settings_from_mapping
from plumbline.sources.records import decode, file_stream, message_stream
from plumbline.sources.routing import handlers_from_mapping
from plumbline.streaming.monitor import StreamMonitor


@dataclass(frozen=True)
class MonitorJob:
    stream: DataFrame
    monitor: StreamMonitor
    checkpoint: str
    interval: str | None

    def start(self) -> StreamingQuery:
        return self.monitor.start(self.stream, self.checkpoint, self.interval)


def source_from_mapping(spark: SparkSession, config: Mapping[str, Any]) -> DataFrame:
    """The decoded event stream of section ``files`` (folder of JSON lines) or ``kafka`` (topic)."""
    if files := config.get("files"):
        options = {"maxFilesPerTrigger": str(files["max_files_per_trigger"])} if "max_files_per_trigger" in files else {}
        text = "value string"
        return decode(file_stream(spark, files["path"], text, "text", **options), EVENT)
    if kafka := config.get("kafka"):
        group = {"kafka.group.id": kafka["consumer_group"]} if kafka.get("consumer_group") else {}
        return message_stream(
            spark,
            kafka["bootstrap_servers"],
            kafka["topic"],
            starting_offsets=kafka.get("starting_offsets", "latest"),
            options=group,
        )
    raise ValueError("the configuration names neither files nor kafka")


def job_from_mapping(
    spark: SparkSession, config: Mapping[str, Any], key: Sequence[str] = ("event_id",), event_time: str | None = None
) -> MonitorJob:
    """Everything a monitoring job needs, as a configuration says.

    ``spark``: ``trigger_interval`` (``once``: work off what is there), ``checkpoint_location``,
    ``state_location``, ``shuffle_partitions``, ``log_level``. Locations that are not given lie below the
    shared folder, under the name of the application. All other sections are read by
    ``settings_from_mapping`` and ``handlers_from_mapping``.
    """
    section = config.get("spark", {})
    if "shuffle_partitions" in section:
        spark.conf.set("spark.sql.shuffle.partitions", str(section["shuffle_partitions"]))
    if "log_level" in section:
        spark.sparkContext.setLogLevel(section["log_level"])
    home = f"{shared_dir(spark).rstrip('/')}/{config.get('app_name', 'monitor')}"
    interval = section.get("trigger_interval", "30 seconds")
    monitor = StreamMonitor(
        spark,
        section.get("state_location") or f"{home}/state",
        key,
        settings_from_mapping(config),
        event_time,
        handlers_from_mapping(config),
    )
    return MonitorJob(
        source_from_mapping(spark, config),
        monitor,
        section.get("checkpoint_location") or f"{home}/checkpoint",
        None if interval == "once" else interval,
    )
