"""The model monitor as a stream: predictions, delayed labels and one report per window.

``latest_label_stream`` holds the predictions of a window until their labels are in, so a
micro-batch brings whole windows, in the order of their time. What a monitor has to
remember is small and has a version per batch:

* the number of windows seen, the warm-up's rows and positives, the frozen accuracy, and in which
  batches the tables below were written last: one row;
* the counts of the warm-up's scores, one table per warm-up batch;
* the last pairs of a prediction and its label, at most ``ModelSettings.window_rows``.

All else is a grouped job over the windows that have just closed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window
from pyspark.sql.streaming import StreamingQuery

from plumbline.functions.ranking import value_counts
from plumbline.operators import model
from plumbline.operators.phases import MONITORING, WARMUP
from plumbline.settings import ModelSettings
from plumbline.streaming.versions import Versions
from plumbline.streaming.windows import latest_label_stream

STATE = T.StructType(
    [
        T.StructField("seen", T.LongType()),
        T.StructField("warmup_rows", T.LongType()),
        T.StructField("warmup_positives", T.LongType()),
        T.StructField("baseline_accuracy", T.DoubleType()),
        T.StructField("ring_batch", T.LongType()),
        T.StructField("reference_batches", T.ArrayType(T.LongType())),
    ]
)
REFERENCE = T.StructType(
    [
        T.StructField("feature", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("n", T.LongType()),
    ]
)
PAIR = ("predicted_label", "predicted_score", "true_label")


class ModelMonitor:
    """Reports score drift, label drift and performance of every window of a prediction stream."""

    def __init__(
        self,
        spark: SparkSession,
        path: str,
        window: str = "w",
        order: Sequence[str] = ("ts", "event_id"),
        settings: ModelSettings = ModelSettings(),
    ) -> None:
        """``window`` is a column of the predictions that is the same within a held window;
        ``order`` (time, then id) says which pairs are the last ones."""
        self.spark, self.window, self.order, self.settings = spark, window, list(order), settings
        self.versions = Versions(spark, path)

    def start(
        self,
        predictions: DataFrame,
        labels: DataFrame,
        checkpoint: str,
        horizon: str,
        delay: str,
        width: str,
        interval: str | None = "30 seconds",
    ) -> StreamingQuery:
        """Run on two streams (see ``latest_label_stream``); without an interval, work off what is there and stop."""
        held = latest_label_stream(predictions, labels, horizon, delay, width)
        writer = held.writeStream.foreachBatch(self.process).option("checkpointLocation", checkpoint)
        trigger = {"processingTime": interval} if interval else {"availableNow": True}
        return writer.trigger(**trigger).start()

    def report(self) -> DataFrame:
        """The reports of all windows so far, with the columns of ``model_report``."""
        return self.spark.read.parquet(self.versions.table("report")).drop("batch")

    def process(self, batch: DataFrame, batch_id: int) -> None:
        """Report the windows that closed. A repeated batch starts from the same state and writes the same rows."""
        known = self.versions.before("state", STATE, batch_id)
        state = known.first().asDict() if known is not None else {**dict.fromkeys(STATE.names, 0), "reference_batches": []}
        if known is None:
            state |= {"baseline_accuracy": None, "ring_batch": None}
        rows = self.versions.keep(batch.select(self.window, *self.order, *PAIR), "rows", batch_id)
        windows = self._windows(rows, state["seen"])
        closed = windows.agg(F.count("*"), F.sum("warm_rows"), F.sum("warm_positives"), F.max(self.window)).first()
        if closed[0]:
            windows = self.versions.keep(windows, "windows", batch_id)
            self._report(rows, windows, state, closed, batch_id)
        self.versions.keep(self.spark.createDataFrame([tuple(state[n] for n in STATE.names)], STATE).coalesce(1), "state", batch_id)

    def _windows(self, rows: DataFrame, seen: int) -> DataFrame:
        """One row per window; only these rows are numbered."""
        reduced = rows.groupBy(self.window).agg(
            F.count(F.lit(1)).alias("n_predictions"),
            F.count("predicted_label").alias("labelled"),
            F.sum("predicted_label").alias("positives"),
        )
        position = F.row_number().over(Window.orderBy(self.window)) + F.lit(seen)
        warm = F.col("position") <= self.settings.warmup_windows
        return reduced.withColumn("position", position).select(
            self.window,
            "n_predictions",
            "position",
            F.when(warm, F.lit(WARMUP)).otherwise(F.lit(MONITORING)).alias("phase"),
            F.when(warm, F.col("labelled")).otherwise(0).alias("warm_rows"),
            F.when(warm, F.coalesce("positives", F.lit(0))).otherwise(0).cast("long").alias("warm_positives"),
        )

    def _report(self, rows: DataFrame, windows: DataFrame, state: dict, closed, batch_id: int) -> None:
        """Write the report of the closed windows and bring ``state`` up to them."""
        window, settings = self.window, self.settings
        n, warm_rows, warm_positives, newest = closed
        warm_here = state["seen"] < settings.warmup_windows
        state["seen"] += n
        state["warmup_rows"] += warm_rows
        state["warmup_positives"] += warm_positives

        scores = rows.select(window, F.lit("predicted_score").alias("feature"), F.col("predicted_score").alias("value"))
        counted = value_counts(scores, [window, "feature"]).join(windows.select(window, "phase"), window)
        if warm_here:
            warm = counted.where(F.col("phase") == WARMUP)
            self.versions.keep(model.pooled(warm, ["feature"]).select(*REFERENCE.names), "reference", batch_id)
            state["reference_batches"] = [*state["reference_batches"], batch_id]

        ends, tails = self._tails(rows, windows, state, newest, batch_id)
        health = model.recent_performance(ends, tails, windows, window, settings)
        health = self.versions.keep(health, "performance", batch_id)
        if state["baseline_accuracy"] is None and state["seen"] >= settings.warmup_windows:
            frozen = health.where(F.col("position") == settings.warmup_windows).first()
            state["baseline_accuracy"] = frozen["accuracy"] if frozen else None
        reference = model.pooled(self.versions.of_batch("reference", REFERENCE, *state["reference_batches"]), ["feature"])
        current = counted.where(F.col("phase") == MONITORING).drop("phase")
        positive = state["warmup_positives"] / state["warmup_rows"] if state["warmup_rows"] else 0.5
        baseline = F.lit(state["baseline_accuracy"]).cast("double")
        health = health.drop("position", "phase").withColumn("baseline_accuracy", baseline)
        report = model.joined_report(
            windows,
            model.score_tests(reference, current, window, settings),
            model.label_drift(rows, F.lit(positive), window, settings=settings),
            health.withColumn("is_degraded", model.is_degraded(baseline, F.col("accuracy"), settings.accuracy_drop)),
            window,
        )
        self.versions.keep(report, "report", batch_id)

    def _tails(
        self, rows: DataFrame, windows: DataFrame, state: dict, newest, batch_id: int
    ) -> tuple[DataFrame, DataFrame]:
        """The ends and the last pairs of every closed window; the newest pairs of all are kept for the next batch."""
        size = self.settings.window_rows
        pairs = rows.where(F.col("true_label").isNotNull())
        if state["ring_batch"] is not None:
            # The kept pairs come before all others, as pairs of the window that was the newest when they were kept.
            pairs = pairs.unionByName(self.versions.of_batch("ring", pairs.schema, state["ring_batch"]))
        ends, tails = model.ends_and_tails(pairs, windows, self.window, self.order, self.settings)
        ends = self.versions.keep(ends, "ends", batch_id)
        last = pairs.orderBy(F.desc(self.window), *[F.desc(c) for c in self.order]).limit(size)
        kept = last.withColumn(self.window, F.lit(newest)).select(*pairs.columns)
        kept = self.versions.keep(kept, "ring", batch_id)
        state["ring_batch"] = batch_id if not kept.isEmpty() else state["ring_batch"]
        return ends, self.versions.keep(tails(ends), "tails", batch_id)
