"""The monitor as a Structured Streaming sink: one window per micro-batch.

All state lives in tables below one folder, each batch in a folder of its own. A
batch reads the state its predecessor left, however long the stream has run. One
that is repeated after a failure writes the same rows to the same place, and a
restarted monitor goes on where the last one stopped.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.utils import AnalysisException

from plumbline.functions.frames import is_complete, long_numeric, stack_structs
from plumbline.functions.ranking import value_counts
from plumbline.functions.scalars import rate, separation_ratio
from plumbline.operators import alerts as alerting
from plumbline.operators import drift, mmd, stats, validate
from plumbline.operators.phases import CALIBRATE, MONITORING, WARMUP
from plumbline.operators.registry import load_reference, save_reference
from plumbline.plans.report import complementary_report, fit_reference, full_report
from plumbline.schemas import metrics_schema
from plumbline.settings import Settings
from plumbline.sources.routing import Handler, route
from plumbline.sources.tables import read_table, write_batch

WINDOW = "batch_id"

FIRST_BATCH = T.StructType([T.StructField("batch", T.LongType())])

ALERT_STATE = T.StructType(
    [
        T.StructField("alert_key", T.StringType()),
        T.StructField("violations", T.IntegerType()),
        T.StructField("seen", T.LongType()),
        T.StructField("fired_at", T.DoubleType()),
        T.StructField("fired", T.BooleanType()),
    ]
)
PROGRESS = T.StructType(
    [
        T.StructField("counted", T.LongType()),
        T.StructField("seen", T.LongType()),
        T.StructField("scores", T.ArrayType(T.DoubleType())),
        T.StructField("threshold", T.DoubleType()),
    ]
)


class StreamMonitor:
    """Validates, scores and alerts on every micro-batch of a feature stream."""

    def __init__(
        self,
        spark: SparkSession,
        path: str,
        key: Sequence[str],
        settings: Settings = Settings(),
        event_time: str | None = None,
        handlers: Sequence[Handler] = (),
    ):
        """``event_time`` names the column whose newest value is the time of a batch; a
        repeated batch then has the same time. Without it the clock is read. ``handlers``
        get the fired alerts (``sources.routing``); if one fails, the batch does."""
        self.spark, self.path, self.key, self.settings = spark, path.rstrip("/"), list(key), settings
        self.event_time, self.handlers = event_time, tuple(handlers)
        extra = [
            T.StructField("issue_count", T.LongType()),
            T.StructField("complete_rows", T.LongType()),
            T.StructField("batch", T.LongType()),
        ]
        self.metrics_type = T.StructType([*metrics_schema(settings.numeric).fields, *extra])

    def table(self, name: str) -> str:
        return f"{self.path}/{name}"

    def metrics(self) -> DataFrame:
        return read_table(self.spark, self.table("metrics"), self.metrics_type)

    def start(self, stream: DataFrame, checkpoint: str, interval: str | None = "30 seconds") -> StreamingQuery:
        """Run on a stream; without an interval, work off what is there and stop."""
        writer = stream.writeStream.foreachBatch(self.process).option("checkpointLocation", checkpoint)
        trigger = {"processingTime": interval} if interval else {"availableNow": True}
        return writer.trigger(**trigger).start()

    def process(self, batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            self._process(batch.withColumn(WINDOW, F.lit(batch_id).cast("long")), batch_id)
        finally:
            batch.unpersist()

    def _process(self, rows: DataFrame, batch_id: int) -> None:
        settings = self.settings
        numeric = [c for c in settings.numeric if c in rows.columns]
        checks = validate.checks_for(rows, settings.rules)
        profile = rows.groupBy(WINDOW).agg(
            *validate.counters(checks),
            F.count_if(is_complete(numeric)).alias("complete_rows"),
            *[F.count_if(F.col(c).isNull()).alias(f"nulls_{c}") for c in rows.columns if c != WINDOW],
            (F.max(F.col(self.event_time).cast("timestamp")) if self.event_time else F.current_timestamp()).alias(
                "timestamp"
            ),
        )
        profile = self._kept(profile, "profile", batch_id)
        counted = profile.first()
        progress = self._before("progress", PROGRESS, batch_id).first() or (0, 0, [], None)
        if counted is None:
            self._carry(progress, batch_id)
            return
        before, seen, calibration, threshold = progress
        validation = validate.Validation(rows, [WINDOW], settings.rules, counts=profile)
        floor, sound = settings.phases.validity_floor, True
        if floor is not None and before >= settings.phases.warmup_windows:
            sound = validation.validity().first()["validity_rate"] >= floor
        after = before + int(sound and (counted["complete_rows"] > 0 or settings.phases.count_incomplete))
        warm, calibrated = settings.phases.warmup_windows, settings.phases.warmup_windows + settings.phases.calibrate_windows
        phase = WARMUP if before < warm else CALIBRATE if before < calibrated else MONITORING

        if phase == WARMUP:
            write_batch(rows.drop(WINDOW), self.table("warmup_rows"), batch_id)
            if after >= warm:
                self._fit(rows.drop(WINDOW).schema, batch_id)

        if settings.single_window_reference and before == warm and after > before:
            self._save_reference(rows.drop(WINDOW))

        unscored = self._score(rows, profile, phase)
        if phase == CALIBRATE and sound:
            score = unscored.first()["mmd_score"]
            calibration = calibration + ([score] if score is not None else [])
            if after >= calibrated:
                threshold = self._threshold(calibration)
        scores = self._decide(unscored, phase, threshold)
        issues = self._kept(validation.issues(), "issues", batch_id)
        report = None
        if phase == MONITORING:
            report = self._kept(full_report(scores, self._complementary(rows, profile), WINDOW), "drift", batch_id)
        self._alert(issues, scores, report, batch_id, seen + 1, counted["timestamp"])

        null_rates = [
            rate(F.col(f"nulls_{c}"), F.col("total")).alias(f"null_rate_{c}")
            if c in rows.columns
            else F.lit(0.0).alias(f"null_rate_{c}")
            for c in settings.numeric
        ]
        metrics = (
            profile.select(WINDOW, "timestamp", F.col("total").alias("row_count"), *null_rates)
            .join(scores.select(WINDOW, "phase", "mmd_score", "mmd_threshold", "mmd_drift", "complete_rows"), WINDOW)
            .join(validation.validity().select(WINDOW, "validity_rate", "issue_count"), WINDOW)
        )
        names = [f for f in self.metrics_type.names if f != "batch"]
        write_batch(metrics.select(*names), self.table("metrics"), batch_id)
        self._save_progress((after, seen + 1, calibration, threshold), batch_id)

    def _before(self, name: str, schema: T.StructType, batch_id: int) -> DataFrame:
        """What the batch before this one left in a table; only the first batch of a monitor has none."""
        if batch_id == self._first_batch(batch_id):
            return self.spark.createDataFrame([], schema)
        path = f"{self.table(name)}/batch={batch_id - 1}"
        try:
            return self.spark.read.schema(schema).parquet(path)
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            raise RuntimeError(
                f"the state before batch {batch_id} is gone ({path}); restore it, or start a new monitor in another folder"
            ) from error

    def _first_batch(self, batch_id: int) -> int:
        """The number of this monitor's first batch, written down once."""
        path = self.table("first_batch")
        known = read_table(self.spark, path, FIRST_BATCH).first()
        if known is None:
            self.spark.createDataFrame([(batch_id,)], FIRST_BATCH).coalesce(1).write.parquet(path)
            return batch_id
        return known["batch"]

    def _save_progress(self, progress: tuple, batch_id: int) -> None:
        row = self.spark.createDataFrame([tuple(progress)], PROGRESS)
        write_batch(row.coalesce(1), self.table("progress"), batch_id)

    def _carry(self, progress: tuple, batch_id: int) -> None:
        """An empty batch is no window: it only hands the state on."""
        state = self._before("alert_state", ALERT_STATE, batch_id)
        write_batch(state, self.table("alert_state"), batch_id)
        self._save_progress(progress, batch_id)

    def _kept(self, rows: DataFrame, name: str, batch_id: int) -> DataFrame:
        """Write the rows of this batch and go on from the written ones."""
        write_batch(rows, self.table(name), batch_id)
        return self.spark.read.schema(rows.schema).parquet(f"{self.table(name)}/batch={batch_id}")

    def _fit(self, schema: T.StructType, batch_id: int) -> None:
        typed = T.StructType([*schema.fields, T.StructField("batch", T.LongType())])
        warm = read_table(self.spark, self.table("warmup_rows"), typed).where(F.col("batch") <= batch_id).drop("batch")
        # Only the batch that ends the warm-up fits; a repeat of it writes the same rows again.
        fitted = read_table(self.spark, self.table("detector/batch"), FIRST_BATCH).first()
        if fitted is not None and fitted["batch"] != batch_id:
            raise RuntimeError(f"batch {batch_id} would replace the detector that batch {fitted['batch']} fitted")
        marker = self.spark.createDataFrame([(batch_id,)], FIRST_BATCH).coalesce(1)
        marker.write.mode("overwrite").parquet(self.table("detector/batch"))
        sigma = mmd.bandwidth(warm, self.settings.numeric, self.key, self.settings.mmd)
        sigma.write.mode("overwrite").parquet(self.table("detector/sigma"))
        sums = mmd.component_sums(warm, [], self.settings.numeric, self._sigma(), self.settings.mmd)
        mmd.mean_embedding(sums).write.mode("overwrite").parquet(self.table("detector/mean"))
        if not self.settings.single_window_reference:
            self._save_reference(warm)

    def _save_reference(self, rows: DataFrame) -> None:
        save_reference(fit_reference(rows, self.settings, rows.columns).parts(), self.table("reference"))

    def _sigma(self):
        return self.spark.read.parquet(self.table("detector/sigma")).select("sigma").scalar()

    def _score(self, rows: DataFrame, profile: DataFrame, phase: str) -> DataFrame:
        """One settled row: the batch, its phase and its score."""
        batch_id = profile.first()[WINDOW]
        base = profile.select(WINDOW, "complete_rows", F.lit(phase).alias("phase"))
        if phase == WARMUP:
            scored = base.withColumn("mmd_score", F.lit(None).cast("double"))
        else:
            sums = mmd.component_sums(rows, [WINDOW], self.settings.numeric, self._sigma(), self.settings.mmd)
            mean = self.spark.read.parquet(self.table("detector/mean")).select("mean").scalar()
            distance = mmd.squared_distance(F.col("sums"), F.col("rows"), F.col("mean"))
            scored = base.join(
                sums.withColumn("mean", mean).select(WINDOW, distance.alias("mmd_score")), WINDOW, "left"
            )
        return self._kept(scored, "scores", batch_id)

    def _threshold(self, calibration: list[float]) -> float | None:
        """The threshold from the few calibrate scores."""
        scores = self.spark.createDataFrame([(CALIBRATE, s) for s in calibration], "phase string, mmd_score double")
        return mmd.calibrated_threshold(scores, self.settings.phases).first()["threshold"]

    @staticmethod
    def _decide(scored: DataFrame, phase: str, threshold: float | None) -> DataFrame:
        drifted = F.lit(phase == MONITORING) & mmd.is_drift(F.col("mmd_score"), F.col("mmd_threshold"))
        return scored.withColumn("mmd_threshold", F.lit(threshold).cast("double")).select(
            "*",
            drifted.alias("mmd_drift"),
            separation_ratio(F.col("mmd_score"), F.col("mmd_threshold")).alias("ratio"),
        )

    def _complementary(self, rows: DataFrame, profile: DataFrame) -> DataFrame:
        reference = load_reference(self.spark, self.table("reference"))
        values = value_counts(long_numeric(rows, [WINDOW], self.settings.numeric), [WINDOW, "feature"])
        categories = stats.category_counts(rows, [WINDOW], self.settings.categorical)
        nulls = stack_structs(
            profile,
            [WINDOW],
            [
                F.struct(F.lit(c).alias("feature"), rate(F.col(f"nulls_{c}"), F.col("total")).alias("null_rate"))
                for c in rows.columns
                if c != WINDOW
            ]
            + [
                # A column of the reference that this batch lacks is rated 0 and reported.
                F.struct(F.lit(c).alias("feature"), F.lit(0.0).alias("null_rate"))
                for c in self._reference_columns(reference)
                if c not in rows.columns
            ],
        )
        checks = self.settings.drift
        return complementary_report(
            drift.ks_windows(reference["values"], values, WINDOW, checks),
            drift.psi_windows(reference["bins"], values, WINDOW, checks),
            drift.chi2_windows(reference["frequencies"], categories, WINDOW, checks),
            drift.null_rate_windows(reference["null_rates"], nulls, WINDOW, checks),
            WINDOW,
        )

    @staticmethod
    def _reference_columns(reference: dict[str, DataFrame]) -> list[str]:
        """The columns the reference has null rates of: one small row each."""
        return [row["feature"] for row in reference["null_rates"].select("feature").collect()]

    def _alert(
        self, issues: DataFrame, scores: DataFrame, report: DataFrame | None, batch_id: int, window_no: int, at
    ) -> None:
        if not self.settings.alerts.enabled:
            return
        found = alerting.validation_candidates(issues, WINDOW).unionByName(alerting.mmd_candidates(scores, WINDOW))
        if report is not None:
            found = found.unionByName(alerting.drift_candidates(report, WINDOW))
        found = self._kept(found, "candidates", batch_id)
        state = self._before("alert_state", ALERT_STATE, batch_id)
        stepped = alerting.step_hysteresis(state, found, window_no, at, self.settings.alerts)
        stepped = self._kept(stepped, "alert_state", batch_id)
        fired = found.join(stepped.where("fired").select("alert_key"), "alert_key", "left_semi")
        sent = alerting.payload(fired, WINDOW, F.lit(at))
        write_batch(sent, self.table("alerts"), batch_id, "json")
        if self.handlers:
            route(sent, self.table("routed"), batch_id, WINDOW, self.handlers)
