"""Whole-table plans: the drift report and the metrics of every window."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.frames import is_complete, long_numeric, stack_structs
from plumbline.functions.ranking import value_counts
from plumbline.operators import alerts as alerting
from plumbline.operators import drift, mmd, stats, validate
from plumbline.operators.phases import CALIBRATE, MONITORING, WARMUP, add_phases
from plumbline.session import settle
from plumbline.settings import Settings

ROW_GROUP_BYTES = 4 << 20


@dataclass
class Reference:
    """What the per-feature checks compare with."""

    values: DataFrame  # feature, value, n
    bins: DataFrame  # feature, edges, reference_bins
    frequencies: DataFrame  # feature, category, reference_frequency
    null_rates: DataFrame  # feature, null_rate

    def parts(self) -> dict[str, DataFrame]:
        return {
            "values": self.values,
            "bins": self.bins,
            "frequencies": self.frequencies,
            "null_rates": self.null_rates,
        }


def fit_reference(df: DataFrame, settings: Settings, null_columns: Sequence[str]) -> Reference:
    """The reference from a frame of reference rows."""
    rows = long_numeric(df, [], settings.numeric)
    values = value_counts(rows, ["feature"])
    return Reference(
        values,
        drift.psi_reference(values, settings.drift.psi_bins, rows),
        drift.reference_frequencies(stats.category_counts(df, [], settings.categorical)),
        validate.null_rates(df, [], null_columns),
    )


class WindowReport:
    """Drift and quality of every window of a table.

    ``window`` is a column; ``key`` names the columns that identify a row (used to
    draw repeatable samples). One pass counts rows, nulls and violations of all
    windows; that small profile is written to the shared folder, and phases,
    validity, null rates and metrics are read from it. The drift checks pass over their
    rows many times; a second pass writes the columns they need to the shared folder.
    """

    def __init__(
        self,
        df: DataFrame,
        window: str,
        key: Sequence[str],
        settings: Settings = Settings(),
        null_columns: Sequence[str] | None = None,
    ):
        self.df, self.window, self.key, self.settings = df, window, list(key), settings
        self.null_columns = [c for c in df.columns if c != window] if null_columns is None else list(null_columns)

    @cached_property
    def profile(self) -> DataFrame:
        """One settled row per window: counters, null counts and the phase."""
        aggregates = [
            *validate.counters(validate.checks_for(self.df, self.settings.rules)),
            F.count_if(is_complete(self.settings.numeric)).alias("complete_rows"),
            *[F.count_if(F.col(c).isNull()).alias(f"nulls_{c}") for c in self._counted_nulls],
        ]
        counted = self.df.groupBy(self.window).agg(*aggregates)
        if self.settings.phases.validity_floor is not None:
            counted = settle(counted, "counted")
            checked = validate.Validation(self.df, [self.window], self.settings.rules, counts=counted).validity()
            counted = counted.join(checked.select(self.window, "validity_rate"), self.window)
        return settle(add_phases(counted, self.window, self.settings.phases), "profile")

    @cached_property
    def rows(self) -> DataFrame:
        """The window, key and feature columns of the table, settled.

        What computes the columns (parsing, say) runs once, not in every filter of every pass. The
        row groups are small, so that later passes are spread evenly however few files were read.
        """
        wanted = dict.fromkeys([self.window, *self.key, *self.settings.numeric, *self.settings.categorical])
        kept = self.df.select(*[c for c in wanted if c in self.df.columns])
        # A column of nothing but nulls may have no type, which no file can hold.
        kept = kept.withColumns({f.name: F.col(f.name).cast("string") for f in kept.schema if isinstance(f.dataType, T.NullType)})
        return settle(kept, "rows", **{"parquet.block.size": str(ROW_GROUP_BYTES)})

    @property
    def _counted_nulls(self) -> list[str]:
        wanted = dict.fromkeys([*self.null_columns, *self.settings.numeric])
        return [c for c in wanted if c in self.df.columns]

    @property
    def phases(self) -> DataFrame:
        floor = [c for c in ("calibrates",) if c in self.profile.columns]
        return self.profile.select(
            self.window, F.col("total").alias("rows"), "complete_rows", "windows_before", "windows_after", "phase", *floor
        )

    @cached_property
    def reference_windows(self) -> DataFrame:
        """The windows the per-feature reference is taken from: all of the warm-up, or the first
        calibrate window that counts."""
        if not self.settings.single_window_reference:
            return self.profile.where(F.col("phase") == WARMUP).select(self.window)
        first = self.profile.where((F.col("phase") == CALIBRATE) & (F.col("windows_after") > F.col("windows_before")))
        return first.select(self.window).orderBy(self.window).limit(1)

    def _in_reference(self, rows: DataFrame) -> DataFrame:
        return rows.join(self.reference_windows, self.window, "left_semi")

    def with_phase(self, reduced: DataFrame) -> DataFrame:
        return reduced.join(self.profile.select(self.window, "phase"), self.window)

    # MMD -----------------------------------------------------------------
    @cached_property
    def sigma(self) -> DataFrame:
        warm = self.rows.join(
            self.profile.where(F.col("phase") == WARMUP).select(self.window), self.window, "left_semi"
        )
        return settle(mmd.bandwidth(warm, self.settings.numeric, self.key, self.settings.mmd), "sigma")

    @cached_property
    def component_sums(self) -> DataFrame:
        sigma = self.sigma.select("sigma").scalar()
        sums = mmd.component_sums(self.rows, [self.window], self.settings.numeric, sigma, self.settings.mmd)
        return settle(sums, "component-sums")

    @cached_property
    def scores(self) -> DataFrame:
        return mmd.score_windows(self.component_sums, self.phases, self.window, self.settings.phases)

    # per-feature checks -----------------------------------------------------
    @cached_property
    def counted_values(self) -> DataFrame:
        rows = long_numeric(self.rows, [self.window], self.settings.numeric)
        return self.with_phase(value_counts(rows, [self.window, "feature"]))

    @cached_property
    def values(self) -> DataFrame:
        """(window, phase, feature, value, n): every value as a row of its own, not shuffled. The phase
        is joined to whole rows."""
        phases = self.profile.select(self.window, F.col("phase").alias("_phase"))
        keep = [F.col(self.window), F.col("_phase").alias("phase")]
        rows = long_numeric(self.rows.join(phases, self.window), keep, self.settings.numeric)
        return rows.where(F.col("value").isNotNull()).withColumn("n", F.lit(1).cast("long"))

    @cached_property
    def counted_categories(self) -> DataFrame:
        return self.with_phase(stats.category_counts(self.rows, [self.window], self.settings.categorical))

    def _current(self, counted: DataFrame) -> DataFrame:
        return counted.where(F.col("phase") == MONITORING).drop("phase")

    @cached_property
    def reference(self) -> Reference:
        nulls = self._in_reference(self.profile).agg(
            *[F.try_divide(F.sum(f"nulls_{c}").cast("double"), F.sum("total")).alias(c) for c in self._listed_nulls]
        )
        rows = long_numeric(self._in_reference(self.rows), [], self.settings.numeric)
        values = value_counts(rows, ["feature"])
        return Reference(
            values,
            drift.psi_reference(values, self.settings.drift.psi_bins, rows),
            drift.reference_frequencies(self._in_reference(self.counted_categories)),
            stack_structs(
                nulls, [], [F.struct(F.lit(c).alias("feature"), F.col(c).alias("null_rate")) for c in self._listed_nulls]
            ),
        )

    @property
    def _listed_nulls(self) -> list[str]:
        return [c for c in self.null_columns if c in self.df.columns]

    def null_rates(self) -> DataFrame:
        """(window, phase, feature, null_rate) from the profile."""
        rates = [
            F.struct(
                F.lit(c).alias("feature"),
                F.try_divide(F.col(f"nulls_{c}").cast("double"), F.col("total")).alias("null_rate"),
            )
            for c in self._listed_nulls
        ]
        return stack_structs(self.profile, [self.window, "phase"], rates)

    def ks(self) -> DataFrame:
        rows = long_numeric(self._in_reference(self.rows), [], self.settings.numeric).where(F.col("value").isNotNull())
        reference = rows.withColumn("n", F.lit(1).cast("long"))
        return drift.ks_windows(reference, self._current(self.values), self.window, self.settings.drift)

    def psi(self) -> DataFrame:
        return drift.psi_windows(
            self.reference.bins, self._current(self.counted_values), self.window, self.settings.drift
        )

    def chi2(self) -> DataFrame:
        return drift.chi2_windows(
            self.reference.frequencies, self._current(self.counted_categories), self.window, self.settings.drift
        )

    def null_rate_drift(self) -> DataFrame:
        return drift.null_rate_windows(
            self.reference.null_rates, self._current(self.null_rates()), self.window, self.settings.drift
        )

    @cached_property
    def complementary(self) -> DataFrame:
        """The per-feature checks in the long layout, one row per window and check,
        settled because the report and the alerts both read them."""
        return settle(
            complementary_report(self.ks(), self.psi(), self.chi2(), self.null_rate_drift(), self.window),
            "complementary",
        )

    def report(self) -> DataFrame:
        """(window, feature, method, statistic, p_value, level, drifted, skipped,
        details): the MMD row of every window and, in monitoring, all checks."""
        return full_report(self.scores, self.complementary, self.window)

    # metrics and alerts -------------------------------------------------------
    def validation(self) -> validate.Validation:
        return validate.Validation(self.df, [self.window], self.settings.rules, counts=self.profile)

    def metrics(self) -> DataFrame:
        rates = self.profile.select(
            self.window,
            *[
                F.try_divide(F.col(f"nulls_{c}").cast("double"), F.col("total")).alias(c)
                if c in self.df.columns
                else F.lit(0.0).alias(c)
                for c in self.settings.numeric
            ],
        )
        return metrics_rows(self.scores, self.validation().validity(), rates, self.window, self.settings.numeric)

    @cached_property
    def candidates(self) -> DataFrame:
        found = (
            alerting.validation_candidates(self.validation().issues(), self.window)
            .unionByName(alerting.mmd_candidates(self.scores, self.window))
            .unionByName(alerting.drift_candidates(self.complementary, self.window))
        )
        return settle(found, "candidates")


def complementary_report(ks: DataFrame, psi: DataFrame, chi2: DataFrame, nulls: DataFrame, window: str) -> DataFrame:
    parts = [
        drift.long_result(ks, window, drift.KS, "ks_statistic", ["n_reference", "n_current"]),
        drift.long_result(psi, window, drift.PSI, "psi", ["n_current"], "level"),
        drift.long_result(chi2, window, drift.CHI2, "chi2_statistic", ["n_current", "degrees"]),
        drift.long_result(
            nulls, window, drift.NULL_RATE, "delta", ["baseline_null_rate", "current_null_rate"]
        ),
    ]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def full_report(scores: DataFrame, complementary: DataFrame, window: str) -> DataFrame:
    # An empty name stands for "all numeric features together".
    joint = scores.withColumns({"feature": F.lit(""), "drifted": F.col("mmd_drift")})
    joint = drift.long_result(joint, window, drift.MMD, "mmd_score", ["mmd_threshold", "ratio"])
    return joint.unionByName(complementary)


def metrics_rows(
    scores: DataFrame, validity: DataFrame, null_rates: DataFrame, window: str, numeric: Sequence[str]
) -> DataFrame:
    """One row per window: phase, score, threshold, drift flag, validity, row count
    and the null rate of every numeric feature."""
    rates = null_rates.select(window, *[F.col(n).alias(f"null_rate_{n}") for n in numeric])
    return (
        scores.select(window, "phase", "mmd_score", "mmd_threshold", "mmd_drift")
        .join(validity.select(window, "validity_rate", "issue_count", F.col("total").alias("row_count")), window)
        .join(rates, window)
    )
