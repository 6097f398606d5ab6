"""Per-feature drift checks of windows against a reference: KS, PSI, chi-squared
and null rates. Inputs are counted rows, results have one row per (window, feature)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.gaps import largest_gaps
from plumbline.functions.ranking import percentiles
from plumbline.functions.scalars import chi2_pvalue, ks_pvalue, psi_level, rate
from plumbline.functions.selection import percentiles_of
from plumbline.settings import DriftSettings

# Method names.
KS = "ks"
PSI = "psi"
CHI2 = "chi2"
NULL_RATE = "null_rate_drift"
MMD = "rff_mmd"


def pooled(counted: DataFrame, group: Sequence[str], value: str = "value") -> DataFrame:
    """Sum the counts of several windows into one set of values."""
    return counted.groupBy(*group, value).agg(F.sum("n").alias("n"))


def ks_windows(
    reference: DataFrame,
    current: DataFrame,
    window: str,
    settings: DriftSettings = DriftSettings(),
    cuts: DataFrame | None = None,
) -> DataFrame:
    """(window, feature, n_reference, n_current, ks_statistic, p_value, skipped, drifted).

    ``reference`` is (feature, value, n), ``current`` is (window, feature, value, n).
    Only the values of ranges that can hold the largest gap are ordered (``functions.gaps``).
    ``cuts`` may hold the reference's ``ranking.range_cuts``.
    """
    gaps = largest_gaps(reference, current, window, cuts).withColumnRenamed("gap", "ks_statistic")
    return ks_verdict(gaps, settings.ks_significance, settings.min_rows)


def ks_verdict(reduced: DataFrame, significance: float, min_rows: int) -> DataFrame:
    skipped = F.col("n_current") < min_rows
    p_value = ks_pvalue(F.col("ks_statistic"), F.col("n_reference"), F.col("n_current"))
    return (
        reduced.withColumn("skipped", skipped)
        .withColumn("p_value", F.when(~skipped, p_value))
        .withColumn("ks_statistic", F.when(~skipped, F.col("ks_statistic")))
        .withColumn("drifted", F.coalesce(F.col("p_value") < significance, F.lit(False)))
    )


def psi_edges(reference: DataFrame, bins: int, rows: DataFrame | None = None) -> DataFrame:
    """(feature, edges): the inner quantile edges of the reference, from its counted values or, without
    ordering them, from its ``rows`` (feature, value)."""
    shares = [i / bins for i in range(1, bins)]
    if rows is not None:
        found = percentiles_of(rows, ["feature"], shares)
    else:
        found = percentiles(reference, ["feature"], ["feature"], shares)
    return found.select("feature", F.col("percentiles").alias("edges"))


def bin_counts(counted: DataFrame, edges: DataFrame, group: Sequence[str], bins: int) -> DataFrame:
    """(group, bins array<bigint>): rows per bin, where a value on an edge belongs to
    the bin above; equal edges leave empty bins between them."""
    place = F.size(F.filter("edges", lambda edge: F.col("value") >= edge))
    # One array of edges per listed feature: a broadcast of known size.
    placed = counted.join(F.broadcast(edges), "feature").withColumn("_bin", place)
    slots = [F.coalesce(F.sum(F.when(F.col("_bin") == i, F.col("n"))), F.lit(0)) for i in range(bins)]
    return placed.groupBy(*group).agg(F.array(*slots).alias("bins"))


def psi_reference(reference: DataFrame, bins: int, rows: DataFrame | None = None) -> DataFrame:
    """(feature, edges, reference_bins): all that PSI needs of a reference. ``rows`` as in ``psi_edges``."""
    edges = psi_edges(reference, bins, rows)
    counts = bin_counts(reference, edges, ["feature"], bins).withColumnRenamed("bins", "reference_bins")
    return edges.join(counts, "feature")


def psi_windows(
    reference: DataFrame, current: DataFrame, window: str, settings: DriftSettings = DriftSettings()
) -> DataFrame:
    """(window, feature, n_current, psi, level, skipped, drifted).

    ``reference`` comes from ``psi_reference``, ``current`` is (window, feature,
    value, n).
    """
    observed = bin_counts(current, reference.select("feature", "edges"), [window, "feature"], settings.psi_bins)

    def total(counts: Column) -> Column:
        return F.aggregate(counts, F.lit(0).cast("long"), lambda sofar, n: sofar + n)

    joined = observed.join(F.broadcast(reference.select("feature", "reference_bins")), "feature")
    sized = joined.withColumns({"n_current": total(F.col("bins")), "n_reference": total(F.col("reference_bins"))})
    epsilon = F.lit(settings.psi_epsilon)
    parts = F.zip_with(
        "bins",
        "reference_bins",
        lambda c, r: (c / F.col("n_current") - r / F.col("n_reference"))
        * F.log((c / F.col("n_current") + epsilon) / (r / F.col("n_reference") + epsilon)),
    )
    skipped = F.col("n_current") < settings.min_rows
    value = F.aggregate(parts, F.lit(0.0), lambda sofar, part: sofar + part)
    return (
        sized.select(window, "feature", "n_current", skipped.alias("skipped"), F.when(~skipped, value).alias("psi"))
        .withColumn(
            "level",
            F.when(
                F.col("psi").isNotNull(), psi_level(F.col("psi"), settings.psi_warning, settings.psi_alert)
            ),
        )
        .withColumn("drifted", F.coalesce(F.col("psi") > settings.psi_warning, F.lit(False)))
    )


def reference_frequencies(counts: DataFrame) -> DataFrame:
    """(feature, category, reference_frequency) over rows that have a category."""
    pooled_counts = counts.where(F.col("category").isNotNull()).groupBy("feature", "category").agg(
        F.sum("n").alias("_n")
    )
    totals = pooled_counts.groupBy("feature").agg(F.sum("_n").alias("_total"))
    return pooled_counts.join(totals, "feature").select(
        "feature", "category", rate(F.col("_n"), F.col("_total")).alias("reference_frequency")
    )


def expected_and_observed(
    frequencies: DataFrame, current: DataFrame, settings: DriftSettings = DriftSettings()
) -> DataFrame:
    """(feature, category, observed, expected): the union of the reference and the
    current categories of one pooled set of rows (feature, category, n)."""
    counts = current.where(F.col("category").isNotNull())
    totals = counts.groupBy("feature").agg(F.sum("n").alias("_total"))
    both = frequencies.join(counts, ["feature", "category"], "full_outer").join(totals, "feature")
    share = F.coalesce("reference_frequency", F.lit(settings.psi_epsilon))
    return both.select(
        "feature",
        "category",
        F.coalesce("n", F.lit(0)).alias("observed"),
        (share * F.col("_total")).alias("expected"),
    )


def chi2_windows(
    frequencies: DataFrame, current: DataFrame, window: str, settings: DriftSettings = DriftSettings()
) -> DataFrame:
    """(window, feature, n_current, chi2_statistic, degrees, p_value, skipped, drifted).

    ``current`` is (window, feature, category, n). A reference category that a
    window lacks adds exactly its expected count to the statistic, so these terms
    come from totals and no grid of windows and categories is built.
    """
    counts = current.where(F.col("category").isNotNull())
    reference = frequencies.groupBy("feature").agg(
        F.count(F.lit(1)).alias("_categories"), F.sum("reference_frequency").alias("_share")
    )
    totals = counts.groupBy(window, "feature").agg(F.sum("n").alias("_total"))
    matched = counts.join(frequencies, ["feature", "category"], "left").join(totals, [window, "feature"])
    expected = F.coalesce("reference_frequency", F.lit(settings.psi_epsilon)) * F.col("_total")
    reduced = matched.groupBy(window, "feature").agg(
        F.sum("n").alias("n_current"),
        F.sum((F.col("n") - expected) * (F.col("n") - expected) / expected).alias("_present"),
        F.coalesce(F.sum("reference_frequency"), F.lit(0.0)).alias("_met"),
        F.count_if(F.col("reference_frequency").isNull()).alias("_new"),
        F.count("reference_frequency").alias("_seen"),
    )
    # One row per listed feature: a broadcast of known size.
    sized = reduced.join(F.broadcast(reference), "feature")
    absent = F.when(
        F.col("_seen") < F.col("_categories"), F.col("n_current") * (F.col("_share") - F.col("_met"))
    ).otherwise(F.lit(0.0))
    skipped = F.col("n_current") < settings.min_rows
    degrees = F.col("_categories") + F.col("_new") - 1
    return (
        sized.select(
            window,
            "feature",
            "n_current",
            skipped.alias("skipped"),
            F.when(~skipped, F.col("_present") + absent).alias("chi2_statistic"),
            degrees.alias("degrees"),
        )
        .withColumn("p_value", chi2_pvalue(F.col("chi2_statistic"), F.col("degrees")))
        .withColumn("drifted", F.coalesce(F.col("p_value") < settings.chi2_significance, F.lit(False)))
    )


def null_rate_windows(
    reference: DataFrame, current: DataFrame, window: str, settings: DriftSettings = DriftSettings()
) -> DataFrame:
    """(window, feature, baseline_null_rate, current_null_rate, delta, drifted).

    ``reference`` is (feature, null_rate); ``current`` comes from ``null_rates``,
    which gives every listed column a rate in every window.
    """
    base = reference.select("feature", F.col("null_rate").alias("baseline_null_rate"))
    # One row per column of the frame: a broadcast of known size.
    joined = current.join(F.broadcast(base), "feature")
    now = F.coalesce(F.col("null_rate"), F.lit(0.0))
    delta = F.abs(now - F.col("baseline_null_rate"))
    return joined.select(
        window,
        "feature",
        "baseline_null_rate",
        now.alias("current_null_rate"),
        delta.alias("delta"),
        (delta > settings.null_rate_delta).alias("drifted"),
    )


def null_rate_points(drift: DataFrame, limit: float = 5.0) -> DataFrame:
    """The same in percentage points: signed difference, and a flag above ``limit``."""
    points = (F.col("current_null_rate") - F.col("baseline_null_rate")) * 100
    return drift.select(
        *[c for c in drift.columns if c not in {"delta", "drifted"}],
        points.alias("delta_pp"),
        (F.abs(points) > limit).alias("alert"),
    )


# One long layout for the results of all methods.
def long_result(
    result: DataFrame, window: str, method: str, statistic: str, details: Sequence[str], level: str | None = None
) -> DataFrame:
    """(window, feature, method, statistic, p_value, level, drifted, skipped, details)."""

    def or_null(name: str | None, kind: str) -> Column:
        return (F.col(name) if name in result.columns else F.lit(None)).cast(kind)

    pairs = [part for name in details for part in (F.lit(name), F.col(name).cast("double"))]
    return result.select(
        window,
        "feature",
        F.lit(method).alias("method"),
        F.col(statistic).cast("double").alias("statistic"),
        or_null("p_value", "double").alias("p_value"),
        or_null(level, "string").alias("level"),
        "drifted",
        F.coalesce(or_null("skipped", "boolean"), F.lit(False)).alias("skipped"),
        F.create_map(*pairs).alias("details"),
    )


def drifted_features(report: DataFrame, window: str) -> DataFrame:
    """(window, drifted_features): sorted names, bounded by the listed features."""
    return (
        report.where(F.col("drifted") & (F.col("method") != MMD))
        .groupBy(window)
        .agg(F.array_sort(F.collect_set("feature")).alias("drifted_features"))
    )


