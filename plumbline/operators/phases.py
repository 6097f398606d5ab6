"""The warm-up, calibrate and monitoring phases of a sequence of windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.frames import is_complete
from plumbline.settings import PhaseSettings

# Phase names.
WARMUP = "warmup"
CALIBRATE = "calibrate"
MONITORING = "monitoring"


def phase_of(windows_before: Column, settings: PhaseSettings) -> Column:
    first = settings.warmup_windows
    return (
        F.when(windows_before < first, F.lit(WARMUP))
        .when(windows_before < first + settings.calibrate_windows, F.lit(CALIBRATE))
        .otherwise(F.lit(MONITORING))
    )


def window_phases(
    df: DataFrame, window: str, numeric: Sequence[str], settings: PhaseSettings = PhaseSettings()
) -> DataFrame:
    """(window, rows, complete_rows, windows_before, windows_after, phase).

    A window counts once it has a complete row (every window does with
    ``count_incomplete``). Rows are reduced to one per window before the running
    count, so the unpartitioned ordering only sees the list of windows. A validity floor needs
    validity rates: see ``add_phases``.
    """
    if settings.validity_floor is not None:
        raise ValueError("a validity floor needs validity rates; use add_phases or WindowReport")
    reduced = df.groupBy(window).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(is_complete(numeric)).alias("complete_rows")
    )
    return add_phases(reduced, window, settings)


def add_phases(reduced: DataFrame, window: str, settings: PhaseSettings = PhaseSettings()) -> DataFrame:
    """Number the windows. With a validity floor ``reduced`` has a ``validity_rate``; windows after the
    warm-up that are below it do not count, as the added ``calibrates`` says."""
    counts = F.lit(1) if settings.count_incomplete else (F.col("complete_rows") > 0).cast("int")
    upto = Window.orderBy(window).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = reduced.withColumn("_counts", counts)
    if settings.validity_floor is not None:
        warm = F.sum("_counts").over(upto) - F.col("_counts") < settings.warmup_windows
        sound = F.coalesce(F.col("validity_rate") >= settings.validity_floor, F.lit(False))
        placed = placed.withColumn("_warm", warm).withColumn("calibrates", F.col("_warm") | sound)
        placed = placed.withColumn("_counts", F.when(F.col("calibrates"), F.col("_counts")).otherwise(0))
    return (
        placed.withColumn("windows_after", F.sum("_counts").over(upto))
        .withColumn("windows_before", F.col("windows_after") - F.col("_counts"))
        .withColumn("phase", phase_of(F.col("windows_before"), settings))
        .drop("_counts", "_warm")
    )


def windows_in(phases: DataFrame, window: str, phase: str) -> DataFrame:
    return phases.where(F.col("phase") == phase).select(window)


def rows_in(df: DataFrame, phases: DataFrame, window: str, phase: str) -> DataFrame:
    """The rows whose window is in the given phase."""
    return df.join(windows_in(phases, window, phase), window, "left_semi")
