"""Named feature baselines kept as tables.

A registry is a folder with two kinds of data: ``data/``, where every register
writes ``stats`` and ``frequencies`` below a new folder of its own, and ``log/``, to
which every register and delete appends one small row. Readers look up the latest
log row of a name and read the folder it points to. Nothing is rewritten in place
and no name is part of a path, so a lost job, or one of two that register a name at
once, leaves at most an unreferenced folder behind.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from plumbline.operators.stats import (
    SNAPSHOT_SAMPLE,
    category_counts,
    category_frequencies,
    numeric_percentiles,
    numeric_stats,
    sample_arrays,
    value_sample,
)
from plumbline.settings import CATEGORICAL_FEATURES, NUMERIC_FEATURES

# Limits of the comparison.
MEAN_SHIFT_STDS = 2.0
NULL_DELTA = 0.05

_LOG = T.StructType(
    [
        T.StructField("baseline_name", T.StringType()),
        T.StructField("version", T.LongType()),
        T.StructField("action", T.StringType()),
        T.StructField("row_count", T.LongType()),
        T.StructField("features", T.IntegerType()),
        T.StructField("computed_at", T.TimestampType()),
        T.StructField("folder", T.StringType()),
    ]
)


def snapshot(
    df: DataFrame,
    by: Sequence[str],
    key: Sequence[str],
    numeric: Sequence[str] = NUMERIC_FEATURES,
    sample_size: int = SNAPSHOT_SAMPLE,
) -> DataFrame:
    """(by, feature, total, count, null_count, null_rate, mean, std, min, max,
    percentiles, sample): the numeric part of a baseline."""
    on = [*by, "feature"]
    stats = numeric_stats(df, by, numeric)
    shares = numeric_percentiles(df, by, numeric).drop("n")
    samples = sample_arrays(value_sample(df, by, numeric, key, sample_size), by)
    return stats.join(shares, on, "left").join(samples, on, "left")


def compare_numeric(baseline: DataFrame, current: DataFrame, on: Sequence[str] = ("feature",)) -> DataFrame:
    """(on, mean_shift, std_ratio, null_delta, drift_signal) of features in both.

    A missing or zero baseline deviation counts as 1; a missing mean counts as 0.
    """
    parts = ["mean", "std", "null_rate"]
    base = baseline.select(*on, *[F.col(p).alias(f"b_{p}") for p in parts])
    now = current.select(*on, *[F.col(p).alias(f"c_{p}") for p in parts])
    zero, one = F.lit(0.0), F.lit(1.0)
    base_std = F.coalesce(F.nullif(F.col("b_std"), zero), one)
    now_std = F.coalesce(F.nullif(F.col("c_std"), zero), one)
    shift = F.abs(F.coalesce("c_mean", zero) - F.coalesce("b_mean", zero))
    has_std = F.nullif(F.col("b_std"), zero).isNotNull()
    delta = F.abs(F.col("c_null_rate") - F.col("b_null_rate"))
    return base.join(now, list(on)).select(
        *on,
        shift.alias("mean_shift"),
        F.when(has_std, now_std / base_std).otherwise(one).alias("std_ratio"),
        delta.alias("null_delta"),
        ((shift > MEAN_SHIFT_STDS * base_std) | (delta > NULL_DELTA)).alias("drift_signal"),
    )


def category_changes(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """(feature, category, change): ``new`` and ``missing`` categories as rows, so a
    feature with very many of them needs no list in one row."""
    on = ["feature", "category"]
    base, now = (
        side.where(F.col("category").isNotNull()).select(*on).distinct() for side in (baseline, current)
    )
    new = now.join(base, on, "left_anti").withColumn("change", F.lit("new"))
    missing = base.join(now, on, "left_anti").withColumn("change", F.lit("missing"))
    return new.unionByName(missing)


def compare_categorical(baseline: DataFrame, current: DataFrame) -> DataFrame:
    """(feature, new_categories, missing_categories, drift_signal) with counts."""
    on = ["feature", "category"]
    base = baseline.where(F.col("category").isNotNull()).select(*on, F.lit(1).alias("_b")).distinct()
    now = current.where(F.col("category").isNotNull()).select(*on, F.lit(1).alias("_c")).distinct()
    counted = base.join(now, on, "full_outer").groupBy("feature").agg(
        F.count_if(F.col("_b").isNull()).alias("new_categories"),
        F.count_if(F.col("_c").isNull()).alias("missing_categories"),
    )
    return counted.withColumn("drift_signal", (F.col("new_categories") + F.col("missing_categories")) > 0)


# Fixed value: the message about a name that is not registered.
UNKNOWN_BASELINE = "Baseline '%s' not found"


class BaselineRegistry:
    """Register, read, compare, list and delete named baselines below one folder."""

    def __init__(
        self,
        spark: SparkSession,
        path: str,
        numeric: Sequence[str] = NUMERIC_FEATURES,
        categorical: Sequence[str] = CATEGORICAL_FEATURES,
    ):
        self.spark = spark
        self.path = path.rstrip("/")
        self.numeric = tuple(numeric)
        self.categorical = tuple(categorical)

    def _log(self) -> DataFrame:
        try:
            return self.spark.read.schema(_LOG).parquet(f"{self.path}/log")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], _LOG)

    def _latest(self) -> DataFrame:
        newest = Window.partitionBy("baseline_name").orderBy(F.desc("version"), F.desc("computed_at"), "folder")
        return self._log().withColumn("_rank", F.row_number().over(newest)).where("_rank = 1").drop("_rank")

    def _current(self) -> DataFrame:
        return self._latest().where(F.col("action") == "register")

    def _latest_row(self, name: str):
        return self._latest().where(F.col("baseline_name") == name).first()

    def _append_log(self, name: str, version: int, action: str, rows: int | None, folder: str | None = None) -> None:
        features = len(self.numeric) + len(self.categorical)
        self.spark.range(1).select(
            F.lit(name).alias("baseline_name"),
            F.lit(version).cast("long").alias("version"),
            F.lit(action).alias("action"),
            F.lit(rows).cast("long").alias("row_count"),
            F.lit(features).alias("features"),
            F.current_timestamp().alias("computed_at"),
            F.lit(folder).cast("string").alias("folder"),
        ).coalesce(1).write.mode("append").parquet(f"{self.path}/log")

    def _table(self, part: str, folder: str) -> str:
        return f"{self.path}/data/{folder}/{part}"

    def register(self, name: str, df: DataFrame, key: Sequence[str], overwrite: bool = False) -> bool:
        """Compute and store a baseline; False if the name exists and is kept."""
        known = self._latest_row(name)
        if known is not None and known["action"] == "register" and not overwrite:
            return False
        version = known["version"] + 1 if known is not None else 1
        numeric = [c for c in self.numeric if c in df.columns]
        categorical = [c for c in self.categorical if c in df.columns]
        folder = uuid.uuid4().hex
        snapshot(df, [], key, numeric).write.parquet(self._table("stats", folder))
        counts = category_counts(df, [], categorical)
        category_frequencies(counts, [], include_null=True).write.parquet(self._table("frequencies", folder))
        rows = self.spark.read.parquet(self._table("stats", folder)).agg(F.max("total")).first()[0]
        self._append_log(name, version, "register", rows if rows is not None else 0, folder)
        return True

    def names(self) -> DataFrame:
        return self._current().select("baseline_name")

    def unknown(self, asked: DataFrame, name: str = "baseline_name") -> DataFrame:
        """``asked`` with ``error``: what ``stats`` would raise for the name, null for a known one.

        One join with the registry's log, however many names are asked for; a null name is unknown.
        """
        known = self.names().withColumnRenamed("baseline_name", "_known")
        found = asked.join(known, F.col(name) == F.col("_known"), "left")
        error = F.format_string(UNKNOWN_BASELINE, F.col(name))
        return found.withColumn("error", F.when(F.col("_known").isNull(), error)).drop("_known")

    def summary(self) -> DataFrame:
        return self._current().select("baseline_name", "row_count", "features", "computed_at")

    def _read(self, part: str, name: str) -> DataFrame:
        known = self._latest_row(name)
        if known is None or known["action"] != "register":
            raise ValueError(UNKNOWN_BASELINE % name)
        return self.spark.read.parquet(self._table(part, known["folder"])).withColumn(
            "baseline_name", F.lit(name)
        )

    def stats(self, name: str) -> DataFrame:
        return self._read("stats", name)

    def frequencies(self, name: str) -> DataFrame:
        return self._read("frequencies", name)

    def compare(self, name: str, df: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The numeric and the categorical comparison of a frame with a baseline."""
        # Columns that the frame lacks are not compared.
        numeric, categorical = ([c for c in names if c in df.columns] for names in (self.numeric, self.categorical))
        frequencies = self.frequencies(name).where(F.col("feature").isin(categorical))
        stats = self.stats(name)
        none = F.lit(False)
        return (
            compare_numeric(stats, numeric_stats(df, [], numeric) if numeric else stats.where(none)),
            compare_categorical(
                frequencies, category_counts(df, [], categorical) if categorical else frequencies.where(none)
            ),
        )

    def delete(self, name: str) -> bool:
        """Mark a name as deleted; False if there is none."""
        known = self._latest_row(name)
        if known is None or known["action"] != "register":
            return False
        self._append_log(name, known["version"] + 1, "delete", None)
        return True


# Reference tables of the drift checks.
REFERENCE_PARTS = ("values", "bins", "frequencies", "null_rates")


def save_reference(parts: dict[str, DataFrame], path: str) -> None:
    """Write the reference of the drift checks, one table per part."""
    for part in REFERENCE_PARTS:
        parts[part].write.mode("overwrite").parquet(f"{path.rstrip('/')}/{part}")


def load_reference(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    return {part: spark.read.parquet(f"{path.rstrip('/')}/{part}") for part in REFERENCE_PARTS}


