"""Feature statistics, category frequencies, samples and histograms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions.frames import long_categorical, long_numeric, stack_structs
from plumbline.functions.ranking import lowest_by
from plumbline.functions.scalars import clean, rate
from plumbline.functions.selection import percentiles_of

# The percentiles of a snapshot and the size of its value sample.
SNAPSHOT_SHARES = (0.05, 0.25, 0.5, 0.75, 0.95)
SNAPSHOT_SAMPLE = 200

MAP_SIZE = 1000


def numeric_stats(df: DataFrame, by: Sequence[str], numeric: Sequence[str]) -> DataFrame:
    """(by, feature, total, count, null_count, null_rate, mean, std, min, max) with
    the population standard deviation: one pass, one row per task and group."""
    present = [name for name in numeric if name in df.columns]
    aggregates = [F.count(F.lit(1)).alias("total")]
    for name in present:
        value = clean(name)
        aggregates += [
            F.count(value).alias(f"{name}_count"),
            F.avg(value).alias(f"{name}_mean"),
            F.stddev_pop(value).alias(f"{name}_std"),
            F.min(value).alias(f"{name}_min"),
            F.max(value).alias(f"{name}_max"),
        ]
    wide = df.groupBy(*by).agg(*aggregates)
    stacked = stack_structs(
        wide,
        [*by, "total"],
        [
            F.struct(
                F.lit(name).alias("feature"),
                *[F.col(f"{name}_{part}").alias(part) for part in ("count", "mean", "std", "min", "max")],
            )
            for name in present
        ],
    )
    missing = F.col("total") - F.col("count")
    return stacked.withColumns({"null_count": missing, "null_rate": rate(missing, F.col("total"))})


def numeric_percentiles(
    df: DataFrame,
    by: Sequence[str],
    numeric: Sequence[str],
    shares: Sequence[float] = SNAPSHOT_SHARES,
    accuracy: int | None = None,
) -> DataFrame:
    """(by, feature, n, percentiles): exact, or from a sketch when an accuracy is given."""
    rows = long_numeric(df, by, numeric)
    group = [*by, "feature"]
    if accuracy is not None:
        sketch = F.percentile_approx("value", [float(s) for s in shares], accuracy)
        return (
            rows.where(F.col("value").isNotNull())
            .groupBy(*group)
            .agg(F.count("value").alias("n"), sketch.alias("percentiles"))
        )
    present = [name for name in numeric if name in df.columns]

    def sketch(asked: Sequence[float], accuracy: int) -> DataFrame:
        """One row of the table feeds the sketches of all its features."""
        aggregates = []
        for name in present:
            aggregates += [
                F.count(clean(name)).alias(f"{name}_n"),
                F.percentile_approx(clean(name), list(asked), accuracy).alias(f"{name}_q"),
            ]
        parts = [
            F.struct(F.lit(name).alias("feature"), F.col(f"{name}_n").alias("n"), F.col(f"{name}_q").alias("_q"))
            for name in present
        ]
        return stack_structs(df.groupBy(*by).agg(*aggregates), by, parts).where(F.col("n") > 0)

    return percentiles_of(rows, group, shares, sketch=sketch if present else None)


def value_sample(
    df: DataFrame, by: Sequence[str], numeric: Sequence[str], key: Sequence[str], size: int = SNAPSHOT_SAMPLE
) -> DataFrame:
    """(by, feature, sample_rank, key_hash, value): the values of the ``size`` lowest
    key hashes, so the same rows are picked on every run."""
    rows = long_numeric(
        df.withColumn("key_hash", F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in key]))),
        [*by, "key_hash"],
        numeric,
    ).where(F.col("value").isNotNull())
    return lowest_by(rows, [*by, "feature"], [F.col("key_hash"), F.col("value")], size, "sample_rank")


def sample_arrays(sample: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, feature, sample): the bounded sample as one array in rank order."""
    pairs = F.array_sort(F.collect_list(F.struct("sample_rank", "value")))
    return sample.groupBy(*by, "feature").agg(F.transform(pairs, lambda p: p["value"]).alias("sample"))


def category_counts(df: DataFrame, by: Sequence[str], categorical: Sequence[str]) -> DataFrame:
    """(by, feature, category, n), the null category included."""
    return (
        long_categorical(df, by, categorical)
        .groupBy(*by, "feature", "category")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def category_frequencies(
    counts: DataFrame, by: Sequence[str], include_null: bool = False, of_all_rows: bool = True
) -> DataFrame:
    """(by, feature, category, n, frequency). The denominator is all rows, or with
    ``of_all_rows=False`` the rows that have a category."""
    group = [*by, "feature"]
    weighed = counts if of_all_rows else counts.where(F.col("category").isNotNull())
    totals = weighed.groupBy(*group).agg(F.sum("n").alias("_total"))
    kept = counts if include_null else counts.where(F.col("category").isNotNull())
    return kept.join(totals, group).withColumn("frequency", rate(F.col("n"), F.col("_total"))).drop("_total")


def categorical_stats(counts: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, feature, null_count, null_rate, cardinality) from category counts."""
    nulls = F.sum(F.when(F.col("category").isNull(), F.col("n")).otherwise(F.lit(0)))
    return counts.groupBy(*by, "feature").agg(
        nulls.alias("null_count"),
        rate(nulls, F.sum("n")).alias("null_rate"),
        F.count("category").alias("cardinality"),
    )


def approx_cardinality(df: DataFrame, by: Sequence[str], categorical: Sequence[str], rsd: float = 0.02) -> DataFrame:
    """(by, feature, cardinality) from a sketch, without a shuffle per category."""
    wide = df.groupBy(*by).agg(*[F.approx_count_distinct(c, rsd).alias(c) for c in categorical])
    return stack_structs(
        wide, by, [F.struct(F.lit(c).alias("feature"), F.col(c).alias("cardinality")) for c in categorical]
    )


def frequency_maps(
    counts: DataFrame, by: Sequence[str], most: int = MAP_SIZE, of_all_rows: bool = True
) -> DataFrame:
    """(by, feature, frequencies, other_categories, other_frequency) from category counts: the ``most``
    most frequent categories as a map, ties to the smaller name, and what all others add up to.
    The denominator is that of ``category_frequencies``, whose rows have every category.

    A column may have any number of categories. Each task keeps ``most`` of a group and sums the rest before
    the shuffle, and totals meet the kept ones in one grouping, so no task sees all categories of a group.
    """
    group = [*by, "feature"]
    named = F.when(F.col("category").isNotNull(), F.col("n"))
    whole = counts.groupBy(*group).agg(
        F.count("category").alias("_others"),
        F.sum(named).alias("_rows"),
        F.sum("n" if of_all_rows else named).alias("_total"),
    )
    top = lowest_by(counts.where(F.col("category").isNotNull()), group, [F.desc("n"), F.col("category")], most).select(
        *group,
        F.struct("category", "n").alias("_entry"),
        F.lit(-1).cast("long").alias("_others"),
        (-F.col("n")).alias("_rows"),
    )
    both = whole.unionByName(top, allowMissingColumns=True).groupBy(*group)
    found = both.agg(
        F.collect_list("_entry").alias("_entries"),
        *[F.sum(c).alias(c) for c in ("_others", "_rows", "_total")],
    )
    shares = F.transform("_entries", lambda e: F.struct(e["category"], rate(e["n"], F.col("_total"))))
    return found.select(
        *group,
        F.map_from_entries(shares).alias("frequencies"),
        F.col("_others").alias("other_categories"),
        F.coalesce(rate(F.col("_rows"), F.col("_total")), F.lit(0.0)).alias("other_frequency"),
    )


def describe(df: DataFrame, by: Sequence[str], numeric: Sequence[str]) -> DataFrame:
    """(by, feature, count, mean, stddev, min, p25, p50, p75, max) with the sample
    standard deviation and exact quartiles."""
    base = numeric_stats(df, by, numeric)
    quartiles = numeric_percentiles(df, by, numeric, (0.25, 0.5, 0.75)).drop("n")
    spread = F.col("std") * F.sqrt(F.try_divide(F.col("count"), F.col("count") - 1))
    return base.join(quartiles, [*by, "feature"], "left").select(
        *by,
        "feature",
        "count",
        "mean",
        spread.alias("stddev"),
        "min",
        F.col("percentiles")[0].alias("p25"),
        F.col("percentiles")[1].alias("p50"),
        F.col("percentiles")[2].alias("p75"),
        "max",
    )


def histogram(df: DataFrame, numeric: Sequence[str], bins: int = 30) -> DataFrame:
    """(feature, bin, bin_low, bin_high, n): equal-width bins from minimum to maximum,
    empty ones included; the last bin holds the maximum."""
    rows = long_numeric(df, [], numeric).where(F.col("value").isNotNull())
    edges = rows.groupBy("feature").agg(F.min("value").alias("low"), F.max("value").alias("high"))
    wide = F.col("high") > F.col("low")
    low = F.when(wide, F.col("low")).otherwise(F.col("low") - 0.5)
    width = F.when(wide, (F.col("high") - F.col("low")) / bins).otherwise(F.lit(1.0 / bins))
    edges = edges.select("feature", low.alias("low"), width.alias("width"))
    # One row of edges per listed feature, so its size is known before the run.
    placed = rows.join(F.broadcast(edges), "feature").select(
        "feature",
        F.least(F.floor((F.col("value") - F.col("low")) / F.col("width")), F.lit(bins - 1)).cast("int").alias("bin"),
    )
    counted = placed.groupBy("feature", "bin").agg(F.count(F.lit(1)).alias("n"))
    grid = edges.select("feature", "low", "width", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return grid.join(counted, ["feature", "bin"], "left").select(
        "feature",
        "bin",
        (F.col("low") + F.col("bin") * F.col("width")).alias("bin_low"),
        (F.col("low") + (F.col("bin") + 1) * F.col("width")).alias("bin_high"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


def score_summary(scores: DataFrame, label: str, score: str, threshold: str) -> DataFrame:
    """(label, windows, mean, min, max, flagged) over rows with a score."""
    value = F.col(score)
    return (
        scores.where(value.isNotNull())
        .groupBy(label)
        .agg(
            F.count(F.lit(1)).alias("windows"),
            F.avg(value).alias("mean"),
            F.min(value).alias("min"),
            F.max(value).alias("max"),
            F.count_if(value > F.col(threshold)).alias("flagged"),
        )
    )


def window_row_counts(df: DataFrame, window: Sequence[str]) -> DataFrame:
    return df.groupBy(*window).agg(F.count(F.lit(1)).alias("rows"))


def latest(df: DataFrame, order: str, k: int) -> DataFrame:
    """The k newest rows, newest first (a top-k per task, then a merge)."""
    return df.orderBy(F.desc(order)).limit(k)


