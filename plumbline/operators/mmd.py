"""Maximum mean discrepancy with random Fourier features.

A window is reduced to the sums of D cosine features. Sums add up, so a task
sends one small row per window to the shuffle however many rows it has read, and
the reference embedding is the sum over the warm-up windows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.frames import complete_rows, long_numeric
from plumbline.functions.ranking import lowest_by
from plumbline.functions.scalars import clean, separation_ratio
from plumbline.functions.selection import medians
from plumbline.operators.phases import CALIBRATE, MONITORING, WARMUP
from plumbline.session import settle
from plumbline.settings import MmdSettings, PhaseSettings

_FLUSH_WINDOWS = 4096
_BLOCK_ROWS = 256
PAIR_BUCKET_ROWS = 100_000


def unit_draws(components: int, features: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Standard normal directions (D, p) and phase shifts (D); directions are
    divided by the bandwidth when they are applied."""
    generator = np.random.RandomState(seed)
    return generator.normal(size=(components, features)), generator.uniform(0.0, 2.0 * np.pi, components)


def parameter_table(df: DataFrame, features: Sequence[str], settings: MmdSettings) -> DataFrame:
    """(d, omega, bias): the draws as rows; their number is fixed by D."""
    directions, shifts = unit_draws(settings.components, len(features), settings.seed)
    return df.sparkSession.createDataFrame(
        [(d, directions[d].tolist(), float(shifts[d])) for d in range(settings.components)],
        "d int, omega array<double>, bias double",
    )


def hash_sample(df: DataFrame, key: Sequence[str], size: int) -> DataFrame:
    """The ``size`` rows with the lowest key hash: per task a bounded heap."""
    hashed = F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in key]))
    return df.withColumn("key_hash", hashed).orderBy("key_hash", *key).limit(size)


def median_bandwidth(sample: DataFrame, features: Sequence[str], group: Sequence[str] = ()) -> DataFrame:
    """(group, sigma): square root of half the median positive squared distance
    between the rows of a bounded sample, 1.0 if all rows are equal."""
    point = F.struct(*[clean(f).alias(f) for f in features])
    points = sample.groupBy(*group).agg(F.collect_list(point).alias("points"))

    def squared(a: Column, b: Column) -> Column:
        return sum(((a[f] - b[f]) * (a[f] - b[f]) for f in features), F.lit(0.0))

    later = F.transform(
        "points",
        lambda a, i: F.transform(F.slice(F.col("points"), i + 2, F.size("points")), lambda b: squared(a, b)),
    )
    positive = points.select(*group, F.array_sort(F.filter(F.flatten(later), lambda v: v > 0)).alias("v"))
    n = F.size("v")
    middle = (F.get("v", F.floor((n - 1) / 2).cast("int")) + F.get("v", F.floor(n / 2).cast("int"))) / 2
    return positive.select(*group, F.coalesce(F.sqrt(middle / 2), F.lit(1.0)).alias("sigma"))


def neighbour_pairs(
    rows: DataFrame, features: Sequence[str], key: Sequence[str], group: Sequence[str] = ()
) -> DataFrame:
    """(group, squared): squared distances of pairs of rows that follow each other by key hash.

    Every row is in one pair (the last of an odd bucket in none), so the pairs grow
    with the rows and are as random as the hash. Rows are ordered in hash buckets
    whose number follows from the row count; no task orders all of them.
    """
    hashed = F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in key]))
    buckets = max(1, rows.count() // PAIR_BUCKET_ROWS)
    placed = rows.withColumn("_hash", hashed).withColumn(
        "_bucket", F.pmod(F.conv(F.substring("_hash", 1, 8), 16, 10).cast("long"), F.lit(buckets))
    )
    order = Window.partitionBy(*group, "_bucket").orderBy("_hash", *key)
    point = F.struct(*[clean(f).alias(f) for f in features])
    pairs = placed.select(
        *group, point.alias("a"), F.lead(point).over(order).alias("b"), F.row_number().over(order).alias("_i")
    ).where((F.col("_i") % 2 == 1) & F.col("b").isNotNull())
    squared = sum(((F.col(f"a.{f}") - F.col(f"b.{f}")) * (F.col(f"a.{f}") - F.col(f"b.{f}")) for f in features), F.lit(0.0))
    return pairs.select(*group, squared.alias("squared"))


def pair_bandwidths(pairs: DataFrame, group: Sequence[str] = (), squared: str = "squared") -> DataFrame:
    """(group, sigma): square root of half the median positive squared distance of settled pairs,
    for all groups at a time; no row for a group without one."""
    middle = medians(pairs.where(F.col(squared) > 0), group, squared)
    return middle.select(*group, F.sqrt(F.col("median") / 2).alias("sigma"))


def bandwidth(df: DataFrame, features: Sequence[str], key: Sequence[str], settings: MmdSettings) -> DataFrame:
    """(sigma) of all complete rows of ``df``, or of a sample if one is set, or the configured value."""
    spark = df.sparkSession
    if settings.sigma is not None:
        return spark.range(1).select(F.lit(float(settings.sigma)).alias("sigma"))
    usable = complete_rows(df.select(*key, *[clean(f).alias(f) for f in features]), features)
    if settings.sample_size is not None:
        return median_bandwidth(hash_sample(usable, key, settings.sample_size), features)
    pairs = settle(neighbour_pairs(usable, features, key), "pairs")
    found = pair_bandwidths(pairs).select("sigma").scalar()
    return spark.range(1).select(F.coalesce(found, F.lit(1.0)).alias("sigma"))


def feature_bandwidths(values: DataFrame, features: Sequence[str], key: Sequence[str]) -> DataFrame:
    """(feature, sigma) of all rows of ``values`` (feature, value), one row per listed feature."""
    pairs = settle(neighbour_pairs(values, ["value"], key, ["feature"]), "pairs")
    listed = values.sparkSession.createDataFrame([(f,) for f in features], "feature string").coalesce(1)
    found = listed.join(pair_bandwidths(pairs, ["feature"]), "feature", "left")
    return found.select("feature", F.coalesce("sigma", F.lit(1.0)).alias("sigma"))


def component_sums(
    df: DataFrame, group: Sequence[str], features: Sequence[str], sigma: Column, settings: MmdSettings
) -> DataFrame:
    """(group, rows, sums array<double>): sums of the D cosine features per group.

    Numpy evaluates the D cosines of some hundred rows at once, which stay in the processor's
    cache; each task emits one row per group it has seen.
    """
    directions, shifts = unit_draws(settings.components, len(features), settings.seed)
    components = settings.components
    weights, scale = directions.T, float(np.sqrt(2.0 / components))
    rows = complete_rows(
        df.select(*group, *[clean(f).alias(f) for f in features], sigma.alias("_sigma")), [*features, "_sigma"]
    )
    group_fields = [rows.schema[g] for g in group]
    partial = T.StructType(
        [
            *group_fields,
            T.StructField("rows", T.LongType()),
            T.StructField("sums", T.ArrayType(T.DoubleType())),
        ]
    )
    names = list(group)

    def partial_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}
        key_types: list[pa.DataType] = []

        def emit() -> pa.RecordBatch:
            keys = list(held)
            columns = [pa.array([k[i] for k in keys], type=key_types[i]) for i in range(len(names))]
            columns.append(pa.array([held[k][0] for k in keys], type=pa.int64()))
            columns.append(pa.array([held[k][1].tolist() for k in keys], type=pa.list_(pa.float64())))
            return pa.RecordBatch.from_arrays(columns, names=[*names, "rows", "sums"])

        for batch in batches:
            if batch.num_rows == 0:
                continue
            key_types = [batch.schema.field(n).type for n in names]
            codes = np.zeros(batch.num_rows, dtype=np.int64)
            for name in names:
                encoded = batch.column(name).dictionary_encode()
                codes = codes * (len(encoded.dictionary) + 1) + encoded.indices.fill_null(
                    len(encoded.dictionary)
                ).to_numpy(zero_copy_only=False)
            order = np.argsort(codes, kind="stable")
            starts = np.flatnonzero(np.r_[True, np.diff(codes[order]) != 0])
            points = np.column_stack([batch.column(f).to_numpy(zero_copy_only=False) for f in features])[order]
            spread = batch.column("_sigma").to_numpy(zero_copy_only=False)[order, None]
            sums = np.zeros((len(starts), components))
            for at in range(0, batch.num_rows, _BLOCK_ROWS):
                cosines = points[at : at + _BLOCK_ROWS] @ weights
                cosines /= spread[at : at + _BLOCK_ROWS]
                cosines += shifts
                np.cos(cosines, out=cosines)
                first, last = np.searchsorted(starts, [at, at + len(cosines) - 1], "right") - 1
                cuts = np.maximum(starts[first : last + 1] - at, 0)
                sums[first : last + 1] += np.add.reduceat(cosines, cuts, axis=0)
            sums *= scale
            sizes = np.diff(np.r_[starts, batch.num_rows])
            firsts = batch.select(names).take(pa.array(order[starts])) if names else None
            for i in range(len(starts)):
                key = tuple(firsts.column(j)[i].as_py() for j in range(len(names))) if names else ()
                known = held.get(key)
                if known is None:
                    held[key] = [int(sizes[i]), sums[i]]
                else:
                    known[0] += int(sizes[i])
                    known[1] = known[1] + sums[i]
            if len(held) >= _FLUSH_WINDOWS:
                yield emit()
                held = {}
        if held:
            yield emit()

    return add_sums(rows.mapInArrow(partial_sums, partial), group)


def add_sums(partials: DataFrame, group: Sequence[str]) -> DataFrame:
    """Add up (group, rows, sums) rows component by component."""
    parts = partials.select(*group, "rows", F.posexplode("sums").alias("d", "part"))
    merged = parts.groupBy(*group, "d").agg(F.sum("rows").alias("rows"), F.sum("part").alias("part"))
    packed = F.array_sort(F.collect_list(F.struct("d", "part")))
    return merged.groupBy(*group).agg(
        F.max("rows").alias("rows"), F.transform(packed, lambda p: p["part"]).alias("sums")
    )


def mean_embedding(sums: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """(group, mean array<double>) of the rows in ``sums``, which are few."""
    total = add_sums(sums.select(*group, "rows", "sums"), group)
    return total.select(*group, F.transform("sums", lambda s: s / F.col("rows")).alias("mean"))


def squared_distance(sums: Column, rows: Column, mean: Column) -> Column:
    """Squared distance between the mean of a window and the reference mean."""
    return F.aggregate(
        F.zip_with(sums, mean, lambda s, m: (s / rows - m) * (s / rows - m)),
        F.lit(0.0),
        lambda total, part: total + part,
    )


def score_windows(
    sums: DataFrame, phases: DataFrame, window: str, phase_settings: PhaseSettings = PhaseSettings()
) -> DataFrame:
    """(window, rows, complete_rows, phase, mmd_score, mmd_threshold, mmd_drift, ratio).

    ``sums`` holds the component sums of every window. Warm-up windows form the
    reference and have no score; the threshold is a percentile of the calibrate
    scores and is known from the last calibrate window on.
    """
    placed = phases.join(sums.select(window, F.col("rows").alias("_n"), "sums"), window, "left")
    warm = placed.where((F.col("phase") == WARMUP) & F.col("_n").isNotNull())
    mean = mean_embedding(warm.select(F.col("_n").alias("rows"), "sums"))
    distance = squared_distance(F.col("sums"), F.col("_n"), F.col("_mean"))
    scored = (
        placed.withColumn("_mean", mean.select("mean").scalar())
        .withColumn("mmd_score", F.when(F.col("phase") != WARMUP, distance))
        .drop("sums", "_n", "_mean")
    )
    return apply_threshold(scored, window, phase_settings)


def calibrated_threshold(scored: DataFrame, settings: PhaseSettings) -> DataFrame:
    """(threshold, calibration_scores_count) from the scores of the calibrate windows; ``calibrates`` may
    say which of them count."""
    chosen = F.col("phase") == CALIBRATE
    if "calibrates" in scored.columns:
        chosen = chosen & F.col("calibrates")
    return scored.where(chosen).agg(
        F.percentile("mmd_score", settings.calibrate_percentile / 100.0).alias("threshold"),
        F.count("mmd_score").alias("calibration_scores_count"),
    )


def is_drift(score: Column, threshold: Column) -> Column:
    """Strictly above the threshold; missing or NaN values are no drift."""
    return F.coalesce(~F.isnan(score) & (score > threshold), F.lit(False))


def apply_threshold(scored: DataFrame, window: str, settings: PhaseSettings) -> DataFrame:
    threshold = calibrated_threshold(scored, settings).select("threshold").scalar()
    known = F.col("windows_after") >= settings.warmup_windows + settings.calibrate_windows
    return scored.withColumn("mmd_threshold", F.when(known, threshold)).select(
        window,
        "rows",
        "complete_rows",
        "phase",
        *[c for c in ("calibrates",) if c in scored.columns],
        "mmd_score",
        "mmd_threshold",
        ((F.col("phase") == MONITORING) & is_drift(F.col("mmd_score"), F.col("mmd_threshold"))).alias("mmd_drift"),
        separation_ratio(F.col("mmd_score"), F.col("mmd_threshold")).alias("ratio"),
    )


def detector_summary(scored: DataFrame, sigma: DataFrame, settings: MmdSettings, phases: PhaseSettings) -> DataFrame:
    """One row: sigma, n_components, threshold, calibration_scores_count."""
    return calibrated_threshold(scored, phases).select(
        sigma.select("sigma").scalar().alias("sigma"),
        F.lit(settings.components).alias("n_components"),
        "threshold",
        "calibration_scores_count",
    )


def feature_scores(
    df: DataFrame,
    phases: DataFrame,
    window: str,
    features: Sequence[str],
    key: Sequence[str],
    settings: MmdSettings = MmdSettings(),
) -> DataFrame:
    """(window, feature, score) of every window after warm-up: the distance in one
    feature alone, each with its own bandwidth from the warm-up rows."""
    placed = df.join(phases.select(window, "phase"), window)
    values = long_numeric(placed, [window, "phase", *key], features).where(F.col("value").isNotNull())
    warm = values.where(F.col("phase") == WARMUP)
    if settings.sample_size is None:
        sigmas = feature_bandwidths(warm, features, key)
    else:
        hashed = F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in key]))
        by = [F.col("key_hash"), *[F.col(k) for k in key]]
        sample = lowest_by(warm.withColumn("key_hash", hashed), ["feature"], by, settings.sample_size)
        sigmas = median_bandwidth(sample, ["value"], ["feature"])
    # One bandwidth per listed feature, so the broadcast has a known size.
    with_sigma = values.join(F.broadcast(sigmas), "feature")
    sums = component_sums(with_sigma, [window, "phase", "feature"], ["value"], F.col("sigma"), settings)
    sums = settle(sums, "feature-sums")  # read twice, and far smaller than the table
    mean = mean_embedding(sums.where(F.col("phase") == WARMUP), ["feature"])
    return (
        sums.where(F.col("phase") != WARMUP)
        .join(F.broadcast(mean), "feature")
        .select(window, "feature", squared_distance(F.col("sums"), F.col("rows"), F.col("mean")).alias("score"))
    )


def top_feature(scores: DataFrame, window: str) -> DataFrame:
    """(window, feature, score) of the feature that has moved most."""
    return scores.groupBy(window).agg(
        F.max_by("feature", F.struct("score", "feature")).alias("feature"), F.max("score").alias("score")
    )
