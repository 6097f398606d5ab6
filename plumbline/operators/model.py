"""Model monitoring: predictions joined with delayed labels, score and label-rate
drift, and accuracy and AUC over the last matched pairs."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.ranking import lowest_by, running_sums, value_counts
from plumbline.functions.scalars import rate
from plumbline.operators.drift import ks_windows, pooled
from plumbline.operators.phases import MONITORING, WARMUP
from plumbline.session import settle
from plumbline.settings import DriftSettings, ModelSettings


def latest_labels(labels: DataFrame, time: str = "label_ts") -> DataFrame:
    """(event_id, true_label, <time>): the newest label of every event."""
    newest = F.max_by("true_label", F.struct(time, "true_label"))
    return labels.groupBy("event_id").agg(newest.alias("true_label"), F.max(time).alias(time))


def match_labels(
    predictions: DataFrame, labels: DataFrame, time: str = "label_ts", how: str = "inner"
) -> DataFrame:
    """Predictions with the newest label of their event. Both sides are shuffled by
    the event id, which is fine-grained, so no key gathers many rows."""
    return predictions.join(latest_labels(labels, time), "event_id", how)


def model_phases(predictions: DataFrame, window: str, settings: ModelSettings = ModelSettings()) -> DataFrame:
    """(window, n_predictions, position, phase): the first windows are warm-up. Rows
    are reduced to one per window before they are numbered."""
    reduced = predictions.groupBy(window).agg(F.count(F.lit(1)).alias("n_predictions"))
    position = F.row_number().over(Window.orderBy(window))
    return reduced.withColumn("position", position).withColumn(
        "phase", F.when(F.col("position") <= settings.warmup_windows, F.lit(WARMUP)).otherwise(F.lit(MONITORING))
    )


def warmup_baseline(predictions: DataFrame, phases: DataFrame, window: str) -> DataFrame:
    """One row: n, score_mean and positive_rate (0.5 without predictions)."""
    warm = predictions.join(phases.where(F.col("phase") == WARMUP).select(window), window, "left_semi")
    return warm.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("predicted_score").alias("score_mean"),
        F.coalesce(F.avg("predicted_label"), F.lit(0.5)).alias("positive_rate"),
    )


def score_drift(
    predictions: DataFrame, phases: DataFrame, window: str, settings: ModelSettings = ModelSettings()
) -> DataFrame:
    """(window, ks_statistic, p_value, skipped, drifted, baseline_mean, current_mean)."""
    scores = predictions.select(window, F.lit("predicted_score").alias("feature"), F.col("predicted_score").alias("value"))
    counted = value_counts(scores, [window, "feature"]).join(phases.select(window, "phase"), window)
    reference = pooled(counted.where(F.col("phase") == WARMUP), ["feature"])
    return score_tests(reference, counted.where(F.col("phase") == MONITORING).drop("phase"), window, settings)


def score_tests(
    reference: DataFrame, current: DataFrame, window: str, settings: ModelSettings = ModelSettings()
) -> DataFrame:
    """``score_drift`` from counted scores: the warm-up's (feature, value, n) and those of the
    monitored windows (window, feature, value, n)."""
    tests = ks_windows(
        reference,
        current,
        window,
        DriftSettings(min_rows=settings.min_rows, ks_significance=settings.score_significance),
    )
    weighted = F.sum(F.col("value") * F.col("n")) / F.sum("n")
    means = current.groupBy(window).agg(weighted.alias("current_mean"))
    base = reference.agg(weighted.alias("baseline_mean")).select("baseline_mean").scalar()
    return tests.join(means, window).select(
        window,
        "n_current",
        "ks_statistic",
        "p_value",
        "skipped",
        "drifted",
        base.alias("baseline_mean"),
        "current_mean",
    )


def label_drift(
    rows: DataFrame, baseline_rate: Column, window: str, label: str = "predicted_label",
    settings: ModelSettings = ModelSettings(),
) -> DataFrame:
    """(window, n, baseline_positive_rate, current_positive_rate, z_score, skipped,
    drifted): z-test of the positive rate against a fixed rate."""
    reduced = rows.groupBy(window).agg(F.count(label).alias("n"), F.avg(label).alias("current_positive_rate"))
    error = F.sqrt(F.col("baseline_positive_rate") * (1 - F.col("baseline_positive_rate")) / F.col("n"))
    with_base = reduced.withColumn("baseline_positive_rate", baseline_rate).withColumn("_error", error)
    skipped = (F.col("n") < settings.min_rows) | (F.col("_error") == 0)
    z = F.try_divide(F.abs(F.col("current_positive_rate") - F.col("baseline_positive_rate")), F.col("_error"))
    return (
        with_base.withColumn("skipped", skipped)
        .withColumn("z_score", F.when(~F.col("skipped"), z))
        .withColumn("drifted", F.coalesce(F.col("z_score") > settings.label_z, F.lit(False)))
        .drop("_error")
    )


def window_ends(
    pairs: DataFrame, windows: DataFrame, window: str, sums: Mapping[str, Column] | None = None
) -> DataFrame:
    """(window, _end, sums): the pairs up to the end of every window, and sums over them.

    One row per window of ``windows`` or ``pairs``; only these rows are ordered."""
    sums = sums or {}
    own = pairs.where(F.col(window).isNotNull()).groupBy(window).agg(F.count(F.lit(1)).alias("_end"), *[F.sum(e).alias(n) for n, e in sums.items()])
    upto = Window.orderBy(window).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = [F.sum(F.coalesce(c, F.lit(0))).over(upto).alias(c) for c in ("_end", *sums)]
    return windows.select(window).join(own, window, "full_outer").select(window, *running)


def placed_tails(pairs: DataFrame, ends: DataFrame, window: str, order: Sequence[str], size: int) -> DataFrame:
    """The last ``size`` pairs of every window with ``_back`` (1 for the last) and ``_at``, their
    position among all pairs, from 0.

    No other pair can be among the last ``size`` at the end of a window. Spark keeps that many
    per task before the shuffle, and the positions follow from the ends of the windows."""
    tails = lowest_by(pairs, [window], [F.desc(c) for c in order], size, "_back")
    return tails.join(ends.select(window, "_end"), window).withColumn("_at", F.col("_end") - F.col("_back")).drop("_end")


def last_pairs(
    pairs: DataFrame, windows: DataFrame, window: str, order: Sequence[str], size: int
) -> DataFrame:
    """(report window, pair columns): for every window in ``windows``, the last
    ``size`` pairs up to its end, in the order of ``order`` (time, then id).

    A report window needs the positions in (end - size, end], which lie in two blocks
    of ``size`` positions, so pairs and report windows meet in an equi-join on the
    block. Accuracy and AUC do not need these rows, see ``rolling_accuracy``.
    """
    ends = window_ends(pairs, windows, window)
    placed = placed_tails(pairs, ends, window, order, size)
    placed = placed.drop(window, "_back").withColumn("_block", F.floor(F.col("_at") / size))
    last = F.floor((F.col("_end") - 1) / size)
    reports = ends.join(windows.select(window), window, "left_semi").where(F.col("_end") > 0).select(
        window, "_end", F.explode(F.array(last - 1, last)).alias("_block")
    )
    needed = placed.join(reports, "_block").where(
        (F.col("_at") < F.col("_end")) & (F.col("_at") >= F.col("_end") - size)
    )
    return needed.drop("_block", "_at", "_end")


def rolling_accuracy(ends: DataFrame, tails: DataFrame, window: str, size: int) -> DataFrame:
    """(window, window_size, accuracy) over the last ``size`` pairs at the end of every window that has pairs before it.

    ``ends`` has the running sums ``_hits`` and ``_rated`` of ``tails._hit`` and of its rows that
    are not null. The sums at ``end`` less those at ``end - size`` are the answer. The latter place
    lies inside some window: its sums are the ones at that window's end less those of the
    window's last pairs, which a running sum backwards over its tail gives. A pair is read once,
    however many reports it counts in.
    """
    start = F.greatest(F.col("_end") - size, F.lit(0))
    filled = ends.where(F.col("_end") > 0)
    found = F.struct(F.col(window).alias("of"), "_end", "_hits", "_rated")
    stacked = filled.select(F.col("_end").alias("_pos"), F.lit(0).alias("_ask"), window, found.alias("_found")).unionByName(
        filled.select(start.alias("_pos"), F.lit(1).alias("_ask"), window, F.struct("_end", "_hits", "_rated").alias("_here")),
        allowMissingColumns=True,
    )
    # From the last position back, the last end seen is the nearest one behind the asked place.
    back = Window.orderBy(F.desc("_pos"), F.desc("_ask"), F.desc(window)).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    asked = (
        stacked.withColumn("_found", F.last("_found", ignorenulls=True).over(back))
        .where(F.col("_ask") == 1)
        .withColumn("_back", F.col("_found._end") - F.col("_pos"))
    )
    upto = Window.partitionBy(window).orderBy("_back").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    behind = tails.select(
        F.col(window).alias("_of"),
        "_back",
        F.sum(F.coalesce("_hit", F.lit(0))).over(upto).alias("_hits_behind"),
        F.count("_hit").over(upto).alias("_rated_behind"),
    )
    at = asked.join(
        behind.withColumnRenamed("_back", "_back_of"),
        (F.col("_found.of") == F.col("_of")) & (F.col("_back") == F.col("_back_of")),
    )
    hits = F.col("_here._hits") - (F.col("_found._hits") - F.col("_hits_behind"))
    rated = F.col("_here._rated") - (F.col("_found._rated") - F.col("_rated_behind"))
    return at.select(
        window, (F.col("_here._end") - F.col("_pos")).alias("window_size"), rate(hits, rated).alias("accuracy")
    )


def rolling_auc(
    ends: DataFrame,
    tails: DataFrame,
    window: str,
    size: int,
    score: str = "predicted_score",
    label: str = "true_label",
    min_class_rows: int = 5,
) -> DataFrame:
    """(window, auc) over the last ``size`` pairs at the end of every window that has pairs before it.

    Ends are worked off by blocks of ``size`` positions. Their pairs lie in that block and the one
    before, so a pair goes to two tasks at most and a group has at most ``2 * size`` pairs, however many
    windows end there. See ``_slide``.
    """
    block = F.floor((F.col("_end") - 1) / size).alias("_group")
    reports = ends.where(F.col("_end") > 0).select(block, "_end").distinct()
    own = F.floor(F.col("_at") / size)
    rated = tails.where(F.col(score).isNotNull() & F.col(label).isin(0, 1)).select(
        F.explode(F.array(own, own + 1)).alias("_group"),
        "_at",
        F.col(score).cast("double").alias("score"),
        (F.col(label) == 1).cast("int").alias("class"),
    )
    found = (
        rated.groupBy("_group")
        .cogroup(reports.groupBy("_group"))
        .applyInPandas(_slide(size, min_class_rows), "_end long, auc double")
    )
    return ends.join(found, "_end").select(window, "auc")


def _slide(size: int, min_class_rows: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    def auc_at_ends(pairs: pd.DataFrame, ends: pd.DataFrame) -> pd.DataFrame:
        """Counts per score and class, to which pairs are added and taken from as they enter and leave the frame."""
        pairs, ends = pairs.sort_values("_at"), np.sort(ends["_end"].to_numpy())
        scores, place = np.unique(pairs["score"].to_numpy(), return_inverse=True)
        at, of = pairs["_at"].to_numpy(), pairs["class"].to_numpy()
        counts = np.zeros((2, len(scores)), np.int64)
        entered, left = np.searchsorted(at, ends), np.searchsorted(at, ends - size)
        reached = gone = 0
        found = np.full(len(ends), np.nan)
        for i in range(len(ends)):
            np.add.at(counts, (of[reached : entered[i]], place[reached : entered[i]]), 1)
            np.subtract.at(counts, (of[gone : left[i]], place[gone : left[i]]), 1)
            reached, gone = entered[i], left[i]
            negatives, positives = counts.sum(axis=1)
            if min(positives, negatives) >= max(min_class_rows, 1):
                won = (counts[1] * (np.cumsum(counts[0]) - counts[0] * 0.5)).sum()
                found[i] = won / (positives * negatives)
        return pd.DataFrame({"_end": ends, "auc": pd.array(found, "Float64")})

    return auc_at_ends


def auc(
    rows: DataFrame, group: str, score: str = "predicted_score", label: str = "true_label", min_class_rows: int = 5
) -> DataFrame:
    """(group, positives, negatives, auc): the share of (positive, negative) pairs in
    the right order, ties counting half, from ranks instead of pairs."""
    counted = (
        rows.where(F.col(score).isNotNull() & F.col(label).isin(0, 1))
        .groupBy(group, F.lit("score").alias("feature"), F.col(score).alias("value"))
        .agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"))
    )
    ranked = running_sums(counted, ["feature"], "value", {"neg": ["feature", group]}, [group])
    reduced = ranked.groupBy(group).agg(
        F.sum("pos").alias("positives"),
        F.sum("neg").alias("negatives"),
        F.sum(F.col("pos") * (F.col("neg_cum") - F.col("neg") * F.lit(0.5))).alias("_won"),
    )
    enough = (F.col("positives") >= min_class_rows) & (F.col("negatives") >= min_class_rows)
    return reduced.select(
        group,
        "positives",
        "negatives",
        F.when(enough, rate(F.col("_won"), F.col("positives") * F.col("negatives"))).alias("auc"),
    )


def performance(
    pairs: DataFrame,
    phases: DataFrame,
    window: str,
    order: Sequence[str],
    settings: ModelSettings = ModelSettings(),
) -> DataFrame:
    """(window, window_size, accuracy, estimated_auc, baseline_accuracy, is_degraded)
    over the last pairs at the end of every window.

    The ends, one row per window, and the tails of the windows are settled because
    accuracy and AUC both read them.
    """
    ends, tails = ends_and_tails(pairs, phases, window, order, settings)
    ends = settle(ends, "window-ends")
    tails = settle(tails(ends), "tails")
    report = recent_performance(ends, tails, phases, window, settings)
    at_end = F.max(F.when(F.col("position") == settings.warmup_windows, F.col("accuracy")))
    # One row per window, so the frame over all of them is small.
    report = report.withColumn("baseline_accuracy", at_end.over(Window.partitionBy()))
    return report.drop("position").withColumn(
        "is_degraded", is_degraded(F.col("baseline_accuracy"), F.col("accuracy"), settings.accuracy_drop)
    )


def ends_and_tails(
    pairs: DataFrame, windows: DataFrame, window: str, order: Sequence[str], settings: ModelSettings = ModelSettings()
) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """The ends of the windows with the sums that ``recent_performance`` needs, and the function
    that makes the tails from the ends, which a caller may write first."""
    rated = pairs.withColumn("_hit", (F.col("predicted_label") == F.col("true_label")).cast("long"))
    sums = {"_hits": F.col("_hit"), "_rated": F.col("_hit").isNotNull().cast("long")}
    needed = rated.select(window, *order, "predicted_score", "true_label", "_hit")
    return window_ends(rated, windows, window, sums), lambda ends: placed_tails(
        needed, ends, window, order, settings.window_rows
    ).drop(*order)


def recent_performance(
    ends: DataFrame, tails: DataFrame, phases: DataFrame, window: str, settings: ModelSettings = ModelSettings()
) -> DataFrame:
    """(window, position, phase, window_size, accuracy, estimated_auc) of the last pairs at the end of every window."""
    size = settings.window_rows
    found = (
        phases.select(window, "position", "phase")
        .join(rolling_accuracy(ends, tails, window, size), window, "left")
        .join(rolling_auc(ends, tails, window, size, min_class_rows=settings.min_class_rows), window, "left")
    )
    return found.select(
        window,
        "position",
        "phase",
        F.coalesce("window_size", F.lit(0)).alias("window_size"),
        "accuracy",
        F.col("auc").alias("estimated_auc"),
    )


def is_degraded(baseline: Column, current: Column, drop: float) -> Column:
    return F.coalesce(baseline - current > drop, F.lit(False))


def model_report(
    predictions: DataFrame,
    labels: DataFrame,
    window: str,
    order: Sequence[str],
    settings: ModelSettings = ModelSettings(),
) -> DataFrame:
    """One row per window with predictions: phase, score drift, label drift and
    performance; the checks are null in warm-up.

    The matched pairs are written once, so that counting them and taking the last
    of them does not repeat the join.
    """
    phases = settle(model_phases(predictions, window, settings), "model-phases")
    needed = dict.fromkeys(["event_id", window, *order, "predicted_score", "predicted_label"])
    pairs = settle(match_labels(predictions.select(*needed), labels), "pairs")
    base = warmup_baseline(predictions, phases, window)
    scores = score_drift(predictions, phases, window, settings)
    rates = label_drift(predictions, base.select("positive_rate").scalar(), window, settings=settings)
    health = performance(pairs, phases, window, order, settings).drop("phase")
    return joined_report(phases, scores, rates, health, window)


def joined_report(
    phases: DataFrame, scores: DataFrame, rates: DataFrame, health: DataFrame, window: str
) -> DataFrame:
    """The report of ``model_report`` from its parts, each with one row per window."""
    scores = scores.select(
        window, "ks_statistic", "p_value", F.col("drifted").alias("prediction_drift"), "baseline_mean", "current_mean"
    )
    rates = rates.select(window, "current_positive_rate", "z_score", F.col("drifted").alias("label_drift"))
    phases = phases.select(window, "n_predictions", "phase")
    joined = phases.join(scores, window, "left").join(rates, window, "left").join(health, window)
    checks = [c for c in joined.columns if c not in {window, "n_predictions", "phase"}]
    monitored = F.col("phase") == MONITORING
    return joined.select(
        window, "n_predictions", "phase", *[F.when(monitored, F.col(c)).alias(c) for c in checks]
    )


def per_version(pairs: DataFrame, window: str) -> DataFrame:
    """(window, model_version, n, accuracy, mean_score, positive_rate)."""
    hit = (F.col("predicted_label") == F.col("true_label")).cast("double")
    return pairs.groupBy(window, "model_version").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(hit).alias("accuracy"),
        F.avg("predicted_score").alias("mean_score"),
        F.avg("predicted_label").alias("positive_rate"),
    )
