"""Model monitoring: label joins, score and label drift, accuracy and AUC."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.base import LAB, PRED, q6, query, r6
from checks.drifting import MMD_SQL
from plumbline.operators import model
from plumbline.plans.report import WindowReport
from plumbline.plans.views import feature_events, labels, predictions
from plumbline.settings import ModelSettings

ORDER = ("ts", "event_id")
PAIRS = "pairs AS (SELECT pred.*, lab.true_label, lab.label_ts FROM pred JOIN lab USING (event_id))"
MPH = """
mp AS (SELECT w, n, position, CASE WHEN position <= 3 THEN 'warmup' ELSE 'monitoring' END AS phase
       FROM (SELECT w, count(*) AS n, row_number() OVER (ORDER BY w) AS position FROM pred GROUP BY w))"""


@query("j1_match_labels", f"WITH {PRED}, {LAB}, {PAIRS} SELECT event_id, w, predicted_label, true_label FROM pairs")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return model.match_labels(predictions(spark, sf), labels(spark, sf)).select(
        "event_id", "w", "predicted_label", "true_label"
    )


LATEST_LABELS_SQL = f"""WITH {PRED}, {LAB}, twice AS (SELECT * FROM lab UNION ALL SELECT event_id, label_ts + INTERVAL '1' HOUR, 1 - true_label FROM lab WHERE event_id % 3 = 0),
    latest AS (SELECT event_id, arg_max(true_label, label_ts) AS true_label, max(label_ts) AS label_ts FROM twice GROUP BY event_id)"""


def corrected_labels(spark: SparkSession, sf: str) -> DataFrame:
    """A third of the events get a second, later label, which wins."""
    first = labels(spark, sf)
    second = first.where("event_id % 3 = 0").select(
        "event_id",
        (F.col("label_ts") + F.expr("INTERVAL '1' HOUR")).alias("label_ts"),
        (1 - F.col("true_label")).alias("true_label"),
    )
    return first.unionByName(second)


@query("j1_latest_label", f"{LATEST_LABELS_SQL} SELECT event_id, true_label, label_ts FROM latest")
def _(spark, sf):
    return model.latest_labels(corrected_labels(spark, sf))


KS_ONLY = """
ref AS (SELECT predicted_score AS value FROM pred WHERE w IN (SELECT w FROM mp WHERE phase = 'warmup')),
cur AS (SELECT w, predicted_score AS value FROM pred WHERE w IN (SELECT w FROM mp WHERE phase = 'monitoring')),
nc AS (SELECT w, count(*) AS nc, avg(value) AS current_mean FROM cur GROUP BY w),
nr AS (SELECT count(*) AS nr, avg(value) AS baseline_mean FROM ref),
pts AS (SELECT w, value, 0 AS r, 1 AS c FROM cur UNION ALL SELECT nc.w, ref.value, 1, 0 FROM ref CROSS JOIN nc),
cdf AS (SELECT w, sum(sum(r)) OVER (PARTITION BY w ORDER BY value) AS cr, sum(sum(c)) OVER (PARTITION BY w ORDER BY value) AS cc FROM pts GROUP BY w, value),
ksd AS (SELECT w, CAST(nr AS DOUBLE) AS nr, CAST(nc AS DOUBLE) AS nc, baseline_mean, current_mean, max(abs(cr * 1.0e0 / nr - cc * 1.0e0 / nc)) AS d
        FROM cdf JOIN nc USING (w) CROSS JOIN nr GROUP BY ALL),
ksl AS (SELECT *, (sqrt(nr * nc / (nr + nc)) + 0.12e0 + 0.11e0 / sqrt(nr * nc / (nr + nc))) * d AS lam FROM ksd),
ks AS (SELECT w, d AS ks_statistic, baseline_mean, current_mean, nc,
              CASE WHEN lam < 0.2e0 THEN 1.0e0 ELSE least(1.0e0, greatest(0.0e0,
                (SELECT sum(CASE WHEN k % 2 = 1 THEN 2 ELSE -2 END * exp(-2.0e0 * k * k * lam * lam)) FROM range(1, 101) t(k)))) END AS p_value
       FROM ksl)"""
KS_SCORES = f"{PRED}, {MPH}, {KS_ONLY}"


@query(
    "m1_score_drift",
    f"WITH {KS_SCORES} SELECT w, {q6('ks_statistic')} AS ks_statistic, {q6('p_value')} AS p_value, p_value < 0.05 AS drifted, "
    f"{q6('baseline_mean')} AS baseline_mean, {q6('current_mean')} AS current_mean FROM ks WHERE nc >= 10",
)
def _(spark, sf):
    scored = predictions(spark, sf)
    found = model.score_drift(scored, model.model_phases(scored, "w"), "w").where(~F.col("skipped"))
    return found.select(
        "w", r6("ks_statistic"), r6("p_value"), "drifted", r6("baseline_mean"), r6("current_mean")
    )


Z_ONLY = """base AS (SELECT avg(predicted_label) AS p0 FROM pred WHERE w IN (SELECT w FROM mp WHERE phase = 'warmup')),
zt AS (SELECT w, count(*) AS n, p0, avg(predicted_label) AS p, abs(avg(predicted_label) - p0) / sqrt(p0 * (1 - p0) / count(*)) AS z
       FROM pred CROSS JOIN base GROUP BY w, p0)"""
LABEL_Z = f"{PRED}, {MPH}, {Z_ONLY}"


@query(
    "m2_label_drift",
    f"WITH {LABEL_Z} SELECT w, n, {q6('p')} AS current_positive_rate, {q6('z')} AS z_score, z > 2.5 AS drifted FROM zt WHERE n >= 10",
)
def _(spark, sf):
    scored = predictions(spark, sf)
    base = model.warmup_baseline(scored, model.model_phases(scored, "w"), "w")
    found = model.label_drift(scored, base.select("positive_rate").scalar(), "w").where(~F.col("skipped"))
    return found.select("w", "n", r6("current_positive_rate"), r6("z_score"), "drifted")


ROLL_ONLY = """
seq AS (SELECT *, row_number() OVER (ORDER BY ts, event_id) AS pos FROM pairs),
ends AS (SELECT mp.w, mp.phase, mp.position, (SELECT max(pos) FROM seq WHERE seq.w <= mp.w) AS last_pos FROM mp),
roll AS (SELECT ends.w, phase, position, seq.event_id, predicted_label, true_label, predicted_score AS s
         FROM ends JOIN seq ON seq.pos <= last_pos AND seq.pos > last_pos - 1000),
acc AS (SELECT w, phase, position, count(*) AS window_size, avg(CASE WHEN predicted_label = true_label THEN 1.0e0 ELSE 0.0e0 END) AS accuracy
        FROM roll GROUP BY w, phase, position),
ba AS (SELECT accuracy AS baseline_accuracy FROM acc WHERE position = 3),
rk AS (SELECT w, true_label, rank() OVER (PARTITION BY w ORDER BY s) + (count(*) OVER (PARTITION BY w, s) - 1) / 2.0e0 AS r FROM roll),
au AS (SELECT w, CASE WHEN p >= 5 AND q >= 5 THEN (rs - p * (p + 1) / 2.0e0) / (p * q * 1.0e0) END AS auc
       FROM (SELECT w, count(*) FILTER (WHERE true_label = 1) AS p, count(*) FILTER (WHERE true_label = 0) AS q,
                    sum(r) FILTER (WHERE true_label = 1) AS rs FROM rk GROUP BY w))"""
ROLL = f"{PRED}, {LAB}, {PAIRS}, {MPH}, {ROLL_ONLY}"


def _performance(spark: SparkSession, sf: str) -> DataFrame:
    scored = predictions(spark, sf)
    pairs = model.match_labels(scored, labels(spark, sf))
    return model.performance(pairs, model.model_phases(scored, "w"), "w", ORDER)


@query("m3_last_pairs", f"WITH {ROLL} SELECT w, event_id FROM roll")
def _(spark, sf):
    scored = predictions(spark, sf)
    pairs = model.match_labels(scored, labels(spark, sf))
    recent = model.last_pairs(pairs, model.model_phases(scored, "w"), "w", ORDER, ModelSettings().window_rows)
    return recent.select("w", "event_id")


@query("m4_accuracy", f"WITH {ROLL} SELECT w, window_size, {q6('accuracy')} AS accuracy FROM acc")
def _(spark, sf):
    return _performance(spark, sf).select("w", "window_size", r6("accuracy"))


@query("m5_baseline_accuracy", f"WITH {ROLL} SELECT w, {q6('baseline_accuracy')} AS baseline_accuracy FROM acc CROSS JOIN ba")
def _(spark, sf):
    return _performance(spark, sf).select("w", r6("baseline_accuracy"))


@query("m6_degradation", f"WITH {ROLL} SELECT w, baseline_accuracy - accuracy > 0.05 AS is_degraded FROM acc CROSS JOIN ba")
def _(spark, sf):
    return _performance(spark, sf).select("w", "is_degraded")


@query("m7_rolling_auc", f"WITH {ROLL} SELECT w, {q6('auc')} AS estimated_auc FROM au")
def _(spark, sf):
    return _performance(spark, sf).select("w", r6("estimated_auc"))


AUC_RANKS = """
rk AS (SELECT {w} AS w, true_label, rank() OVER (PARTITION BY {w} ORDER BY predicted_score) + (count(*) OVER (PARTITION BY {w}, predicted_score) - 1) / 2.0e0 AS r FROM pairs),
au AS (SELECT w, p AS positives, q AS negatives, CASE WHEN p >= 5 AND q >= 5 THEN (rs - p * (p + 1) / 2.0e0) / (p * q * 1.0e0) END AS auc
       FROM (SELECT w, count(*) FILTER (WHERE true_label = 1) AS p, count(*) FILTER (WHERE true_label = 0) AS q,
                    sum(r) FILTER (WHERE true_label = 1) AS rs FROM rk GROUP BY w))"""


@query(
    "m7_auc",
    f"WITH {PRED}, {LAB}, {PAIRS}, {AUC_RANKS.format(w='w')} SELECT w, positives, negatives, {q6('auc')} AS auc FROM au",
)
def _(spark, sf):
    """AUC over all pairs of a window, of any number."""
    return model.auc(model.match_labels(predictions(spark, sf), labels(spark, sf)), "w").select(
        "w", "positives", "negatives", r6("auc")
    )


@query(
    "j10_ranked_pairs",
    f"WITH {PRED}, {LAB}, {PAIRS}, {AUC_RANKS.format(w='model_version')} SELECT w AS model_version, positives, negatives, {q6('auc')} AS auc FROM au",
)
def _(spark, sf):
    """All positive and negative pairs of the table as one group, by ranks."""
    return model.auc(model.match_labels(predictions(spark, sf), labels(spark, sf)), "model_version").select(
        "model_version", "positives", "negatives", r6("auc")
    )


@query(
    "m8_model_warmup",
    f"""WITH {PRED}, {MPH} SELECT count(*) AS n, {q6('avg(predicted_score)')} AS score_mean, {q6('avg(predicted_label)')} AS positive_rate
    FROM pred WHERE w IN (SELECT w FROM mp WHERE phase = 'warmup')""",
)
def _(spark, sf):
    scored = predictions(spark, sf)
    return model.warmup_baseline(scored, model.model_phases(scored, "w"), "w").select(
        "n", r6("score_mean"), r6("positive_rate")
    )


MODEL_REPORT_SQL = f"""WITH {PRED}, {LAB}, {PAIRS}, {MPH}, {KS_ONLY}, {Z_ONLY}, {ROLL_ONLY},
    rep AS (SELECT mp.w, mp.n AS n_predictions, mp.phase, mp.phase = 'monitoring' AS m, ks_statistic, ks.p_value, zt.p, zt.z, window_size, accuracy, auc, baseline_accuracy, ks.nc
            FROM mp LEFT JOIN ks USING (w) LEFT JOIN zt USING (w) LEFT JOIN acc USING (w) LEFT JOIN au USING (w) CROSS JOIN ba)
    SELECT w, n_predictions, phase, CASE WHEN m AND nc >= 10 THEN {q6('ks_statistic')} END AS ks_statistic, CASE WHEN m AND nc >= 10 THEN {q6('p_value')} END AS p_value,
      CASE WHEN m THEN coalesce(nc >= 10 AND p_value < 0.05, false) END AS prediction_drift,
      CASE WHEN m THEN {q6('p')} END AS current_positive_rate, CASE WHEN m AND n_predictions >= 10 THEN {q6('z')} END AS z_score,
      CASE WHEN m THEN coalesce(n_predictions >= 10 AND z > 2.5, false) END AS label_drift,
      CASE WHEN m THEN window_size END AS window_size, CASE WHEN m THEN {q6('accuracy')} END AS accuracy,
      CASE WHEN m THEN {q6('auc')} END AS estimated_auc, CASE WHEN m THEN {q6('baseline_accuracy')} END AS baseline_accuracy,
      CASE WHEN m THEN baseline_accuracy - accuracy > 0.05 END AS is_degraded
    FROM rep"""


def report_columns(found: DataFrame) -> DataFrame:
    return found.select(
        "w", "n_predictions", "phase", r6("ks_statistic"), r6("p_value"), "prediction_drift",
        r6("current_positive_rate"), r6("z_score"), "label_drift", "window_size", r6("accuracy"),
        r6("estimated_auc"), r6("baseline_accuracy"), "is_degraded",
    )


@query("m9_model_report", MODEL_REPORT_SQL)
def _(spark, sf):
    return report_columns(model.model_report(predictions(spark, sf), labels(spark, sf), "w", ORDER))


@query(
    "m10_feature_drift",
    f"WITH {MMD_SQL} SELECT w, {q6('mmd_score')} AS mmd_score, mmd_drift FROM sc WHERE phase = 'monitoring'",
)
def _(spark, sf):
    """The drift of the model's input features, next to its scores."""
    scores = WindowReport(feature_events(spark, sf), "w", ["event_id"]).scores
    return scores.where("phase = 'monitoring'").select("w", r6("mmd_score"), "mmd_drift")


@query(
    "m11_per_version",
    f"""WITH {PRED}, {LAB}, {PAIRS} SELECT w, model_version, count(*) AS n,
      {q6('avg(CASE WHEN predicted_label = true_label THEN 1.0e0 ELSE 0.0e0 END)')} AS accuracy, {q6('avg(predicted_score)')} AS mean_score,
      {q6('avg(predicted_label)')} AS positive_rate FROM pairs GROUP BY w, model_version""",
)
def _(spark, sf):
    pairs = model.match_labels(predictions(spark, sf), labels(spark, sf))
    return model.per_version(pairs, "w").select(
        "w", "model_version", "n", r6("accuracy"), r6("mean_score"), r6("positive_rate")
    )
