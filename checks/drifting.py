"""Random-feature MMD, phases and the per-feature drift checks."""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.base import COLUMNS, FE, LNG, NUMERIC, PHASES, q6, query, r6, report
from plumbline.functions.frames import complete_rows, long_numeric
from plumbline.functions.scalars import psi_level
from plumbline.operators import drift, mmd, stats
from plumbline.operators.phases import WARMUP
from plumbline.plans.views import feature_events
from plumbline.settings import MmdSettings, PhaseSettings

MMD = MmdSettings()
D = MMD.components


def draws_sql(features: int) -> str:
    """The fixed random draws as rows (d, u0.., b)."""
    directions, shifts = mmd.unit_draws(D, features, MMD.seed)
    rows = ", ".join(
        f"({d}, {', '.join(f'{u:.17e}' for u in directions[d].tolist())}, {float(shifts[d]):.17e})" for d in range(D)
    )
    names = ", ".join(f"u{i}" for i in range(features))
    return f"draws(d, {names}, b) AS (VALUES {rows})"


COMPLETE = """
complete AS (SELECT event_id, w, CAST(age AS DOUBLE) AS age, purchase_amount, CAST(session_duration AS DOUBLE) AS session_duration,
                    CAST(page_views AS DOUBLE) AS page_views
             FROM fe WHERE age IS NOT NULL AND purchase_amount IS NOT NULL AND session_duration IS NOT NULL
                       AND page_views IS NOT NULL)"""
SIGMA = """
wrm AS (SELECT *, md5(CAST(event_id AS VARCHAR)) AS h FROM complete WHERE w IN (SELECT w FROM ph WHERE phase = 'warmup')),
bkt AS (SELECT *, CAST('0x' || substr(h, 1, 8) AS BIGINT) % greatest(1, (SELECT count(*) FROM wrm) // 100000) AS bucket FROM wrm),
smp AS (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY h, event_id) AS i FROM bkt),
pairs AS (SELECT (a.age - b.age) * (a.age - b.age) + (a.purchase_amount - b.purchase_amount) * (a.purchase_amount - b.purchase_amount)
               + (a.session_duration - b.session_duration) * (a.session_duration - b.session_duration)
               + (a.page_views - b.page_views) * (a.page_views - b.page_views) AS sq
          FROM smp a JOIN smp b ON a.bucket = b.bucket AND a.i % 2 = 1 AND b.i = a.i + 1),
sg AS (SELECT coalesce(sqrt(quantile_cont(sq, 0.5) / 2), 1.0e0) AS sigma FROM pairs WHERE sq > 0)"""
SCALE = repr(math.sqrt(2.0 / D)) + "e0"
ZS = f"""
zs AS (SELECT w, d, count(*) AS n,
              sum(cos((age * u0 + purchase_amount * u1 + session_duration * u2 + page_views * u3) / sigma + b) * {SCALE}) AS z
       FROM complete CROSS JOIN draws CROSS JOIN sg GROUP BY w, d),
base AS (SELECT d, sum(z) / sum(n) AS m FROM zs WHERE w IN (SELECT w FROM ph WHERE phase = 'warmup') GROUP BY d),
raw AS (SELECT w, sum((z / n - m) * (z / n - m)) AS score FROM zs JOIN base USING (d) GROUP BY w),
sc0 AS (SELECT ph.*, CASE WHEN phase <> 'warmup' THEN score END AS mmd_score FROM ph LEFT JOIN raw USING (w)),
thr AS (SELECT quantile_cont(mmd_score, 0.99) AS threshold, count(mmd_score) AS scores FROM sc0 WHERE phase = 'calibrate'),
sc AS (SELECT w, n AS rows, complete_rows, phase, mmd_score,
              CASE WHEN after >= 10 THEN threshold END AS mmd_threshold,
              coalesce(phase = 'monitoring' AND mmd_score > threshold, false) AS mmd_drift
       FROM sc0 CROSS JOIN thr)"""


def ctes(*parts: str) -> str:
    """Join CTE texts, each once."""
    return ", ".join(dict.fromkeys(parts))


MMD_PARTS = (FE, PHASES, COMPLETE, SIGMA, draws_sql(4), ZS)
MMD_SQL = ctes(*MMD_PARTS)


@query("d1_median_bandwidth", f"WITH {FE}, {PHASES}, {COMPLETE}, {SIGMA} SELECT {q6('sigma')} AS sigma FROM sg")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return report(spark, sf).sigma.select(r6("sigma"))


@query(
    "d2_random_draws",
    f"""WITH {FE}, {COMPLETE}, {draws_sql(4)}, days AS (SELECT w, avg(age) AS m0, avg(purchase_amount) AS m1,
      avg(session_duration) AS m2, avg(page_views) AS m3 FROM complete GROUP BY w)
    SELECT w, d, {q6('m0 * u0 + m1 * u1 + m2 * u2 + m3 * u3 + b')} AS angle FROM days CROSS JOIN draws""",
)
def _(spark, sf):
    """The draws applied to the mean complete row of every day: one angle per component."""
    events = complete_rows(feature_events(spark, sf), NUMERIC)
    days = events.groupBy("w").agg(F.array(*[F.avg(c) for c in NUMERIC]).alias("mean"))
    draws = mmd.parameter_table(events, NUMERIC, MMD)
    # The draws have a fixed number of rows, so each day carries them as one array.
    packed = draws.agg(F.collect_list(F.struct("d", "omega", "bias")).alias("draws")).select("draws").scalar()
    angle = F.aggregate(F.zip_with("mean", "draw.omega", lambda m, o: m * o), F.lit(0.0), lambda s, x: s + x)
    return days.withColumn("draw", F.explode(packed)).select(
        "w", "draw.d", r6(angle + F.col("draw.bias"), "angle")
    )


@query(
    "d3_random_feature_map",
    f"""WITH {FE}, {PHASES}, {COMPLETE}, {SIGMA}, {draws_sql(4)}
    SELECT w, d, {q6(f'sum(cos((age * u0 + purchase_amount * u1 + session_duration * u2 + page_views * u3) / sigma + b) * {SCALE})')} AS z_sum,
           count(*) AS n FROM complete CROSS JOIN draws CROSS JOIN sg GROUP BY w, d""",
)
def _(spark, sf):
    """The map itself is only ever needed summed up by window."""
    sums = report(spark, sf).component_sums
    return sums.select("w", F.col("rows").alias("n"), F.posexplode("sums").alias("d", "z")).select(
        "w", "d", "n", r6("z", "z_sum")
    )


@query("d4_baseline_embedding", f"WITH {MMD_SQL} SELECT d, {q6('m')} AS mean FROM base")
def _(spark, sf):
    r = report(spark, sf)
    warm = r.component_sums.join(r.phases.where(F.col("phase") == WARMUP).select("w"), "w", "left_semi")
    return mmd.mean_embedding(warm).select(F.posexplode("mean").alias("d", "mean")).select("d", r6("mean"))


@query("d5_mmd_score", f"WITH {MMD_SQL} SELECT w, phase, {q6('mmd_score')} AS mmd_score FROM sc")
def _(spark, sf):
    return report(spark, sf).scores.select("w", "phase", r6("mmd_score"))


@query("d6_threshold", f"WITH {MMD_SQL} SELECT {q6('threshold')} AS threshold, scores AS calibration_scores_count FROM thr")
def _(spark, sf):
    scores = report(spark, sf).scores
    return mmd.calibrated_threshold(scores, PhaseSettings()).select(r6("threshold"), "calibration_scores_count")


@query("d7_drift_decision", f"WITH {MMD_SQL} SELECT w, mmd_drift FROM sc")
def _(spark, sf):
    return report(spark, sf).scores.select("w", "mmd_drift")


@query(
    "d9_visible_threshold",
    f"WITH {MMD_SQL} SELECT w, {q6('mmd_threshold')} AS mmd_threshold, phase = 'monitoring' AS is_monitoring FROM sc",
)
def _(spark, sf):
    return report(spark, sf).scores.select(
        "w", r6("mmd_threshold"), (F.col("phase") == "monitoring").alias("is_monitoring")
    )


@query(
    "d10_detector_summary",
    f"WITH {MMD_SQL} SELECT {q6('sigma')} AS sigma, {D} AS n_components, {q6('threshold')} AS threshold, "
    "scores AS calibration_scores_count FROM thr CROSS JOIN sg",
)
def _(spark, sf):
    r = report(spark, sf)
    return mmd.detector_summary(r.scores, r.sigma, MMD, PhaseSettings()).select(
        r6("sigma"), "n_components", r6("threshold"), "calibration_scores_count"
    )


@query(
    "d24_separation_ratio",
    f"WITH {MMD_SQL} SELECT w, {q6('mmd_score / mmd_threshold')} AS ratio FROM sc",
)
def _(spark, sf):
    return report(spark, sf).scores.select("w", r6("ratio"))


# per-feature MMD ---------------------------------------------------------------------
FEATURE_MMD = f"""
fwrm AS (SELECT *, md5(CAST(event_id AS VARCHAR)) AS h FROM lng WHERE w IN (SELECT w FROM ph WHERE phase = 'warmup')),
fbkt AS (SELECT *, CAST('0x' || substr(h, 1, 8) AS BIGINT) % greatest(1, (SELECT count(*) FROM fwrm) // 100000) AS bucket FROM fwrm),
fsmp AS (SELECT *, row_number() OVER (PARTITION BY feature, bucket ORDER BY h, event_id) AS i FROM fbkt),
fsg AS (SELECT a.feature, sqrt(quantile_cont((a.value - b.value) * (a.value - b.value), 0.5) / 2) AS sigma
        FROM fsmp a JOIN fsmp b ON a.feature = b.feature AND a.bucket = b.bucket AND a.i % 2 = 1 AND b.i = a.i + 1
        WHERE (a.value - b.value) * (a.value - b.value) > 0 GROUP BY a.feature),
fz AS (SELECT w, feature, d, count(*) AS n, sum(cos(value * u0 / sigma + b) * {SCALE}) AS z
       FROM lng JOIN fsg USING (feature) CROSS JOIN draws GROUP BY w, feature, d),
fb AS (SELECT feature, d, sum(z) / sum(n) AS m FROM fz WHERE w IN (SELECT w FROM ph WHERE phase = 'warmup') GROUP BY 1, 2),
fs AS (SELECT w, feature, sum((z / n - m) * (z / n - m)) AS score FROM fz JOIN fb USING (feature, d)
       WHERE w IN (SELECT w FROM ph WHERE phase <> 'warmup') GROUP BY 1, 2)"""
FEATURE_SQL = f"{FE}, {PHASES}, {LNG}, {draws_sql(1)}, {FEATURE_MMD}"


def _feature_scores(spark: SparkSession, sf: str) -> DataFrame:
    r = report(spark, sf)
    return mmd.feature_scores(r.df, r.phases, "w", NUMERIC, ["event_id"], MMD)


@query("d22_feature_scores", f"WITH {FEATURE_SQL} SELECT w, feature, {q6('score')} AS score FROM fs")
def _(spark, sf):
    return _feature_scores(spark, sf).select("w", "feature", r6("score"))


@query(
    "d23_top_feature",
    f"WITH {FEATURE_SQL} SELECT w, max_by(feature, score) AS feature, {q6('max(score)')} AS score FROM fs GROUP BY w",
)
def _(spark, sf):
    return mmd.top_feature(_feature_scores(spark, sf), "w").select("w", "feature", r6("score"))


# reference and per-feature tests --------------------------------------------------------
REF = "ref AS (SELECT feature, value FROM lng WHERE w IN (SELECT w FROM ph WHERE phase = 'warmup'))"
CUR = "cur AS (SELECT w, feature, value FROM lng WHERE w IN (SELECT w FROM ph WHERE phase = 'monitoring'))"
KS_ONLY = """
nr AS (SELECT feature, count(*) AS nr FROM ref GROUP BY feature),
nc AS (SELECT w, feature, count(*) AS nc FROM cur GROUP BY w, feature),
pts AS (SELECT w, feature, value, 0 AS r, 1 AS c FROM cur
        UNION ALL SELECT nc.w, ref.feature, ref.value, 1, 0 FROM ref JOIN nc ON ref.feature = nc.feature),
cdf AS (SELECT w, feature, sum(sum(r)) OVER (PARTITION BY w, feature ORDER BY value) AS cr,
               sum(sum(c)) OVER (PARTITION BY w, feature ORDER BY value) AS cc
        FROM pts GROUP BY w, feature, value),
ksd AS (SELECT w, feature, nr, nc, max(abs(cr * 1.0e0 / nr - cc * 1.0e0 / nc)) AS d
        FROM cdf JOIN nr USING (feature) JOIN nc USING (w, feature) GROUP BY w, feature, nr, nc),
ksl AS (SELECT *, (sqrt(nr * nc / (nr + nc)) + 0.12e0 + 0.11e0 / sqrt(nr * nc / (nr + nc))) * d AS lam
        FROM (SELECT w, feature, CAST(nr AS DOUBLE) AS nr, CAST(nc AS DOUBLE) AS nc, d FROM ksd)),
ks AS (SELECT w, feature, CAST(nr AS BIGINT) AS n_reference, CAST(nc AS BIGINT) AS n_current, nc < 10 AS skipped,
              CASE WHEN nc >= 10 THEN d END AS ks_statistic,
              CASE WHEN nc < 10 THEN NULL WHEN lam < 0.2e0 THEN 1.0e0
                   ELSE least(1.0e0, greatest(0.0e0, (SELECT sum(CASE WHEN k % 2 = 1 THEN 2 ELSE -2 END * exp(-2.0e0 * k * k * lam * lam))
                                                      FROM range(1, 101) t(k)))) END AS p_value
       FROM ksl)"""
KS_PARTS = (FE, PHASES, LNG, REF, CUR, KS_ONLY)
KS_SQL = ctes(*KS_PARTS)


@query(
    "d12_ks_statistic",
    f"WITH {KS_SQL} SELECT w, feature, n_reference, n_current, skipped, {q6('ks_statistic')} AS ks_statistic FROM ks",
)
def _(spark, sf):
    return report(spark, sf).ks().select(
        "w", "feature", "n_reference", "n_current", "skipped", r6("ks_statistic")
    )


@query(
    "d13_ks_p_value",
    f"WITH {KS_SQL} SELECT w, feature, {q6('p_value')} AS p_value, coalesce(p_value < 0.05, false) AS drifted FROM ks",
)
def _(spark, sf):
    return report(spark, sf).ks().select("w", "feature", r6("p_value"), "drifted")


SHARES = "[0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]"
PSI_ONLY = f"""
edges AS (SELECT feature, quantile_cont(value, {SHARES}) AS e FROM ref GROUP BY feature),
rb AS (SELECT feature, len(list_filter(e, lambda x: value >= x)) AS bin, count(*) AS n FROM ref JOIN edges USING (feature) GROUP BY 1, 2),
cb AS (SELECT w, feature, len(list_filter(e, lambda x: value >= x)) AS bin, count(*) AS n FROM cur JOIN edges USING (feature) GROUP BY 1, 2, 3),
pnr AS (SELECT feature, CAST(sum(n) AS BIGINT) AS nr FROM rb GROUP BY feature),
pnc AS (SELECT w, feature, CAST(sum(n) AS BIGINT) AS nc FROM cb GROUP BY w, feature),
grid AS (SELECT w, feature, nc, nr, g.bin FROM pnc JOIN pnr USING (feature) CROSS JOIN range(10) g(bin)),
sh AS (SELECT grid.w, grid.feature, grid.nc, coalesce(cb.n, 0) * 1.0e0 / grid.nc AS c, coalesce(rb.n, 0) * 1.0e0 / grid.nr AS r
       FROM grid LEFT JOIN cb ON cb.w = grid.w AND cb.feature = grid.feature AND cb.bin = grid.bin
       LEFT JOIN rb ON rb.feature = grid.feature AND rb.bin = grid.bin),
psi AS (SELECT w, feature, nc AS n_current, nc < 10 AS skipped,
               CASE WHEN nc >= 10 THEN sum((c - r) * ln((c + 0.0001e0) / (r + 0.0001e0))) END AS psi
        FROM sh GROUP BY w, feature, nc)"""
PSI_PARTS = (FE, PHASES, LNG, REF, CUR, PSI_ONLY)
PSI_SQL = ctes(*PSI_PARTS)


@query(
    "d14_psi",
    f"WITH {PSI_SQL} SELECT w, feature, n_current, skipped, {q6('psi')} AS psi FROM psi",
)
def _(spark, sf):
    return report(spark, sf).psi().select("w", "feature", "n_current", "skipped", r6("psi"))


@query(
    "d15_psi_level",
    f"""WITH {PSI_SQL} SELECT w, feature, CASE WHEN psi > 0.2 THEN 'alert' WHEN psi > 0.1 THEN 'warning' ELSE 'ok' END AS level,
      psi > 0.1 AS drifted FROM psi""",
)
def _(spark, sf):
    return report(spark, sf).psi().select("w", "feature", psi_level(F.col("psi"), 0.1, 0.2).alias("level"), "drifted")


CHI2_ONLY = """
rc AS (SELECT device_type AS category, count(*) AS n FROM fe
       WHERE device_type IS NOT NULL AND w IN (SELECT w FROM ph WHERE phase = 'warmup') GROUP BY 1),
rf AS (SELECT category, n * 1.0e0 / sum(n) OVER () AS f FROM rc),
cc AS (SELECT w, device_type AS category, count(*) AS n FROM fe
       WHERE device_type IS NOT NULL AND w IN (SELECT w FROM ph WHERE phase = 'monitoring') GROUP BY 1, 2),
tot AS (SELECT w, CAST(sum(n) AS BIGINT) AS total FROM cc GROUP BY w),
allc AS (SELECT w, category FROM tot CROSS JOIN rf UNION SELECT w, category FROM cc),
oe AS (SELECT allc.w, allc.category, coalesce(cc.n, 0) AS obs, coalesce(rf.f, 0.0001e0) * total AS exp, total
       FROM allc JOIN tot ON tot.w = allc.w LEFT JOIN rf ON rf.category = allc.category
       LEFT JOIN cc ON cc.w = allc.w AND cc.category = allc.category),
st AS (SELECT w, total, count(*) - 1 AS degrees, sum((obs - exp) * (obs - exp) / exp) AS stat FROM oe GROUP BY w, total),
chi AS (SELECT w, 'device_type' AS feature, total AS n_current, degrees, stat AS chi2_statistic,
  CASE WHEN stat > 1000 THEN 0.0e0
       ELSE least(1.0e0, greatest(0.0e0, 1.0e0 - exp(degrees / 2.0e0 * ln(stat / 2) - stat / 2 - lgamma(degrees / 2.0e0 + 1)) *
         (SELECT sum(exp(k * ln(stat / 2) + lgamma(degrees / 2.0e0 + 1) - lgamma(degrees / 2.0e0 + k + 1))) FROM range(0, 2000) t(k)))) END AS p_value
  FROM st)"""
CHI2_PARTS = (FE, PHASES, CHI2_ONLY)
CHI2_SQL = ctes(*CHI2_PARTS)


@query(
    "d16_chi2_statistic",
    f"WITH {CHI2_SQL} SELECT w, feature, n_current, degrees, {q6('chi2_statistic')} AS chi2_statistic FROM chi",
)
def _(spark, sf):
    return report(spark, sf).chi2().select("w", "feature", "n_current", "degrees", r6("chi2_statistic"))


@query(
    "d17_chi2_p_value",
    f"WITH {CHI2_SQL} SELECT w, feature, {q6('p_value')} AS p_value, p_value < 0.05 AS drifted FROM chi",
)
def _(spark, sf):
    return report(spark, sf).chi2().select("w", "feature", r6("p_value"), "drifted")


def _null_share(column: str) -> str:
    return f"""avg(CASE WHEN "{column}" IS NULL THEN 1.0e0 ELSE 0.0e0 END)"""


NULL_ONLY = "nb AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, {_null_share(c)} AS base FROM fe WHERE w IN (SELECT w FROM ph WHERE phase = 'warmup')"
    for c in COLUMNS
) + "), ncur AS (" + " UNION ALL ".join(
    f"SELECT w, '{c}' AS feature, {_null_share(c)} AS now FROM fe WHERE w IN (SELECT w FROM ph WHERE phase = 'monitoring') GROUP BY w"
    for c in COLUMNS
) + "), nd AS (SELECT w, feature, base, now, abs(now - base) AS delta FROM ncur JOIN nb USING (feature))"
NULL_PARTS = (FE, PHASES, NULL_ONLY)
NULL_SQL = ctes(*NULL_PARTS)


@query(
    "d18_null_rate_drift",
    f"WITH {NULL_SQL} SELECT w, feature, {q6('base')} AS baseline_null_rate, {q6('now')} AS current_null_rate, "
    f"{q6('delta')} AS delta, delta > 0.05 AS drifted FROM nd",
)
def _(spark, sf):
    return report(spark, sf).null_rate_drift().select(
        "w", "feature", r6("baseline_null_rate"), r6("current_null_rate"), r6("delta"), "drifted"
    )


@query(
    "d19_null_rate_points",
    f"WITH {NULL_SQL} SELECT w, feature, {q6('(now - base) * 100')} AS delta_pp, abs((now - base) * 100) > 5 AS alert FROM nd",
)
def _(spark, sf):
    return drift.null_rate_points(report(spark, sf).null_rate_drift()).select("w", "feature", r6("delta_pp"), "alert")


ORACLE_REFERENCE = f"""WITH {FE}, {PHASES}, {LNG}, {REF}, warm AS (SELECT * FROM fe WHERE w IN (SELECT w FROM ph WHERE phase = 'warmup')),
    edges AS (SELECT feature, quantile_cont(value, {SHARES}) AS e FROM ref GROUP BY feature),
    rb AS (SELECT feature, len(list_filter(e, lambda x: value >= x)) AS bin, count(*) AS n FROM ref JOIN edges USING (feature) GROUP BY 1, 2)
    SELECT 'value' AS part, feature, '' AS item, {q6('value')} AS place, CAST(count(*) AS DOUBLE) AS amount FROM ref GROUP BY feature, value
    UNION ALL SELECT 'edge', feature, '', CAST(g.i AS DOUBLE), {q6('e[g.i + 1]')} FROM edges CROSS JOIN range(9) g(i)
    UNION ALL SELECT 'bin', edges.feature, '', CAST(g.i AS DOUBLE), CAST(coalesce(rb.n, 0) AS DOUBLE)
    FROM edges CROSS JOIN range(10) g(i) LEFT JOIN rb ON rb.feature = edges.feature AND rb.bin = g.i
    UNION ALL SELECT 'frequency', 'device_type', device_type, NULL, {q6('count(*) * 1.0e0 / (SELECT count(device_type) FROM warm)')}
    FROM warm WHERE device_type IS NOT NULL GROUP BY device_type
    UNION ALL {' UNION ALL '.join(f"SELECT 'null_rate', '{c}', '', NULL, {q6(_null_share(c))} FROM warm" for c in COLUMNS)}"""


@query("d11_reference", ORACLE_REFERENCE)
def _(spark, sf):
    return reference_rows(report(spark, sf).reference.parts())


def reference_rows(parts: dict[str, DataFrame]) -> DataFrame:
    """Everything a reference holds, as one long table: values, bin edges and counts, frequencies, null rates."""
    none = F.lit(None).cast("double")

    def rows(frame: DataFrame, part: str, item: Column, place: Column, amount: Column) -> DataFrame:
        return frame.select(
            F.lit(part).alias("part"), "feature", item.alias("item"), place.alias("place"), amount.cast("double").alias("amount")
        )

    def listed(column: str, part: str, amount: Callable[[Column], Column]) -> DataFrame:
        each = parts["bins"].select("feature", F.posexplode(column).alias("i", "v"))
        return rows(each, part, F.lit(""), F.col("i").cast("double"), amount(F.col("v")))

    found = [
        rows(parts["values"], "value", F.lit(""), r6(F.col("value")), F.col("n")),
        listed("edges", "edge", r6),
        listed("reference_bins", "bin", lambda n: n),
        rows(parts["frequencies"], "frequency", F.col("category"), none, r6(F.col("reference_frequency"))),
        rows(parts["null_rates"], "null_rate", F.lit(""), none, r6(F.col("null_rate"))),
    ]
    return reduce(DataFrame.unionByName, found)


LONG_REPORT = (
    "SELECT w, feature, 'ks' AS method, ks_statistic AS statistic, p_value, CAST(NULL AS VARCHAR) AS level, "
    "coalesce(p_value < 0.05, false) AS drifted, skipped FROM ks "
    "UNION ALL SELECT w, feature, 'psi', psi, NULL, CASE WHEN psi > 0.2 THEN 'alert' WHEN psi > 0.1 THEN 'warning' ELSE 'ok' END, "
    "coalesce(psi > 0.1, false), skipped FROM psi "
    "UNION ALL SELECT w, feature, 'chi2', chi2_statistic, p_value, NULL, p_value < 0.05, false FROM chi "
    "UNION ALL SELECT w, feature, 'null_rate_drift', delta, NULL, NULL, delta > 0.05, false FROM nd"
)
COMPLEMENTARY_PARTS = (*KS_PARTS, *PSI_PARTS, *CHI2_PARTS, *NULL_PARTS, f"comp AS ({LONG_REPORT})")
COMPLEMENTARY_SQL = ctes(*COMPLEMENTARY_PARTS)
REPORT_SQL = ctes(
    *MMD_PARTS,
    *COMPLEMENTARY_PARTS,
    "rep AS (SELECT * FROM comp UNION ALL SELECT w, '', 'rff_mmd', mmd_score, NULL, NULL, mmd_drift, false FROM sc)",
)


@query(
    "d20_drift_report",
    f"WITH {REPORT_SQL} SELECT w, feature, method, {q6('statistic')} AS statistic, {q6('p_value')} AS p_value, level, drifted, skipped FROM rep",
)
def _(spark, sf):
    return report(spark, sf).report().select(
        "w", "feature", "method", r6("statistic"), r6("p_value"), "level", "drifted", "skipped"
    )


@query(
    "d21_drifted_features",
    f"WITH {COMPLEMENTARY_SQL} SELECT w, string_agg(DISTINCT feature, ',' ORDER BY feature) AS drifted_features FROM comp WHERE drifted GROUP BY w",
)
def _(spark, sf):
    found = drift.drifted_features(report(spark, sf).report(), "w")
    return found.select("w", F.array_join("drifted_features", ",").alias("drifted_features"))


# joins of the drift checks -----------------------------------------------------------
@query(
    "j3_category_union",
    f"""WITH {FE}, {PHASES},
    rc AS (SELECT device_type AS category, count(*) AS n FROM fe WHERE device_type IS NOT NULL
           AND w IN (SELECT w FROM ph WHERE phase = 'warmup') GROUP BY 1),
    rf AS (SELECT category, n * 1.0e0 / sum(n) OVER () AS f FROM rc),
    cc AS (SELECT device_type AS category, count(*) AS n FROM fe WHERE device_type IS NOT NULL
           AND w IN (SELECT w FROM ph WHERE phase = 'monitoring') GROUP BY 1)
    SELECT 'device_type' AS feature, category, coalesce(n, 0) AS observed,
           {q6('coalesce(f, 0.0001e0) * (SELECT CAST(sum(n) AS BIGINT) FROM cc)')} AS expected
    FROM rf FULL JOIN cc USING (category)""",
)
def _(spark, sf):
    r = report(spark, sf)
    counts = r.counted_categories
    current = counts.where("phase = 'monitoring'").groupBy("feature", "category").agg(F.sum("n").alias("n"))
    frequencies = drift.reference_frequencies(counts.where("phase = 'warmup'"))
    return drift.expected_and_observed(frequencies, current).select("feature", "category", "observed", r6("expected"))


@query("j6_null_rate_join", f"WITH {NULL_SQL} SELECT w, feature, {q6('base')} AS baseline_null_rate, {q6('now')} AS current_null_rate FROM nd")
def _(spark, sf):
    return report(spark, sf).null_rate_drift().select(
        "w", "feature", r6("baseline_null_rate"), r6("current_null_rate")
    )


@query(
    "j8_rows_by_components",
    f"WITH {MMD_SQL} SELECT w, d, n AS rows, {q6('z / n')} AS mean FROM zs",
)
def _(spark, sf):
    """Rows times components without a join: sums per task, then per window."""
    sums = report(spark, sf).component_sums.select("w", "rows", F.posexplode("sums").alias("d", "z"))
    return sums.select("w", "d", "rows", r6(F.col("z") / F.col("rows"), "mean"))


@query(
    "j9_sample_pairs",
    f"""WITH {FE}, {LNG}, h AS (SELECT *, md5(CAST(event_id AS VARCHAR)) AS h FROM lng),
    bkt AS (SELECT *, CAST('0x' || substr(h, 1, 8) AS BIGINT) % greatest(1, (SELECT count(*) FROM h) // 100000) AS bucket FROM h),
    smp AS (SELECT *, row_number() OVER (PARTITION BY feature, bucket ORDER BY h, event_id) AS i FROM bkt)
    SELECT a.feature, {q6('sqrt(quantile_cont((a.value - b.value) * (a.value - b.value), 0.5) / 2)')} AS sigma
    FROM smp a JOIN smp b ON a.feature = b.feature AND a.bucket = b.bucket AND a.i % 2 = 1 AND b.i = a.i + 1
    WHERE (a.value - b.value) * (a.value - b.value) > 0 GROUP BY a.feature""",
)
def _(spark, sf):
    """Median distance of the neighbouring pairs of all values of every feature."""
    values = long_numeric(feature_events(spark, sf), ["event_id"], NUMERIC).where(F.col("value").isNotNull())
    return mmd.feature_bandwidths(values, NUMERIC, ["event_id"]).select("feature", r6("sigma"))
