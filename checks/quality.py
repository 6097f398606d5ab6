"""Projections, validation, aggregation and feature statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.base import (
    COLUMNS, FE, ISSUES, LNG, NUMERIC, PHASES, VALIDITY, q6, query, r6,
)
from plumbline.functions.frames import complete_rows, long_numeric
from plumbline.functions.scalars import mmd_band, validity_band
from plumbline.operators import phases, stats, validate
from plumbline.plans.views import LINE_CATEGORICAL, LINE_NUMERIC, events_table, feature_events, line_features

W = ["w"]
LINE_LNG = "lng AS (" + " UNION ALL ".join(
    f"SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS w, '{c}' AS feature, {c} AS value FROM lineitem"
    for c in LINE_NUMERIC
) + ")"


# projections and predicates ------------------------------------------------------
DEVICES = ("mobile", "desktop", "tablet", "smartwatch")


@query("p1_flatten_struct", f"WITH {FE} SELECT event_id, age, device_type FROM fe")
def _(spark: SparkSession, sf: str) -> DataFrame:
    nested = feature_events(spark, sf).select(F.struct("event_id", "age", "device_type").alias("d"))
    return nested.select("d.*")


@query("p2_numeric_subset", f"WITH {FE} SELECT {', '.join(NUMERIC)} FROM fe")
def _(spark, sf):
    return feature_events(spark, sf).select(*NUMERIC)


@query("p3_null_predicate", f"WITH {FE} SELECT event_id, w FROM fe WHERE age IS NULL")
def _(spark, sf):
    return feature_events(spark, sf).where(F.col("age").isNull()).select("event_id", "w")


@query(
    "p4_range_predicate",
    f"WITH {FE} SELECT event_id, age, purchase_amount FROM fe WHERE age < 0 OR age > 120 OR purchase_amount < 0",
)
def _(spark, sf):
    bad = validate.out_of_range("age", 0, 120, False) | validate.out_of_range("purchase_amount", 0.0, None)
    return feature_events(spark, sf).where(bad).select("event_id", "age", "purchase_amount")


@query(
    "p5_category_predicate",
    f"WITH {FE} SELECT event_id, device_type FROM fe WHERE device_type NOT IN ('mobile', 'desktop', 'tablet')",
)
def _(spark, sf):
    bad = validate.not_allowed("device_type", ["mobile", "desktop", "tablet"])
    return feature_events(spark, sf).where(bad).select("event_id", "device_type")


@query(
    "p6_complete_rows",
    f"WITH {FE} SELECT event_id, w FROM fe WHERE age IS NOT NULL AND purchase_amount IS NOT NULL "
    "AND session_duration IS NOT NULL AND page_views IS NOT NULL",
)
def _(spark, sf):
    return complete_rows(feature_events(spark, sf), NUMERIC).select("event_id", "w")


@query("p7_non_null_values", f"WITH {FE}, {LNG} SELECT event_id, feature, value FROM lng")
def _(spark, sf):
    return long_numeric(feature_events(spark, sf), ["event_id"], NUMERIC).where(F.col("value").isNotNull())


@query(
    "p8_missing_column",
    f"WITH {FE} SELECT w, 'missing_column' AS issue_type, 'age' AS feature, count(*) AS count, 1.0e0 AS rate "
    "FROM fe GROUP BY w",
)
def _(spark, sf):
    found = validate.Validation(feature_events(spark, sf).drop("age"), W).issues()
    return found.where(F.col("feature") == "age").select("w", "issue_type", "feature", "count", "rate")


@query("p9_empty_window", f"WITH {FE} SELECT w, count(*) AS total FROM fe WHERE age > 120 GROUP BY w")
def _(spark, sf):
    """Windows that are empty after a filter give no row."""
    kept = feature_events(spark, sf).where(F.col("age") > 120)
    return validate.Validation(kept, W).validity().select("w", "total")


@query(
    "p10_unpivot",
    f"WITH {FE} "
    + " UNION ALL ".join(
        f"SELECT event_id, '{c}' AS feature, CAST({c} AS DOUBLE) AS value FROM fe" for c in NUMERIC
    ),
)
def _(spark, sf):
    return long_numeric(feature_events(spark, sf), ["event_id"], NUMERIC)


@query(
    "p11_round",
    f"WITH {FE} SELECT w, round(avg(purchase_amount), 4) AS mean_4, round(avg(purchase_amount), 6) AS mean_6 "
    "FROM fe GROUP BY w",
)
def _(spark, sf):
    mean = F.avg("purchase_amount")
    return feature_events(spark, sf).groupBy("w").agg(F.round(mean, 4).alias("mean_4"), F.round(mean, 6).alias("mean_6"))


@query(
    "p12_kpi_bands",
    f"""WITH {FE}, {ISSUES}, {VALIDITY}
    SELECT w, CASE WHEN validity_rate > 0.95 THEN 'ok' WHEN validity_rate > 0.8 THEN 'warn' ELSE 'crit' END AS validity_band,
           CASE WHEN 1 - row_validity_rate > 0.25 THEN 'crit' ELSE 'ok' END AS score_band
    FROM validity""",
)
def _(spark, sf):
    validity = validate.Validation(feature_events(spark, sf), W).validity()
    return validity.select(
        "w",
        validity_band(F.col("validity_rate")).alias("validity_band"),
        mmd_band(1 - F.col("row_validity_rate"), F.lit(0.25)).alias("score_band"),
    )


@query(
    "p13_incremental_filter",
    f"WITH {FE}, {ISSUES}, {VALIDITY} SELECT w, total, {q6('validity_rate')} AS validity_rate FROM validity "
    "WHERE w > DATE '2024-01-19'",
)
def _(spark, sf):
    validity = validate.Validation(feature_events(spark, sf), W).validity()
    return validity.where(F.col("w") > F.lit("2024-01-19").cast("date")).select("w", "total", r6("validity_rate"))


# validation ---------------------------------------------------------------------
ISSUE_COLUMNS = "w, feature, issue_type, count, total, rule, allowed, " + q6("rate") + " AS rate"


def _issues(spark: SparkSession, sf: str) -> DataFrame:
    return validate.Validation(feature_events(spark, sf), W).issues().select(
        "w", "feature", "issue_type", "count", "total", "rule", F.array_join("allowed", ", ").alias("allowed"), r6("rate")
    )


@query("g1_window_rows", f"WITH {FE} SELECT w, count(*) AS rows FROM fe GROUP BY w")
def _(spark, sf):
    return stats.window_row_counts(feature_events(spark, sf), W)


@query(
    "v1_null_violations",
    f"WITH {FE}, {ISSUES} SELECT w, feature, count, {q6('rate')} AS rate FROM issues WHERE issue_type = 'null_value'",
)
def _(spark, sf):
    return _issues(spark, sf).where("issue_type = 'null_value'").select("w", "feature", "count", "rate")


@query(
    "v2_range_violations",
    f"WITH {FE}, {ISSUES} SELECT w, feature, count, {q6('rate')} AS rate, rule FROM issues "
    "WHERE issue_type = 'range_violation'",
)
def _(spark, sf):
    return _issues(spark, sf).where("issue_type = 'range_violation'").select("w", "feature", "count", "rate", "rule")


@query(
    "v3_category_violations",
    f"WITH {FE}, {ISSUES} SELECT w, feature, count, {q6('rate')} AS rate, allowed FROM issues "
    "WHERE issue_type = 'invalid_category'",
)
def _(spark, sf):
    return _issues(spark, sf).where("issue_type = 'invalid_category'").select("w", "feature", "count", "rate", "allowed")


@query("v4_issue_list", f"WITH {FE}, {ISSUES} SELECT {ISSUE_COLUMNS} FROM issues")
def _(spark, sf):
    return _issues(spark, sf)


@query(
    "v5_validity_rate",
    f"WITH {FE}, {ISSUES}, {VALIDITY} SELECT w, total, {q6('validity_rate')} AS validity_rate, "
    f"{q6('row_validity_rate')} AS row_validity_rate FROM validity",
)
def _(spark, sf):
    return validate.Validation(feature_events(spark, sf), W).validity().select(
        "w", "total", r6("validity_rate"), r6("row_validity_rate")
    )


@query("v6_issue_count", f"WITH {FE}, {ISSUES}, {VALIDITY} SELECT w, issue_count FROM validity")
def _(spark, sf):
    return validate.Validation(feature_events(spark, sf), W).validity().select("w", "issue_count")


@query(
    "v7_null_rates",
    f"WITH {FE} "
    + " UNION ALL ".join(
        f"SELECT w, '{c}' AS feature, {q6(f'avg(CASE WHEN {chr(34)}{c}{chr(34)} IS NULL THEN 1.0e0 ELSE 0.0e0 END)')} AS null_rate "
        "FROM fe GROUP BY w"
        for c in COLUMNS
    ),
)
def _(spark, sf):
    return validate.null_rates(feature_events(spark, sf), W, COLUMNS).select("w", "feature", r6("null_rate"))


@query(
    "v8_rule_settings",
    f"""WITH {FE}, c AS (
      SELECT w, count(*) AS total, count(*) FILTER (WHERE page_views IS NULL) AS n,
             count(*) FILTER (WHERE page_views < 2 OR page_views > 40) AS r FROM fe GROUP BY w)
    SELECT w, 'page_views' AS feature, 'range_violation' AS issue_type, r AS count, '[2, 40]' AS rule FROM c WHERE r > 0
    UNION ALL SELECT w, 'page_views', 'null_value', n, NULL FROM c WHERE n > 0""",
)
def _(spark, sf):
    """Rules read from a configuration mapping."""
    from plumbline.settings import rules_from_mapping

    rules = rules_from_mapping({"page_views": {"nullable": False, "min": 2, "max": 40}})
    return validate.Validation(feature_events(spark, sf), W, rules).issues().select(
        "w", "feature", "issue_type", "count", "rule"
    )


@query(
    "v9_summary_lines",
    f"""WITH {FE}, {ISSUES}, {VALIDITY}
    SELECT w, '' AS feature, '' AS issue_type,
      CASE WHEN issue_count = 0 THEN '[batch ' || w || '] ✓ All ' || total || ' rows passed validation.'
           ELSE printf('[batch %s] ⚠ %d issue type(s) found in %d rows (validity rate: %.1f%%)',
                       CAST(w AS VARCHAR), issue_count, total, validity_rate * 100) END AS line
    FROM validity
    UNION ALL
    SELECT w, feature, issue_type,
      printf('  → [%s] feature=''%s'' count=%d rate=%.2f%%', issue_type, feature, count, rate * 100) FROM issues""",
)
def _(spark, sf):
    return validate.summary_lines(validate.Validation(feature_events(spark, sf), W))


# categories ---------------------------------------------------------------------
CATS = """cats AS (SELECT CAST(date_trunc('month', l_shipdate) AS DATE) AS w, 'l_returnflag' AS feature, l_returnflag AS category
            FROM lineitem
          UNION ALL SELECT CAST(date_trunc('month', l_shipdate) AS DATE), 'l_linestatus', l_linestatus FROM lineitem)"""


@query("g2_category_counts", f"WITH {CATS} SELECT w, feature, category, count(*) AS n FROM cats GROUP BY w, feature, category")
def _(spark, sf):
    return stats.category_counts(line_features(spark, sf), W, LINE_CATEGORICAL)


@query(
    "g3_category_frequencies",
    f"""WITH {FE}, c AS (SELECT w, device_type AS category, count(*) AS n FROM fe WHERE device_type IS NOT NULL GROUP BY 1, 2)
    SELECT w, 'device_type' AS feature, category, n, {q6('n * 1.0e0 / sum(n) OVER (PARTITION BY w)')} AS frequency FROM c""",
)
def _(spark, sf):
    counts = stats.category_counts(feature_events(spark, sf), W, ["device_type"])
    return stats.category_frequencies(counts, W, of_all_rows=False).select("w", "feature", "category", "n", r6("frequency"))


@query(
    "g4_cardinality",
    f"WITH {CATS} SELECT w, feature, count(DISTINCT category) AS cardinality FROM cats GROUP BY w, feature",
)
def _(spark, sf):
    counts = stats.category_counts(line_features(spark, sf), W, LINE_CATEGORICAL)
    return stats.categorical_stats(counts, W).select("w", "feature", "cardinality")


# statistics ----------------------------------------------------------------------
def _stats_sql(with_clause: str, rows: str) -> str:
    return f"""WITH {with_clause}
    SELECT w, feature, count(value) AS count, count(*) - count(value) AS null_count,
           {q6('(count(*) - count(value)) * 1.0e0 / count(*)')} AS null_rate, {q6('avg(value)')} AS mean,
           {q6('stddev_pop(value)')} AS std, {q6('min(value)')} AS min, {q6('max(value)')} AS max
    FROM {rows} GROUP BY w, feature"""


ALL_VALUES = "allv AS (" + " UNION ALL ".join(
    f"SELECT w, '{c}' AS feature, CAST({c} AS DOUBLE) AS value FROM fe" for c in NUMERIC
) + ")"


def _stat_columns():
    return ["w", "feature", "count", "null_count", *[r6(c) for c in ("null_rate", "mean", "std", "min", "max")]]


@query("f1_numeric_stats", _stats_sql(f"{FE}, {ALL_VALUES}", "allv"))
def _(spark, sf):
    return stats.numeric_stats(feature_events(spark, sf), W, NUMERIC).select(*_stat_columns())


@query("f1_numeric_stats_lines", _stats_sql(LINE_LNG, "lng"))
def _(spark, sf):
    return stats.numeric_stats(line_features(spark, sf), W, LINE_NUMERIC).select(*_stat_columns())


def _percentile_sql(with_clause: str) -> str:
    shares = {"p5": 0.05, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p95": 0.95}
    columns = ", ".join(f"{q6(f'quantile_cont(value, {s})')} AS {n}" for n, s in shares.items())
    return f"WITH {with_clause} SELECT w, feature, count(*) AS n, {columns} FROM lng GROUP BY w, feature"


def _percentiles(frame: DataFrame, features) -> DataFrame:
    names = ("p5", "p25", "p50", "p75", "p95")
    found = stats.numeric_percentiles(frame, W, features)
    return found.select("w", "feature", "n", *[r6(F.col("percentiles")[i], n) for i, n in enumerate(names)])


@query("f2_percentiles", _percentile_sql(f"{FE}, {LNG}"))
def _(spark, sf):
    return _percentiles(feature_events(spark, sf), NUMERIC)


@query("f2_percentiles_lines", _percentile_sql(LINE_LNG))
def _(spark, sf):
    return _percentiles(line_features(spark, sf), LINE_NUMERIC)


@query(
    "f3_value_sample",
    f"""WITH {FE}, {LNG}, r AS (
      SELECT feature, event_id, value, row_number() OVER (
        PARTITION BY feature ORDER BY md5(CAST(event_id AS VARCHAR)), value) AS sample_rank FROM lng)
    SELECT feature, CAST(sample_rank AS INT) AS sample_rank, {q6('value')} AS value FROM r WHERE sample_rank <= 200""",
)
def _(spark, sf):
    return stats.value_sample(feature_events(spark, sf), [], NUMERIC, ["event_id"]).select(
        "feature", "sample_rank", r6("value")
    )


@query(
    "f4_categorical_stats",
    f"""WITH {FE} SELECT w, 'device_type' AS feature, count(*) - count(device_type) AS null_count,
      {q6('(count(*) - count(device_type)) * 1.0e0 / count(*)')} AS null_rate, count(DISTINCT device_type) AS cardinality,
      {", ".join(f"{q6(f"""count(*) FILTER (WHERE device_type = '{c}') * 1.0e0 / count(*)""")} AS {c}" for c in DEVICES)}
    FROM fe GROUP BY w""",
)
def _(spark, sf):
    counts = stats.category_counts(feature_events(spark, sf), W, ["device_type"])
    shares = stats.frequency_maps(counts, W)
    return stats.categorical_stats(counts, W).join(shares, ["w", "feature"]).select(
        "w", "feature", "null_count", r6("null_rate"), "cardinality", *[r6(F.coalesce(F.col("frequencies")[c], F.lit(0.0)), c) for c in DEVICES]
    )


@query(
    "f5_describe",
    f"""WITH {FE}, {LNG} SELECT feature, count(*) AS count, {q6('avg(value)')} AS mean, {q6('stddev_samp(value)')} AS stddev,
      {q6('min(value)')} AS min, {q6('quantile_cont(value, 0.25)')} AS p25, {q6('quantile_cont(value, 0.5)')} AS p50,
      {q6('quantile_cont(value, 0.75)')} AS p75, {q6('max(value)')} AS max FROM lng GROUP BY feature""",
)
def _(spark, sf):
    return stats.describe(feature_events(spark, sf), [], NUMERIC).select(
        "feature", "count", *[r6(c) for c in ("mean", "stddev", "min", "p25", "p50", "p75", "max")]
    )


@query(
    "f6_histogram",
    f"""WITH {FE}, {LNG}, e AS (SELECT feature, min(value) AS lo, (max(value) - min(value)) / 30 AS width FROM lng GROUP BY feature),
    b AS (SELECT feature, CAST(least(floor((value - lo) / width), 29) AS INT) AS bin, count(*) AS n
          FROM lng JOIN e USING (feature) GROUP BY 1, 2)
    SELECT e.feature, CAST(g.bin AS INT) AS bin, {q6('lo + g.bin * width')} AS bin_low, {q6('lo + (g.bin + 1) * width')} AS bin_high,
           coalesce(n, 0) AS n
    FROM e CROSS JOIN range(30) g(bin) LEFT JOIN b ON b.feature = e.feature AND b.bin = g.bin""",
)
def _(spark, sf):
    return stats.histogram(feature_events(spark, sf), NUMERIC, 30).select(
        "feature", "bin", r6("bin_low"), r6("bin_high"), "n"
    )


@query(
    "d8_phases",
    f"WITH {FE}, {PHASES} SELECT w, n AS rows, complete_rows, CAST(before AS BIGINT) AS windows_before, "
    "CAST(after AS BIGINT) AS windows_after, phase FROM ph",
)
def _(spark, sf):
    return phases.window_phases(feature_events(spark, sf), "w", NUMERIC)


@query(
    "s2_decode_json",
    """SELECT CASE WHEN event_id % 11 = 0 THEN NULL ELSE CAST(event_id AS VARCHAR) END AS event_id,
      CASE WHEN event_id % 11 = 0 OR event_id % 7 = 0 THEN NULL ELSE CAST(json_extract_string(props, '$.k') AS INT) END AS age,
      CASE WHEN event_id % 11 = 0 THEN NULL ELSE value END AS purchase_amount FROM events""",
)
def _(spark, sf):
    """Every 7th event has a text where a number belongs, every 11th is broken JSON."""
    from plumbline.sources.records import decode

    k = F.get_json_object("props", "$.k")
    age = F.when(F.col("event_id") % 7 == 0, F.lit('"unknown"')).otherwise(k)
    text = F.format_string(
        '{"event_id":"%d","age":%s,"purchase_amount":%s,"extra":1}',
        F.col("event_id"),
        age,
        F.col("value").cast("string"),
    )
    broken = F.when(F.col("event_id") % 11 == 0, F.lit("{not json")).otherwise(text)
    return decode(events_table(spark, sf).select(broken.alias("value"))).select("event_id", "age", "purchase_amount")
