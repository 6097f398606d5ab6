"""Baselines as tables: snapshots, comparison and the named registry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.base import FE, NUMERIC, q6, query, r6
from plumbline.operators import registry, stats
from plumbline.plans.views import feature_events
from plumbline.session import scratch_path

EARLY = "early AS (SELECT * FROM fe WHERE w <= DATE '2024-01-05')"
LATE = "late AS (SELECT * FROM fe WHERE w >= DATE '2024-01-24')"


def _early(df: DataFrame) -> DataFrame:
    return df.where(F.col("w") <= F.lit("2024-01-05").cast("date"))


def _late(df: DataFrame) -> DataFrame:
    return df.where(F.col("w") >= F.lit("2024-01-24").cast("date"))


def _registry(spark: SparkSession, sf: str, *names: str) -> registry.BaselineRegistry:
    """A fresh registry with all rows under each of the names."""
    kept = registry.BaselineRegistry(spark, scratch_path(spark, "registry"))
    for name in names:
        kept.register(name, feature_events(spark, sf), ["event_id"])
    return kept


def _early_registry(spark: SparkSession, sf: str) -> registry.BaselineRegistry:
    """A fresh registry with the early rows as ``v1``, for comparison with the late ones."""
    kept = registry.BaselineRegistry(spark, scratch_path(spark, "registry"))
    kept.register("v1", _early(feature_events(spark, sf)), ["event_id"])
    return kept


def _stat(alias: str, name: str) -> str:
    return {
        "mean": f"avg(CAST({name} AS DOUBLE))",
        "std": f"stddev_pop(CAST({name} AS DOUBLE))",
        "null_rate": f"(count(*) - count({name})) * 1.0e0 / count(*)",
    }[alias]


def _stats_cte(table: str, out: str) -> str:
    rows = " UNION ALL ".join(
        f"SELECT '{c}' AS feature, count(*) AS total, count({c}) AS count, count(*) - count({c}) AS null_count, "
        f"{_stat('null_rate', c)} AS null_rate, {_stat('mean', c)} AS mean, {_stat('std', c)} AS std, "
        f"quantile_cont(CAST({c} AS DOUBLE), 0.05) AS p5, quantile_cont(CAST({c} AS DOUBLE), 0.95) AS p95 FROM {table}"
        for c in NUMERIC
    )
    return f"{out} AS ({rows})"


STATS_SQL = (
    f"WITH {FE}, {_stats_cte('fe', 'st')} SELECT feature, total, count, null_count, {q6('mean')} AS mean, "
    f"{q6('std')} AS std, {q6('p5')} AS p5, {q6('p95')} AS p95, CAST(least(count, 200) AS INT) AS sample_size FROM st"
)


def _stats_rows(stored: DataFrame) -> DataFrame:
    return stored.select(
        "feature", "total", "count", "null_count", r6("mean"), r6("std"),
        r6(F.col("percentiles")[0], "p5"), r6(F.col("percentiles")[4], "p95"), F.size("sample").alias("sample_size"),
    )


@query("b1_register", STATS_SQL)
def _(spark, sf):
    """Registering a name twice keeps the first; what is stored is read back."""
    kept = _registry(spark, sf, "v1")
    kept.register("v1", _late(feature_events(spark, sf)), ["event_id"])
    return _stats_rows(kept.stats("v1"))


@query(
    "b2_get_baseline",
    f"""WITH {FE}, t AS (SELECT count(*) AS n FROM fe)
    SELECT 'device_type' AS feature, device_type AS category, count(*) AS n, {q6('count(*) * 1.0e0 / max(t.n)')} AS frequency
    FROM fe CROSS JOIN t GROUP BY device_type""",
)
def _(spark, sf):
    return _registry(spark, sf, "v1").frequencies("v1").select("feature", "category", "n", r6("frequency"))


@query("b3_list_baselines", "SELECT * FROM (VALUES ('v1'), ('v2')) t(baseline_name) WHERE (SELECT count(*) FROM events) > 0")
def _(spark, sf):
    return _registry(spark, sf, "v1", "v2").names()


@query("b4_delete_baseline", "SELECT * FROM (VALUES ('v2')) t(baseline_name) WHERE (SELECT count(*) FROM events) > 0")
def _(spark, sf):
    kept = _registry(spark, sf, "v1", "v2")
    assert kept.delete("v1") and not kept.delete("v1")
    return kept.names()


COMPARE_SQL = f"""WITH {FE}, {EARLY}, {LATE}, {_stats_cte('early', 'b')}, {_stats_cte('late', 'c')},
j AS (SELECT feature, abs(coalesce(c.mean, 0) - coalesce(b.mean, 0)) AS mean_shift,
             CASE WHEN coalesce(b.std, 0) = 0 THEN 1.0e0 ELSE coalesce(nullif(c.std, 0), 1) / b.std END AS std_ratio,
             abs(c.null_rate - b.null_rate) AS null_delta, coalesce(nullif(b.std, 0), 1) AS limit_std
      FROM b JOIN c USING (feature))"""


@query(
    "b5_compare_numeric",
    f"{COMPARE_SQL} SELECT feature, {q6('mean_shift')} AS mean_shift, {q6('std_ratio')} AS std_ratio, "
    f"{q6('null_delta')} AS null_delta, mean_shift > 2 * limit_std OR null_delta > 0.05 AS drift_signal FROM j",
)
def _(spark, sf):
    numeric, _ = _early_registry(spark, sf).compare("v1", _late(feature_events(spark, sf)))
    return numeric.select("feature", r6("mean_shift"), r6("std_ratio"), r6("null_delta"), "drift_signal")


@query(
    "j7_stats_join",
    f"{COMPARE_SQL} SELECT feature, {q6('mean_shift')} AS mean_shift FROM j",
)
def _(spark, sf):
    events = feature_events(spark, sf)
    base, now = (stats.numeric_stats(part(events), [], NUMERIC) for part in (_early, _late))
    return registry.compare_numeric(base, now).select("feature", r6("mean_shift"))


CATS = f"""WITH {FE}, {EARLY}, {LATE},
b AS (SELECT DISTINCT device_type AS category FROM early WHERE device_type IS NOT NULL),
c AS (SELECT DISTINCT device_type AS category FROM late WHERE device_type IS NOT NULL)"""


@query(
    "b6_compare_categorical",
    f"""{CATS} SELECT 'device_type' AS feature, (SELECT count(*) FROM c WHERE category NOT IN (SELECT category FROM b)) AS new_categories,
      (SELECT count(*) FROM b WHERE category NOT IN (SELECT category FROM c)) AS missing_categories,
      (SELECT count(*) FROM (SELECT category FROM b EXCEPT SELECT category FROM c UNION ALL (SELECT category FROM c EXCEPT SELECT category FROM b))) > 0 AS drift_signal""",
)
def _(spark, sf):
    _, categorical = _early_registry(spark, sf).compare("v1", _late(feature_events(spark, sf)))
    return categorical


def _changes(spark: SparkSession, sf: str) -> DataFrame:
    events = feature_events(spark, sf)
    # The later rows have a category the earlier ones lack, and the other way round
    # once the days with it are the baseline.
    return registry.category_changes(
        stats.category_counts(_early(events), [], ["device_type"]),
        stats.category_counts(_late(events), [], ["device_type"]),
    )


@query("j4_new_categories", f"{CATS} SELECT 'device_type' AS feature, category FROM c WHERE category NOT IN (SELECT category FROM b)")
def _(spark, sf):
    return _changes(spark, sf).where("change = 'new'").drop("change")


@query("j5_missing_categories", f"{CATS} SELECT 'device_type' AS feature, category FROM c WHERE category NOT IN (SELECT category FROM b)")
def _(spark, sf):
    """With the late rows as the baseline, their extra category is missing early."""
    events = feature_events(spark, sf)
    changed = registry.category_changes(
        stats.category_counts(_late(events), [], ["device_type"]),
        stats.category_counts(_early(events), [], ["device_type"]),
    )
    return changed.where("change = 'missing'").drop("change")


@query(
    "b7_registry_summary",
    f"WITH {FE} SELECT n.baseline_name, (SELECT count(*) FROM fe) AS row_count, 5 AS features FROM (VALUES ('v1'), ('v2')) n(baseline_name)",
)
def _(spark, sf):
    return _registry(spark, sf, "v1", "v2").summary().drop("computed_at")


@query(
    "b8_unknown_baseline",
    f"""WITH {FE} SELECT device_type AS name, count(*) AS n, CASE WHEN device_type <> 'mobile' THEN 'Baseline ''' || device_type || ''' not found' END AS error
    FROM fe WHERE device_type IS NOT NULL GROUP BY device_type""",
)
def _(spark, sf):
    """Baselines are asked for by the table's device types, of which one is registered."""
    events = feature_events(spark, sf)
    kept = _registry(spark, sf, "mobile")
    asked = events.where(F.col("device_type").isNotNull()).groupBy(F.col("device_type").alias("name")).agg(
        F.count(F.lit(1)).alias("n")
    )

    return kept.unknown(asked, "name")
