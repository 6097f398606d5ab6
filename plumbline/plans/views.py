"""Feature, prediction and label views over the given tables.

The tables carry no faults of their own, so fixed expressions on the event id
and the day put them in: nulls (days 20-21), impossible values (22-23), broken
records (24-25) and a shifted distribution (26-30).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FEATURE_EVENTS = """
WITH e AS (
  SELECT event_id, user_id, ts, value, event_type, CAST({json_k} AS INT) AS k,
         CAST(ts AS DATE) AS w, CAST(EXTRACT(day FROM ts) AS INT) AS d
  FROM {events})
SELECT event_id, w, ts,
  CASE WHEN d BETWEEN 24 AND 25 AND event_id % 3 = 2 THEN NULL ELSE user_id END AS user_id,
  CASE WHEN d BETWEEN 20 AND 21 AND event_id % 5 <> 0 AND event_id % 3 <> 1 THEN NULL
       WHEN d BETWEEN 22 AND 23 AND event_id % 3 = 0 THEN 130 + CAST(event_id % 870 AS INT)
       WHEN d BETWEEN 24 AND 25 AND event_id % 3 = 1 THEN NULL
       WHEN d >= 26 THEN 65 + CAST((event_id * 31 + user_id) % 41 AS INT)
       ELSE 18 + CAST((event_id * 31 + user_id) % 58 AS INT) END AS age,
  CASE WHEN d BETWEEN 20 AND 21 AND event_id % 5 <> 0 AND event_id % 3 <> 2 THEN NULL
       WHEN d BETWEEN 22 AND 23 AND event_id % 3 = 1 THEN -value
       WHEN d >= 26 THEN CAST(2000 AS DOUBLE) + value * 30 ELSE value END AS purchase_amount,
  CASE WHEN d BETWEEN 20 AND 21 AND event_id % 5 <> 0 AND event_id % 3 = 1 THEN NULL
       WHEN d BETWEEN 22 AND 23 AND event_id % 3 = 2 THEN -1 - k ELSE 30 + k * 36 END AS session_duration,
  CASE WHEN d >= 26 THEN 1 + CAST((event_id * 17) % 5 AS INT)
       ELSE 1 + CAST((event_id * 17) % 50 AS INT) END AS page_views,
  CASE WHEN d BETWEEN 24 AND 25 AND event_id % 3 = 0 THEN 'smartwatch'
       WHEN event_type IN ('click','view') THEN 'mobile'
       WHEN event_type IN ('purchase','signup') THEN 'desktop' ELSE 'tablet' END AS device_type,
  {millis} AS timestamp
FROM e
"""

PREDICTIONS = """
WITH b AS (
  SELECT event_id, ts, CAST(ts AS DATE) AS w, CAST(EXTRACT(day FROM ts) AS INT) AS d,
         ((event_id * 7919 + user_id * 104729) % 10000) / 10000e0 AS base
  FROM {events}),
s AS (SELECT event_id, ts, w, CASE WHEN d >= 26 THEN 0.5e0 + base / 2 ELSE base END AS predicted_score FROM b)
SELECT event_id, ts, w, predicted_score,
       CASE WHEN predicted_score > 0.5e0 THEN 1 ELSE 0 END AS predicted_label, 'v1.0' AS model_version
FROM s
"""

LABELS = """
SELECT event_id, ts + (event_id % 24) * INTERVAL '1' HOUR AS label_ts,
       CASE WHEN ((event_id * 7919 + user_id * 104729) % 10000) / 10000e0
                 + 0.6e0 * (((event_id * 15485863) % 1000) / 1000e0 - 0.5e0) > 0.5e0
            THEN 1 ELSE 0 END AS true_label
FROM {events}
WHERE event_id % 4 <> 0
"""


def events_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def feature_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    query = FEATURE_EVENTS.format(
        events="{events}",
        json_k="get_json_object(props, '$.k')",
        millis="unix_millis(CAST(ts AS TIMESTAMP))",
    )
    return spark.sql(query, events=events_table(spark, sf_dir))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(PREDICTIONS, events=events_table(spark, sf_dir))


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(LABELS, events=events_table(spark, sf_dir))


LINE_NUMERIC = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
LINE_CATEGORICAL = ("l_returnflag", "l_linestatus")


def line_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as features, one window per ship month."""
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        F.to_date(F.date_trunc("month", "l_shipdate")).alias("w"),
        "l_orderkey",
        "l_linenumber",
        *LINE_NUMERIC,
        *LINE_CATEGORICAL,
    )
