"""What the plans must look like to hold at scale."""

import pytest
from pyspark.sql import functions as F

from plumbline import Rule
from plumbline.functions import ranking
from plumbline.functions.frames import long_categorical, long_numeric
from plumbline.operators import model, stats
from plumbline.operators.validate import Validation
from plumbline.plans.views import LINE_CATEGORICAL, LINE_NUMERIC, events_table, line_features, predictions
from plumbline.session import scratch_path, settle, shared_dir


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def test_order_statistics_read_the_table_once(spark, sf_dir):
    rows = long_numeric(line_features(spark, sf_dir), ["w"], LINE_NUMERIC)
    counted = ranking.value_counts(rows, ["w", "feature"])
    plan = final_plan(ranking.percentiles(counted, ["feature"], ["feature", "w"], [0.5]))
    assert plan.count("FileScan") == 1 and plan.count("ReusedExchange") >= 1
    assert "WindowGroupLimit" in plan and "partial_count(1)" in plan
    assert "hashpartitioning(feature" in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_only_needed_columns_are_read(spark, sf_dir):
    checked = Validation(events_table(spark, sf_dir).select("user_id", "value", "ts", F.to_date("ts").alias("w")), ["w"],
                         [Rule("value", low=0.0)])
    plan = final_plan(checked.validity())
    assert "ReadSchema: struct<ts:timestamp_ntz,value:double>" in plan and plan.count("Exchange hash") == 1


def test_samples_and_last_pairs_are_limited_before_the_shuffle(spark, sf_dir):
    lines = line_features(spark, sf_dir)
    sample = stats.value_sample(lines, [], LINE_NUMERIC, ["l_orderkey", "l_linenumber"], 10)
    assert final_plan(sample).count("WindowGroupLimit") == 2
    scored = predictions(spark, sf_dir)
    recent = model.last_pairs(scored, model.model_phases(scored, "w"), "w", ["ts", "event_id"], 20)
    assert final_plan(recent).count("WindowGroupLimit") == 2


def test_counts_are_combined_before_the_shuffle(spark, sf_dir):
    plan = final_plan(stats.category_counts(line_features(spark, sf_dir), ["w"], LINE_CATEGORICAL))
    assert plan.index("functions=[count(1)]") < plan.index("Exchange hash") < plan.index("functions=[partial_count(1)]")


def test_frames_without_a_listed_feature_are_empty(spark):
    df = spark.range(3)
    assert long_numeric(df, ["id"], ["absent"]).count() == 0
    assert stats.category_counts(df, [], ["absent"]).count() == 0
    assert long_categorical(df, ["id"], ["absent"]).columns == ["id", "feature", "category"]


def test_settled_rows_are_below_the_shared_folder(spark):
    kept = settle(spark.range(5), "t")
    assert kept.inputFiles()[0].removeprefix("file://").startswith(shared_dir(spark).removeprefix("file://"))
    assert kept.count() == 5 and scratch_path(spark, "a") != scratch_path(spark, "a")
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        path = scratch_path(spark, "b")
        for _ in range(2):
            spark.range(1).write.parquet(path)
