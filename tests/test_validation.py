import pytest

from plumbline import Rule, settings_from_mapping
from plumbline.operators import validate
from plumbline.settings import rules_from_mapping

SCHEMA = (
    "w int, user_id string, age int, purchase_amount double, session_duration int, page_views int, "
    "device_type string, timestamp long"
)


def row(w=1, user="u", age=30, amount=1.0, duration=60, views=3, device="mobile", at=1):
    return (w, user, age, amount, duration, views, device, at)


def issues_of(df, **kwargs):
    found = validate.Validation(df, ["w"], **kwargs).issues().collect()
    return {(r["w"], r["feature"], r["issue_type"]): r for r in found}


def test_two_nulls_in_one_row(spark):
    df = spark.createDataFrame([row(age=None, amount=None)] + [row() for _ in range(9)], SCHEMA)
    checked = validate.Validation(df, ["w"])
    assert set(issues_of(df)) == {(1, "age", "null_value"), (1, "purchase_amount", "null_value")}
    result = checked.validity().first()
    assert (result["total"], result["issue_count"]) == (10, 2)
    assert result["validity_rate"] == pytest.approx(0.8)
    assert result["row_validity_rate"] == pytest.approx(0.9)


def test_bounds_are_inclusive(spark):
    df = spark.createDataFrame([row(age=0), row(age=120), row(age=121), row(age=-1)], SCHEMA)
    found = issues_of(df)
    assert found[(1, "age", "range_violation")]["count"] == 2
    assert found[(1, "age", "range_violation")]["rule"] == "[0, 120]"


def test_nan_is_no_range_violation(spark):
    df = spark.createDataFrame([row(amount=float("nan")), row(amount=-0.5)], SCHEMA)
    assert issues_of(df)[(1, "purchase_amount", "range_violation")]["count"] == 1


def test_empty_text_is_a_bad_category_and_null_is_not(spark):
    df = spark.createDataFrame([row(device=""), row(device=None), row()], SCHEMA)
    found = issues_of(df)
    assert found[(1, "device_type", "invalid_category")]["count"] == 1
    assert found[(1, "device_type", "null_value")]["count"] == 1


def test_missing_column(spark):
    df = spark.createDataFrame([row(), row()], SCHEMA).drop("age")
    found = issues_of(df)[(1, "age", "missing_column")]
    assert (found["count"], found["rate"]) == (2, 1.0)


def test_windows_are_separate_and_empty_input_has_no_rows(spark):
    df = spark.createDataFrame([row(w=1, age=None), row(w=2)], SCHEMA)
    assert {k[0] for k in issues_of(df)} == {1}
    assert validate.Validation(df.where("w > 5"), ["w"]).validity().count() == 0


def test_validity_does_not_fall_below_zero(spark):
    df = spark.createDataFrame([row(user=None, age=None, amount=None)], SCHEMA)
    assert validate.Validation(df, ["w"]).validity().first()["validity_rate"] == 0.0


def test_nullable_rule_and_rules_from_mapping(spark):
    df = spark.createDataFrame([row(age=None), row(age=50)], SCHEMA)
    assert not issues_of(df, rules=[Rule("age", nullable=True)])
    rules = rules_from_mapping({"age": {"nullable": True, "max": 40}, "device_type": {"allowed_values": ["desktop"]}})
    assert set(issues_of(df, rules=rules)) == {(1, "age", "range_violation"), (1, "device_type", "invalid_category")}


def test_null_rates(spark):
    df = spark.createDataFrame([row(age=None), row(), row(), row(age=None)], SCHEMA)
    rates = {r["feature"]: r["null_rate"] for r in validate.null_rates(df, ["w"], ["age", "user_id", "absent"]).collect()}
    assert rates == {"age": 0.5, "user_id": 0.0, "absent": 0.0}


def test_one_scan_serves_all_checks(spark):
    df = spark.createDataFrame([row()], SCHEMA)
    plan = validate.Validation(df, ["w"]).issues()._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") == 1 and plan.count("Aggregate") == 1


def test_settings_from_mapping():
    settings = settings_from_mapping(
        {
            "warmup": {"window_batches": 2, "calibration_batches": 1},
            "validation": {"features": {"age": {"min": 1}}},
            "drift": {"psi": {"n_bins": 5}, "ks": {"significance_level": 0.01}, "rff_mmd": {"n_components": 50}},
            "alerts": {"hysteresis": {"required_consecutive": 3}},
            "model_monitoring": {"performance_window_batches": 2},
        }
    )
    assert (settings.phases.warmup_windows, settings.phases.calibrate_windows) == (2, 1)
    assert settings.rules == (Rule("age", low=1),)
    assert (settings.drift.psi_bins, settings.drift.ks_significance, settings.mmd.components) == (5, 0.01, 50)
    assert settings.alerts.required_consecutive == 3 and settings.model.window_rows == 200


def test_summary_lines(spark):
    df = spark.createDataFrame([row(w=1, age=None), row(w=2)], SCHEMA)
    lines = {(r["w"], r["feature"]): r["line"] for r in validate.summary_lines(validate.Validation(df, ["w"])).collect()}
    assert lines[(2, "")] == "[batch 2] ✓ All 1 rows passed validation."
    assert lines[(1, "age")] == "  → [null_value] feature='age' count=1 rate=100.00%"
