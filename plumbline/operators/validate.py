"""Rule validation and null rates: every check of every rule in one aggregation.

All functions group by the given window columns (an event-time window, a date, a
batch id ...) and work on batch and streaming frames alike.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.functions.frames import stack_structs
from plumbline.functions.scalars import rate
from plumbline.settings import DEFAULT_RULES, Rule

# Issue names.
MISSING_COLUMN = "missing_column"
NULL_VALUE = "null_value"
RANGE_VIOLATION = "range_violation"
INVALID_CATEGORY = "invalid_category"


@dataclass(frozen=True)
class Check:
    """One countable condition; rows for which it is true are violations."""

    feature: str
    issue_type: str
    violated: Column
    bounds: str | None = None
    allowed: tuple[str, ...] = ()


def out_of_range(name: str, low: float | None, high: float | None, is_float: bool = True) -> Column:
    """True below ``low`` or above ``high``; both bounds are allowed values, and
    NaN is not a range violation."""
    value = F.col(name)
    sides = []
    if low is not None:
        sides.append(value < F.lit(low))
    if high is not None:
        sides.append(value > F.lit(high))
    outside = reduce(lambda a, b: a | b, sides) if sides else F.lit(False)
    return outside & ~F.isnan(value) if is_float else outside


def not_allowed(name: str, allowed: Sequence[str]) -> Column:
    return ~F.col(name).isin(list(allowed))


def checks_for(df: DataFrame, rules: Sequence[Rule] = DEFAULT_RULES) -> list[Check]:
    """The checks these rules ask for, given the columns the frame has."""
    types = {f.name: f.dataType for f in df.schema.fields}
    checks: list[Check] = []
    for rule in rules:
        if rule.feature not in types:
            checks.append(Check(rule.feature, MISSING_COLUMN, F.lit(True)))
            continue
        if not rule.nullable:
            checks.append(Check(rule.feature, NULL_VALUE, F.col(rule.feature).isNull()))
        if rule.low is not None or rule.high is not None:
            is_float = isinstance(types[rule.feature], (T.DoubleType, T.FloatType))
            checks.append(
                Check(
                    rule.feature,
                    RANGE_VIOLATION,
                    out_of_range(rule.feature, rule.low, rule.high, is_float),
                    bounds=f"[{rule.low}, {rule.high}]",
                )
            )
        if rule.allowed:
            checks.append(
                Check(rule.feature, INVALID_CATEGORY, not_allowed(rule.feature, rule.allowed), allowed=rule.allowed)
            )
    return checks


def counters(checks: Sequence[Check]) -> list[Column]:
    """The aggregates a validation needs: rows, rows with any violation, and the
    violations of every check."""
    any_violation = reduce(lambda a, b: a | b, [F.coalesce(c.violated, F.lit(False)) for c in checks], F.lit(False))
    return [
        F.count(F.lit(1)).alias("total"),
        F.count_if(any_violation).alias("bad_rows"),
        *[F.count_if(c.violated).alias(f"check_{i}") for i, c in enumerate(checks)],
    ]


class Validation:
    """Counts of all checks per window; the reports below are views of them."""

    def __init__(
        self,
        df: DataFrame,
        window: Sequence[str],
        rules: Sequence[Rule] = DEFAULT_RULES,
        counts: DataFrame | None = None,
    ):
        """``counts`` may hold the result of ``counters`` from an earlier pass."""
        self.window = list(window)
        self.checks = checks_for(df, rules)
        self.counts = df.groupBy(*self.window).agg(*counters(self.checks)) if counts is None else counts

    def issues(self) -> DataFrame:
        """(window, feature, issue_type, count, total, rate, rule, allowed): one row
        per check that found something."""
        no_list = F.lit(None).cast("array<string>")

        def finding(check: Check, count: Column) -> Column:
            return F.struct(
                F.lit(check.feature).alias("feature"),
                F.lit(check.issue_type).alias("issue_type"),
                count.alias("count"),
                F.lit(check.bounds).cast("string").alias("rule"),
                (F.array(*[F.lit(v) for v in check.allowed]) if check.allowed else no_list).alias("allowed"),
            )

        findings = [finding(c, F.col(f"check_{i}")) for i, c in enumerate(self.checks)]
        if not findings:
            findings = [finding(Check("", "", F.lit(False)), F.lit(0).cast("long"))]
        found = stack_structs(self.counts, [*self.window, "total"], findings)
        return found.where(F.col("count") > 0).withColumn("rate", rate(F.col("count"), F.col("total")))

    def validity(self) -> DataFrame:
        """(window, total, issue_count, validity_rate, row_validity_rate).

        ``validity_rate`` takes the sum of all issue counts from the rows, not
        below 0; ``row_validity_rate`` counts a row once.
        """
        found = reduce(lambda a, b: a + b, [F.col(f"check_{i}") for i in range(len(self.checks))], F.lit(0))
        kinds = reduce(
            lambda a, b: a + b,
            [(F.col(f"check_{i}") > 0).cast("long") for i in range(len(self.checks))],
            F.lit(0).cast("long"),
        )
        return self.counts.select(
            *self.window,
            "total",
            kinds.alias("issue_count"),
            rate(F.greatest(F.lit(0), F.col("total") - found), F.col("total")).alias("validity_rate"),
            rate(F.col("total") - F.col("bad_rows"), F.col("total")).alias("row_validity_rate"),
        )


def null_rates_wide(df: DataFrame, window: Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """(window, total, <column>...): the share of nulls of every column."""
    columns = [c for c in df.columns if c not in window] if columns is None else list(columns)
    shares = [
        rate(F.count_if(F.col(c).isNull()), F.count(F.lit(1))).alias(c) if c in df.columns else F.lit(0.0).alias(c)
        for c in columns
    ]
    return df.groupBy(*window).agg(F.count(F.lit(1)).alias("total"), *shares)


def null_rates(df: DataFrame, window: Sequence[str], columns: Sequence[str] | None = None) -> DataFrame:
    """(window, feature, null_rate); a listed column the frame lacks has rate 0."""
    columns = [c for c in df.columns if c not in window] if columns is None else list(columns)
    return stack_structs(
        null_rates_wide(df, window, columns),
        list(window),
        [F.struct(F.lit(c).alias("feature"), F.col(c).alias("null_rate")) for c in columns],
    )


def summary_lines(validation: Validation) -> DataFrame:
    """(window, line_no, line): the validation result as text.

    The text layout is a fixed value.
    """
    window = validation.window
    label = F.concat_ws(" ", *[F.col(w).cast("string") for w in window])
    head = validation.validity().select(
        *window,
        F.lit("").alias("feature"),
        F.lit("").alias("issue_type"),
        F.when(
            F.col("issue_count") == 0,
            F.format_string("[batch %s] ✓ All %d rows passed validation.", label, F.col("total")),
        )
        .otherwise(
            F.format_string(
                "[batch %s] ⚠ %d issue type(s) found in %d rows (validity rate: %.1f%%)",
                label,
                F.col("issue_count"),
                F.col("total"),
                F.col("validity_rate") * 100,
            )
        )
        .alias("line"),
    )
    body = validation.issues().select(
        *window,
        "feature",
        "issue_type",
        F.format_string(
            "  → [%s] feature='%s' count=%d rate=%.2f%%",
            F.col("issue_type"),
            F.col("feature"),
            F.col("count"),
            F.col("rate") * 100,
        ).alias("line"),
    )
    return head.unionByName(body)
