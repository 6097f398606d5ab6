"""Scalar expressions shared by the operators. All are plain Column algebra."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def clean(name: str | Column) -> Column:
    """The value as double, with NaN read as null."""
    value = (F.col(name) if isinstance(name, str) else name).cast("double")
    return F.when(~F.isnan(value), value)


def rate(part: Column, whole: Column) -> Column:
    """part / whole as double; null where whole is 0."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def linear_between(low: Column, high: Column, share: Column) -> Column:
    return low + (high - low) * share


def ks_pvalue(statistic: Column, n_reference: Column, n_current: Column) -> Column:
    """Two-sided Kolmogorov p-value, asymptotic with Stephens' correction."""
    root = F.sqrt(n_reference * n_current / (n_reference + n_current).cast("double"))
    lam = (root + F.lit(0.12) + F.lit(0.11) / root) * statistic
    tail = F.aggregate(
        F.sequence(F.lit(1), F.lit(100)),
        F.lit(0.0),
        lambda total, k: total
        + F.when(k % 2 == 1, F.lit(2.0)).otherwise(F.lit(-2.0)) * F.exp(F.lit(-2.0) * k * k * lam * lam),
    )
    return F.when(lam < 0.2, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), tail)))


def log_gamma(z: Column) -> Column:
    """ln Γ(z) for z > 0: Stirling's series at z + 8, shifted back."""
    w = z + F.lit(8.0)
    series = (
        (w - F.lit(0.5)) * F.log(w)
        - w
        + F.lit(0.5 * math.log(2.0 * math.pi))
        + F.lit(1.0 / 12.0) / w
        - F.lit(1.0 / 360.0) / (w * w * w)
        + F.lit(1.0 / 1260.0) / F.pow(w, 5)
        - F.lit(1.0 / 1680.0) / F.pow(w, 7)
    )
    shift = F.lit(0.0)
    for step in range(8):
        shift = shift + F.log(z + F.lit(float(step)))
    return series - shift


def chi2_pvalue(statistic: Column, degrees: Column) -> Column:
    """Upper tail of the chi-squared distribution.

    One minus the power series of the lower incomplete gamma function, taken to
    the number of terms this (statistic, degrees) pair needs. A tail that the
    Chernoff bound puts under 1e-14 is 0.
    """
    a = F.greatest(degrees, F.lit(1)).cast("double") / F.lit(2.0)
    y = statistic / F.lit(2.0)
    bound = F.exp(a - y + a * F.log(y / a))
    needed = F.greatest(F.lit(0.0), F.lit(2.0) * y - a)
    terms = F.when((y > a) & (bound < 1e-14), F.lit(1)).otherwise(F.ceil(needed).cast("int") + F.lit(80))
    state = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))
    series = F.aggregate(
        F.sequence(F.lit(1), terms),
        state,
        lambda s, k: F.struct(
            (s["term"] * y / (a + k)).alias("term"),
            (s["total"] + s["term"] * y / (a + k)).alias("total"),
        ),
        lambda s: s["total"],
    )
    lower = F.exp(a * F.log(y) - y - log_gamma(a + F.lit(1.0)) + F.log(series))
    return (
        F.when(degrees <= 0, F.lit(None).cast("double"))
        .when(statistic <= 0, F.lit(1.0))
        .when((y > a) & (bound < 1e-14), F.lit(0.0))
        .otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.lit(1.0) - lower)))
    )


# Severity names and the limits they start at.
SEVERITY_BY_RATE = ((0.30, "critical"), (0.15, "high"), (0.05, "medium"))
SEVERITY_BY_RATIO = ((3.0, "critical"), (2.0, "high"), (1.0, "medium"))


def _stepped(value: Column, steps, otherwise: str) -> Column:
    (first, name), *rest = steps
    column = F.when(value >= first, F.lit(name))
    for limit, label in rest:
        column = column.when(value >= limit, F.lit(label))
    return column.otherwise(F.lit(otherwise))


def severity_from_rate(value: Column) -> Column:
    return _stepped(value, SEVERITY_BY_RATE, "low")


def separation_ratio(score: Column, threshold: Column) -> Column:
    """score / threshold; null where there is no threshold or it is 0."""
    return F.try_divide(score, threshold)


def severity_from_mmd(score: Column, threshold: Column) -> Column:
    return _stepped(F.coalesce(separation_ratio(score, threshold), F.lit(1.0)), SEVERITY_BY_RATIO, "low")


def psi_level(psi: Column, warning: float, alert: float) -> Column:
    return F.when(psi > alert, F.lit("alert")).when(psi > warning, F.lit("warning")).otherwise(F.lit("ok"))


def mmd_band(score: Column, threshold: Column) -> Column:
    """Dashboard colour of a score; null while either side is missing."""
    return F.when(score.isNull() | threshold.isNull(), F.lit(None)).when(score > threshold, F.lit("crit")).otherwise(
        F.lit("ok")
    )


def validity_band(validity: Column) -> Column:
    return (
        F.when(validity.isNull(), F.lit(None))
        .when(validity > 0.95, F.lit("ok"))
        .when(validity > 0.8, F.lit("warn"))
        .otherwise(F.lit("crit"))
    )


def number_text(value: Column) -> Column:
    """A rounded floating-point number as text: ``0.000421``, ``12500000.0``, ``1.2e-05``.

    Numbers have at most six decimals. Below 1e-4 and from 1e16 on the exponent form with
    two digits is used.
    """
    size = F.abs(value)
    fixed = F.regexp_replace(value.cast("decimal(38,6)").cast("string"), r"(\.\d*?)0+$", "$1")
    fixed = F.regexp_replace(fixed, r"\.$", ".0")
    # Below 1e-4 there are one or two digits left of six decimals.
    digits = F.round(size * 1000000).cast("long").cast("string")
    sign = F.when(value < 0, F.lit("-")).otherwise(F.lit(""))
    first, second = F.substring(digits, 1, 1), F.substring(digits, 2, 1)
    small = F.when(F.length(digits) == 1, F.concat(sign, digits, F.lit("e-06"))).otherwise(
        F.concat(sign, first, F.when(second == "0", F.lit("")).otherwise(F.concat(F.lit("."), second)), F.lit("e-05"))
    )
    large = F.regexp_replace(F.regexp_replace(value.cast("string"), r"\.0E", "E"), "E", "e+")
    return (
        F.when(F.isnan(value), F.lit("nan"))
        .when(size == float("inf"), F.concat(sign, F.lit("inf")))
        .when(size >= 1e16, large)
        .when((size > 0) & (F.round(size * 1000000) < 100), small)
        .otherwise(fixed)
    )
