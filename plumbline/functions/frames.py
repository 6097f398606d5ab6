"""Reshaping helpers."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.scalars import clean


def long_numeric(df: DataFrame, keep: Sequence[str], features: Sequence[str]) -> DataFrame:
    """(keep..., feature, value): one row per numeric value, NaN read as null."""
    return _stack_features(df, keep, features, "value", "double", clean)


def long_categorical(df: DataFrame, keep: Sequence[str], features: Sequence[str]) -> DataFrame:
    """(keep..., feature, category), nulls included."""
    return _stack_features(df, keep, features, "category", "string", lambda name: F.col(name).cast("string"))


def _stack_features(
    df: DataFrame, keep: Sequence[str], features: Sequence[str], name: str, kind: str, read: Callable[[str], Column]
) -> DataFrame:
    present = [feature for feature in features if feature in df.columns]
    if not present:
        nothing = [F.lit(None).cast("string").alias("feature"), F.lit(None).cast(kind).alias(name)]
        return df.select(*keep, *nothing).where(F.lit(False))
    return stack_structs(df, keep, [F.struct(F.lit(f).alias("feature"), read(f).alias(name)) for f in present])


def stack_structs(df: DataFrame, keep: Sequence[str | Column], structs: Sequence[Column]) -> DataFrame:
    """One output row per struct.

    Unlike ``unpivot`` this form is recognised when two branches of a plan need
    the same rows, so their common shuffle is done once.
    """
    return df.select(*keep, F.inline(F.array(*structs)))


def complete_rows(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Rows in which every listed feature has a value (NaN counts as missing)."""
    return df.dropna("any", subset=list(features))


def is_complete(features: Sequence[str]) -> Column:
    present = F.lit(True)
    for name in features:
        present = present & clean(name).isNotNull()
    return present
