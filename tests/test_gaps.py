"""The largest gap of step functions by branch and bound."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions import gaps
from plumbline.functions.gaps import largest_gaps
from plumbline.functions.ranking import range_cuts
from plumbline.session import settle


def brute(reference, current):
    at = np.concatenate((reference, current))
    r, c = np.sort(reference), np.sort(current)
    both = [np.abs(np.searchsorted(r, at, side) / len(r) - np.searchsorted(c, at, side) / len(c)) for side in ("left", "right")]
    return max(map(np.max, both))


def cases():
    draw = np.random.default_rng(6)
    reference = {"wide": draw.normal(size=3000), "few": draw.integers(0, 5, 900).astype(float), "one": np.array([2.0])}
    windows = {
        1: {"wide": draw.normal(size=400), "few": draw.integers(0, 5, 200).astype(float), "one": np.array([1.0, 2.0])},
        2: {"wide": draw.normal(0.4, 2, 700), "few": draw.integers(2, 9, 50).astype(float), "one": np.array([2.0])},
        3: {"wide": np.array([np.inf, -np.inf, 0.0]), "few": np.array([-1.0]), "one": np.array([np.inf])},
    }
    return reference, windows


def frames(spark):
    reference, windows = cases()
    r = spark.createDataFrame([(f, float(v)) for f, vs in reference.items() for v in vs], "feature string, value double")
    c = spark.createDataFrame(
        [(w, f, float(v)) for w, features in windows.items() for f, vs in features.items() for v in vs],
        "w int, feature string, value double",
    )
    return r.withColumn("n", F.lit(1).cast("long")), c.withColumn("n", F.lit(1).cast("long"))


@pytest.mark.parametrize("at_once", [gaps.AT_ONCE, 5])
@pytest.mark.parametrize("stored", [False, True])
def test_equal_to_all_values(spark, at_once, stored):
    """Also with parts cut again and again, and with stored cuts."""
    reference, windows = cases()
    r, c = frames(spark)
    cuts = range_cuts(r, ["feature"], "value", ["n"], []) if stored else None
    found = {(x.w, x.feature): x for x in largest_gaps(r, c, "w", cuts, at_once).collect()}
    assert len(found) == 9
    for (w, f), row in found.items():
        assert row.gap == pytest.approx(brute(reference[f], windows[w][f]), abs=1e-15)
        assert (row.n_reference, row.n_current) == (len(reference[f]), len(windows[w][f]))


def test_counted_rows_and_a_feature_without_reference(spark):
    r = spark.createDataFrame([("a", 1.0, 3), ("a", 2.0, 1)], "feature string, value double, n long")
    c = spark.createDataFrame([(1, "a", 2.0, 5), (1, "b", 1.0, 2)], "w int, feature string, value double, n long")
    found = {x.feature: (x.n_reference, x.n_current, x.gap) for x in largest_gaps(r, c, "w").collect()}
    assert found == {"a": (4, 5, 0.75), "b": (0, 2, None)}
    assert largest_gaps(r, c.limit(0), "w").count() == 0


def test_most_ranges_are_never_ordered(spark, monkeypatch):
    r = settle(spark.range(60_000).select(F.lit("a").alias("feature"), F.randn(1).alias("value"), F.lit(1).cast("long").alias("n")), "r")
    c = settle(spark.range(20_000).select((F.col("id") % 2).alias("w"), F.lit("a").alias("feature"), (F.randn(2) + 0.5).alias("value"), F.lit(1).cast("long").alias("n")), "c")
    moved = {}
    original = gaps._ordered

    def counted(reference, current, ranges, window):
        moved.update(r=reference.count(), c=current.count(), ranges=ranges.count())
        return original(reference, current, ranges, window)

    monkeypatch.setattr(gaps, "_ordered", counted)
    found = {x.w: x.gap for x in largest_gaps(r, c, "w", at_once=20_000).collect()}
    for w in (0, 1):
        own = [x.value for x in c.where(F.col("w") == w).collect()]
        assert found[w] == pytest.approx(brute(np.array([x.value for x in r.collect()]), np.array(own)), abs=1e-15)
    assert moved["ranges"] < 200 and moved["r"] < 25_000 and moved["c"] < 8_000
