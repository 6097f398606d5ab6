"""Exact percentiles by selection."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions import selection
from plumbline.functions.selection import percentiles_of
from plumbline.session import settle

SHARES = [0.0, 0.05, 0.25, 0.5, 0.75, 0.95, 1.0]


def big(spark, n=120_000):
    """Two large groups (continuous; few values), a small one, one of nulls and one without a name."""
    rows = spark.range(n).select(
        F.col("id"),
        F.when(F.col("id") % 3 == 0, "ties").when(F.col("id") % 1000 == 1, "small").when(F.col("id") % 1000 == 2, F.lit(None)).otherwise("wide").alias("g"),
        (F.xxhash64("id") / 2.0**63).alias("x"),
    )
    value = F.when(F.col("g") == "ties", F.floor(F.col("x") * 3).cast("double")).otherwise(F.exp(F.col("x") * 20) * F.signum("x"))
    odd = spark.sql("SELECT 'none' AS g, CAST(NULL AS DOUBLE) AS value UNION ALL SELECT 'wide', double('NaN') UNION ALL SELECT 'wide', NULL")
    return rows.select("g", value.alias("value")).unionByName(odd)


def expected(rows):
    groups = {}
    for g, v in rows.collect():
        if v is not None and not math.isnan(v):
            groups.setdefault(g, []).append(v)
    return {g: (len(v), np.quantile(v, SHARES).tolist()) for g, v in groups.items()}


def close(found, want):
    got = {r[0]: (r["n"], r["percentiles"]) for r in found.collect()}
    assert got.keys() == want.keys()
    for g, (n, values) in want.items():
        assert got[g][0] == n and got[g][1] == pytest.approx(values, rel=1e-12)


def test_groups_of_all_kinds_equal_numpy(spark):
    rows = settle(big(spark), "rows")
    close(percentiles_of(rows, ["g"], SHARES), expected(rows))
    whole = percentiles_of(rows, [], SHARES).select(F.lit("all"), "n", "percentiles")
    close(whole, expected(rows.withColumn("g", F.lit("all"))))


def test_missed_ranks_are_found_by_ordering(spark, monkeypatch):
    """Brackets that miss are an error of the sketch; the result stays exact."""
    rows = settle(big(spark, 30_000), "rows")

    def wrong(sketch, group, shares, accuracy):
        k = len(shares)
        found = sketch([0.5], accuracy)
        return found.select(*group, "n", F.array([F.lit(0.5)] * k).alias("lows"), F.array([F.lit(0.7)] * k).alias("highs"))

    monkeypatch.setattr(selection, "_brackets", wrong)
    close(percentiles_of(rows, ["g"], SHARES), expected(rows))
    close(percentiles_of(rows, [], SHARES).select(F.lit("all"), "n", "percentiles"), expected(rows.withColumn("g", F.lit("all"))))


def test_few_rows_are_moved(spark):
    """Of a large group, the second pass sends on far less than a twentieth of its values."""
    known = settle(spark.range(300_000).select(F.lit("a").alias("g"), F.rand(3).alias("_v")), "known")
    brackets = selection._brackets(selection.sketch_of(known, ["g"]), ["g"], [0.25, 0.5, 0.75], selection.ACCURACY)
    moved = selection.reduced_ranks(known, brackets, ["g"], 3)
    assert 0 < moved.count() < 3_000
    assert moved.agg(F.sum("c")).first()[0] == 300_000
    plan = moved._jdf.queryExecution().executedPlan().toString()
    assert plan.index("partial_count(1)") > plan.index("Exchange hashpartitioning(g")


def test_shares_must_ascend_and_empty_rows_give_nothing(spark):
    rows = spark.createDataFrame([], "g string, value double")
    assert percentiles_of(rows, ["g"], SHARES).count() == 0
    with pytest.raises(ValueError):
        percentiles_of(rows, ["g"], [0.5, 0.25])
