import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions import ranking
from plumbline.operators import registry, stats


def frame(spark, values, categories=None):
    categories = categories or ["a"] * len(values)
    rows = [(i, None if v is None else float(v), c) for i, (v, c) in enumerate(zip(values, categories, strict=True))]
    return spark.createDataFrame(rows, "id long, x double, c string")


def test_numeric_stats_match_numpy(spark):
    rng = np.random.default_rng(1)
    values = rng.normal(5, 2, 500).tolist() + [None] * 20 + [float("nan")] * 5
    r = stats.numeric_stats(frame(spark, values), [], ["x"]).first()
    known = np.array([v for v in values if v is not None and v == v])
    assert (r["count"], r["null_count"], r["total"]) == (500, 25, 525)
    assert r["mean"] == pytest.approx(known.mean()) and r["std"] == pytest.approx(known.std())


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_percentiles_match_numpy_in_skewed_groups(spark, seed):
    """One group holds most rows, with heavy tails and many ties."""
    rng = np.random.default_rng(seed)
    groups = {"big": np.r_[rng.lognormal(0, 3, 3000), np.repeat(7.0, 2000)], "small": rng.integers(0, 3, 7).astype(float)}
    rows = [(g, "x", float(v)) for g, vs in groups.items() for v in vs]
    counted = ranking.value_counts(spark.createDataFrame(rows, "g string, feature string, value double"), ["g", "feature"])
    shares = [0.0, 0.1, 0.5, 0.77, 0.99, 1.0]
    got = ranking.percentiles(counted, ["feature"], ["feature", "g"], shares).collect()
    assert len(got) == 2
    for r in got:
        assert r["n"] == len(groups[r["g"]])
        np.testing.assert_allclose(r["percentiles"], np.quantile(groups[r["g"]], shares), rtol=1e-12)


@pytest.mark.parametrize("cuts", [1, 3, 16, 17, 256])
def test_running_sums_do_not_depend_on_the_cuts(spark, cuts):
    rng = np.random.default_rng(cuts)
    values = rng.integers(0, 400, 1500)
    rows = [("f", int(v % 3), float(v), 1) for v in values]
    df = spark.createDataFrame(rows, "feature string, g int, value double, one long")
    df = df.groupBy("feature", "g", "value").agg(F.sum("one").alias("n"))
    got = ranking.running_sums(df, ["feature"], "value", {"n": ["feature", "g"]}, ["g"], cuts=cuts).collect()
    for r in got:
        mine = values[values % 3 == r["g"]]
        assert r["n_cum"] == (mine <= r["value"]).sum()
        assert r["n_total"] == len(mine) and r["n_equal"] == (mine == r["value"]).sum()


def test_range_cuts_split_a_large_group(spark):
    df = spark.range(20000).select(F.lit("f").alias("feature"), F.col("id").cast("double").alias("value"), F.lit(1).alias("n"))
    cuts = ranking.range_cuts(df, ["feature"], "value", ["n"], [], 64).first()["_cuts"]["every"]
    assert len(cuts) == 64 and cuts == sorted(cuts)
    assert np.diff([0.0, *cuts, 20000.0]).max() < 20000 / 5


def test_value_sample_is_repeatable(spark):
    df = frame(spark, [None, *range(1000)])
    first = stats.value_sample(df, [], ["x"], ["id"]).select("value").collect()
    again = stats.value_sample(df.repartition(7), [], ["x"], ["id"]).select("value").collect()
    assert sorted(first) == sorted(again) and len(first) == 200


def test_category_statistics(spark):
    df = frame(spark, [1.0] * 5, ["a", "a", "b", None, "c"])
    counts = stats.category_counts(df, [], ["c"])
    r = stats.categorical_stats(counts, []).first()
    assert (r["null_count"], r["null_rate"], r["cardinality"]) == (1, 0.2, 3)
    shares = {r["category"]: r["frequency"] for r in stats.category_frequencies(counts, []).collect()}
    assert shares == {"a": 0.4, "b": 0.2, "c": 0.2}
    known = {r["category"]: r["frequency"] for r in stats.category_frequencies(counts, [], of_all_rows=False).collect()}
    assert known["a"] == 0.5
    assert stats.approx_cardinality(df, [], ["c"]).first()["cardinality"] == 3


def test_approximate_percentiles_keep_their_rank_error(spark):
    df = frame(spark, list(range(10000)))
    got = stats.numeric_percentiles(df, [], ["x"], accuracy=1000).first()["percentiles"]
    for share, value in zip(stats.SNAPSHOT_SHARES, got, strict=True):
        assert abs(value / 10000 - share) <= 0.002


def test_histogram_keeps_empty_bins_and_the_maximum(spark):
    got = stats.histogram(frame(spark, [0.0, 0.1, 10.0]), ["x"], 4).orderBy("bin").collect()
    assert [r["n"] for r in got] == [2, 0, 0, 1]
    constant = stats.histogram(frame(spark, [3.0, 3.0]), ["x"], 3).collect()
    assert sum(r["n"] for r in constant) == 2


def test_registry_round_trip(spark, tmp_path):
    kept = registry.BaselineRegistry(spark, str(tmp_path / "reg"), ["x"], ["c"])
    base = frame(spark, range(100), ["a", "b"] * 50)
    assert kept.names().count() == 0
    with pytest.raises(ValueError, match="Baseline 'v1' not found"):
        kept.stats("v1")
    assert kept.register("v1", base, ["id"])
    assert not kept.register("v1", frame(spark, [1.0]), ["id"])
    r = kept.stats("v1").first()
    assert r["count"] == 100 and len(r["sample"]) == 100 and r["percentiles"][2] == 49.5
    assert kept.register("v1", frame(spark, [1.0, 2.0]), ["id"], overwrite=True)
    assert kept.stats("v1").first()["count"] == 2
    assert kept.summary().first()["row_count"] == 2
    assert kept.delete("v1") and not kept.delete("v1")
    assert kept.names().count() == 0
    assert kept.register("v1", base, ["id"]) and kept.names().count() == 1


def test_compare_to_baseline(spark, tmp_path):
    kept = registry.BaselineRegistry(spark, str(tmp_path / "reg"), ["x"], ["c"])
    kept.register("v1", frame(spark, [1.0, 2.0, 3.0, 4.0], ["a", "b", "a", "b"]), ["id"])
    numeric, categorical = kept.compare("v1", frame(spark, [101.0, 102.0, None, None], ["a", "z", "a", None]))
    n, c = numeric.first(), categorical.first()
    assert n["mean_shift"] == pytest.approx(99.0) and n["null_delta"] == 0.5 and n["drift_signal"]
    assert (c["new_categories"], c["missing_categories"], c["drift_signal"]) == (1, 1, True)


def test_constant_baseline_has_ratio_one(spark):
    base = stats.numeric_stats(frame(spark, [5.0, 5.0]), [], ["x"])
    now = stats.numeric_stats(frame(spark, [5.0, 6.0]), [], ["x"])
    r = registry.compare_numeric(base, now).first()
    assert r["std_ratio"] == 1.0 and not r["drift_signal"]


def test_maps_stay_bounded_with_any_number_of_categories(spark):
    n = 300_000
    rows = spark.range(n).selectExpr(
        "CAST(id % 2 AS INT) AS w", "CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 30 = 1 THEN NULL ELSE CAST(id AS STRING) END AS c"
    )
    counts = stats.category_counts(rows, ["w"], ["c"])
    maps = stats.frequency_maps(counts, ["w"], most=10, of_all_rows=False)
    got = {r["w"]: r for r in maps.collect()}
    for w in (0, 1):
        ids = [i for i in range(w, n, 2) if i % 3 == 0 or i % 30 != 1]
        single = sorted(str(i) for i in ids if i % 3)
        assert got[w]["frequencies"] == pytest.approx(
            {"hot": (len(ids) - len(single)) / len(ids)} | dict.fromkeys(single[:9], 1 / len(ids))
        )
        assert got[w]["other_categories"] == len(single) - 9
        assert got[w]["other_frequency"] == pytest.approx((len(single) - 9) / len(ids))
    plan = maps._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("WindowGroupLimit") == 2
    few = stats.frequency_maps(counts.where("category IS NULL OR category = 'hot'"), ["w"]).where("w = 1").first()
    assert few["frequencies"] == pytest.approx({"hot": 5 / 6}) and (few["other_categories"], few["other_frequency"]) == (0, 0.0)
    none = stats.frequency_maps(counts.where("category IS NULL"), [], of_all_rows=False).first()
    assert (none["frequencies"], none["other_categories"], none["other_frequency"]) == ({}, 0, 0.0)
    assert stats.frequency_maps(counts.limit(0), ["w"]).count() == 0
