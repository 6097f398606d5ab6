"""Cases that earlier versions got wrong."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from plumbline.functions.scalars import number_text
from plumbline.functions.selection import medians
from plumbline.operators import alerts, mmd, registry
from plumbline.settings import AlertSettings, MmdSettings


def test_number_text(spark):
    cases = {
        0.000421: "0.000421", 1.2e-05: "1.2e-05", 1e-05: "1e-05", 3e-06: "3e-06", -2e-06: "-2e-06", 12500000.0: "12500000.0",
        0.0: "0.0", 0.25: "0.25", -1.5: "-1.5", 100.0: "100.0", 0.0001: "0.0001", 1e16: "1e+16", 123456.789012: "123456.789012",
    }
    rows = spark.createDataFrame([(k,) for k in cases], "v double").select("v", number_text(F.col("v")).alias("t"))
    assert {r.v: r.t for r in rows.collect()} == cases
    assert spark.sql("SELECT CAST(NULL AS DOUBLE) AS v").select(number_text(F.col("v"))).first()[0] is None


def test_medians(spark):
    rng = random.Random(1)
    cases = {n: [rng.choice([rng.random(), rng.random() * 1e6, 7.0]) for _ in range(n)] for n in (1, 2, 9, 50, 51)}
    rows = spark.createDataFrame([(n, v) for n, values in cases.items() for v in [*values, None]], "g int, v double")
    found = {r.g: r.median for r in medians(rows, ["g"], "v").collect()}
    assert found == {n: pytest.approx(statistics.median(values)) for n, values in cases.items()}
    assert medians(rows.limit(0), ["g"], "v").count() == 0 and medians(rows.limit(0), [], "v").count() == 0
    assert medians(rows, [], "v").first()["n"] == sum(cases)


def test_a_median_among_infinite_values_ends(spark):
    """One infinite value made the earlier search narrow nothing."""
    many = spark.range(150_000).select((F.col("id") * 1.0).alias("v"))
    rows = many.unionByName(spark.sql("SELECT double('Infinity') AS v"))
    assert medians(rows, [], "v").first()["median"] == 75_000
    only = spark.sql("SELECT double('Infinity') AS v FROM range(4) UNION ALL SELECT double('-Infinity')")
    assert medians(only, [], "v").first()["median"] == float("inf")
    pairs = rows.select(F.col("v").alias("squared"))
    assert mmd.pair_bandwidths(pairs).first()["sigma"] == pytest.approx((75_000.5 / 2) ** 0.5)


def test_bandwidth_sees_every_row(spark):
    rows = spark.range(2000).select("id", (F.col("id") * 1.0).alias("a"), F.lit(0.0).alias("b"))
    assert mmd.neighbour_pairs(rows, ["a", "b"], ["id"]).count() == 1000
    whole = mmd.bandwidth(rows, ["a", "b"], ["id"], MmdSettings()).first()["sigma"]
    sample = mmd.bandwidth(rows, ["a", "b"], ["id"], MmdSettings(sample_size=50)).first()["sigma"]
    # The median distance of two uniform values is (1 - sqrt(1/2)) of the range.
    assert whole == pytest.approx(2000 * (1 - 0.5**0.5) / 2**0.5, rel=0.1) and sample != whole


def test_long_history_of_one_key(spark):
    windows = spark.range(100_000).select(F.col("id").alias("w"))
    found = windows.select("w", F.lit("k").alias("alert_key"))
    folded = alerts.hysteresis(found, windows, "w", F.timestamp_seconds(F.col("w") * 30), AlertSettings())
    assert folded.where("fired").count() == pytest.approx(100_000 / 4, rel=0.01)


def test_columns_that_the_frame_lacks(spark, tmp_path):
    kept = registry.BaselineRegistry(spark, str(tmp_path / "r"), ["x"], ["c", "d"])
    rows = spark.createDataFrame([(1, 1.0, "a", "p"), (2, 2.0, "b", "q")], "id long, x double, c string, d string")
    for name in ("../out/of it", "a=b/c"):
        assert kept.register(name, rows, ["id"]) and not kept.register(name, rows, ["id"])
        numeric, categorical = kept.compare(name, rows.drop("d", "x"))
        assert [(r.feature, r.drift_signal) for r in categorical.collect()] == [("c", False)] and numeric.count() == 0
    assert {p.name for p in tmp_path.iterdir()} == {"r"}


def test_lost_state_stops_the_monitor(spark, tmp_path):
    from plumbline.settings import Settings
    from plumbline.streaming.monitor import StreamMonitor

    settings = Settings()
    rows = spark.range(40).select(
        "id", *[(F.col("id") % 7 + i).cast("double").alias(c) for i, c in enumerate(settings.numeric)],
        *[F.lit("mobile").alias(c) for c in settings.categorical], F.lit("u").alias("user_id"), F.lit(1).cast("long").alias("timestamp"),
    )
    monitor = StreamMonitor(spark, str(tmp_path / "m"), ["id"], settings)
    monitor.process(rows, 5)
    monitor.process(rows, 6)
    with pytest.raises(RuntimeError, match="state before batch 9 is gone"):  # nothing was left by batch 8
        monitor.process(rows, 9)
