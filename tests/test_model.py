import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators import model
from plumbline.settings import ModelSettings


def brute_auc(pos, neg):
    wins = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg)
    return wins / (len(pos) * len(neg))


def scored(spark, rows):
    return spark.createDataFrame(rows, "w int, predicted_score double, true_label int")


def test_auc_matches_all_pairs(spark):
    rng = np.random.default_rng(2)
    rows = [(int(w), float(np.round(rng.random(), 1)), int(rng.random() < 0.4)) for w in [1] * 400 + [2] * 30]
    got = {r["w"]: r["auc"] for r in model.auc(scored(spark, rows), "w").collect()}
    for w in (1, 2):
        pos = [s for v, s, t in rows if v == w and t]
        neg = [s for v, s, t in rows if v == w and not t]
        assert got[w] == pytest.approx(brute_auc(pos, neg))
    flipped = [(w, -s, t) for w, s, t in rows]
    for r in model.auc(scored(spark, flipped), "w").collect():
        assert r["auc"] == pytest.approx(1 - got[r["w"]])


def test_auc_of_ties_and_of_few_rows(spark):
    tied = [(1, 0.5, 1)] * 5 + [(1, 0.5, 0)] * 5
    assert model.auc(scored(spark, tied), "w").first()["auc"] == 0.5
    assert model.auc(scored(spark, tied[1:]), "w").first()["auc"] is None


def test_latest_label_wins_and_every_prediction_matches(spark):
    predictions = spark.createDataFrame([("a", 1), ("a", 0), ("b", 1)], "event_id string, predicted_label int")
    labels = spark.createDataFrame([("a", 0, 1), ("a", 1, 5), ("c", 1, 1)], "event_id string, true_label int, label_ts long")
    got = model.match_labels(predictions, labels).collect()
    assert sorted((r["event_id"], r["predicted_label"], r["true_label"]) for r in got) == [("a", 0, 1), ("a", 1, 1)]


@pytest.mark.parametrize(("positives", "drifted"), [(63, True), (62, False)])
def test_label_rate_z(spark, positives, drifted):
    rows = spark.createDataFrame([(1, int(i < positives)) for i in range(100)], "w int, predicted_label int")
    r = model.label_drift(rows, F.lit(0.5), "w").first()
    assert r["z_score"] == pytest.approx((positives / 100 - 0.5) / math.sqrt(0.25 / 100)) and r["drifted"] is drifted
    assert model.label_drift(rows, F.lit(0.0), "w").first()["skipped"]
    assert model.label_drift(rows.limit(9), F.lit(0.5), "w").first()["skipped"]


@pytest.mark.parametrize("size", [3, 10, 1000])
def test_last_pairs_match_a_plain_window(spark, size):
    rng = np.random.default_rng(size)
    sizes = [5, 0, 1, 40, 2, 2, 0, 12]
    rows, at = [], 0
    for w, n in enumerate(sizes):
        for _ in range(n):
            rows.append((w, at // 2, at, int(rng.random() < 0.5)))
            at += 1
    pairs = spark.createDataFrame(rows, "w int, ts int, event_id int, predicted_label int")
    windows = spark.createDataFrame([(w,) for w in range(len(sizes))], "w int")
    got = {}
    for r in model.last_pairs(pairs, windows, "w", ["ts", "event_id"], size).collect():
        got.setdefault(r["w"], []).append(r["event_id"])
    for w in range(len(sizes)):
        upto = [e for v, _, e, _ in rows if v <= w]
        assert sorted(got.get(w, [])) == upto[-size:]


@pytest.mark.parametrize("size", [4, 25, 1000])
def test_rolling_accuracy_and_auc_match_the_last_pairs(spark, size):
    rng = np.random.default_rng(size)
    sizes = [0, 5, 0, 1, 40, 2, 2, 0, 12, 1, 1, 90, 3, 0]
    rows = []
    for w, n in enumerate(sizes):
        for _ in range(n):
            at = len(rows)
            label = None if rng.random() < 0.1 else int(rng.random() < 0.5)
            score = [None, float("nan"), -0.0, 0.0][at % 4] if rng.random() < 0.1 else float(np.round(rng.random(), 1))
            rows.append((w, at // 2, at, score, label, int(rng.random() < 0.5)))
    rows.append((None, 0, -1, 0.5, 1, 1))
    pairs = spark.createDataFrame(
        rows, "w int, ts int, event_id int, predicted_score double, predicted_label int, true_label int"
    )
    windows = spark.createDataFrame([(w, w + 1, "warmup") for w in range(len(sizes))], "w int, position int, phase string")
    setting = ModelSettings(window_batches=1, rows_per_batch=size, min_class_rows=2)
    ends, tails = model.ends_and_tails(pairs, windows, "w", ["ts", "event_id"], setting)
    got = {r["w"]: r for r in model.recent_performance(ends, tails(ends), windows, "w", setting).collect()}
    assert sorted(got) == list(range(len(sizes)))
    for w in range(len(sizes)):
        last = [r for r in rows if r[0] is not None and r[0] <= w][-size:]
        hits = [int(p == t) for *_, p, t in last if p is not None]
        assert got[w]["window_size"] == len(last)
        assert got[w]["accuracy"] == (pytest.approx(sum(hits) / len(hits)) if hits else None)
        order = [(float("inf") if s != s else s, t) for _, _, _, s, _, t in last if s is not None]
        pos, neg = [s for s, t in order if t], [s for s, t in order if not t]
        few = min(len(pos), len(neg)) < 2
        assert got[w]["estimated_auc"] == (None if few else pytest.approx(brute_auc(pos, neg)))


def test_a_pair_is_moved_twice_however_many_windows_it_counts_in(spark):
    n, size = 400, 100
    pairs = spark.range(n).selectExpr(
        "CAST(id AS INT) AS w", "id AS ts", "id AS event_id", "rand(1) AS predicted_score", "1 AS predicted_label", "CAST(id % 2 AS INT) AS true_label"
    )
    setting = ModelSettings(window_batches=1, rows_per_batch=size)
    windows = pairs.select("w")
    ends, tails = model.ends_and_tails(pairs, windows, "w", ["ts", "event_id"], setting)
    assert tails(ends).count() == n and model.last_pairs(pairs, windows, "w", ["ts", "event_id"], size).count() > 30 * n
    found = model.rolling_accuracy(ends, tails(ends), "w", size).collect()
    expected = {w: [i % 2 for i in range(n)][: w + 1][-size:] for w in range(n)}
    assert {r["w"]: (r["window_size"], r["accuracy"]) for r in found} == {
        w: (len(last), sum(last) / len(last)) for w, last in expected.items()
    }


def test_no_pairs_and_no_windows(spark):
    pairs = spark.createDataFrame([], "w int, ts int, event_id int, predicted_score double, predicted_label int, true_label int")
    windows = spark.createDataFrame([(1, 1, "warmup")], "w int, position int, phase string")
    for some in (windows, windows.limit(0)):
        ends, tails = model.ends_and_tails(pairs, some, "w", ["ts", "event_id"])
        got = model.recent_performance(ends, tails(ends), some, "w").collect()
        assert [(r["window_size"], r["accuracy"], r["estimated_auc"]) for r in got] == [(0, None, None)] * some.count()


def test_report_shows_degradation(spark):
    rows = []
    for w in range(6):
        for i in range(60):
            truth = i % 2
            score = 0.9 if truth else 0.1
            if w >= 4:
                score = 0.95
            rows.append((f"{w}-{i}", w, w * 100 + i, score, int(score > 0.5), truth))
    df = spark.createDataFrame(rows, "event_id string, w int, ts int, predicted_score double, predicted_label int, true_label int")
    labels = df.select("event_id", "true_label", F.col("ts").alias("label_ts"))
    setting = ModelSettings(window_batches=1, rows_per_batch=60)
    report = {r["w"]: r for r in model.model_report(df.drop("true_label"), labels, "w", ["ts", "event_id"], setting).collect()}
    assert report[2]["phase"] == "warmup" and report[2]["accuracy"] is None
    assert (report[3]["accuracy"], report[3]["estimated_auc"], report[3]["is_degraded"]) == (1.0, 1.0, False)
    assert report[3]["prediction_drift"] is False and report[3]["label_drift"] is False
    assert (report[4]["accuracy"], report[4]["is_degraded"]) == (0.5, True)
    assert report[4]["prediction_drift"] and report[4]["label_drift"] and report[5]["estimated_auc"] == 0.5
