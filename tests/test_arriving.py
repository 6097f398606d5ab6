"""A table as a stream of arrivals: each is one micro-batch of several files."""

import pytest
from pyspark.sql import functions as F

from checks.sourcing import _arriving


@pytest.mark.parametrize("days", [28, 7])
def test_an_arrival_is_one_batch_of_several_files(spark, tmp_path, days):
    n = 2800
    rows = spark.range(0, n, 1, 3).select(
        F.col("id").alias("event_id"), F.expr(f"timestamp'2024-01-01' + make_dt_interval(id % {days})").alias("ts")
    )
    stream = _arriving(rows, "ts", "arriving-test")
    batches = []

    def keep(batch, batch_id):
        found = batch.select("event_id", F.dayofmonth("ts").alias("d"), F.input_file_name().alias("file")).collect()
        real = [r for r in found if r.event_id is not None]
        batches.append((sorted(r.event_id for r in real), {(r.d - 1) // 8 for r in real}, {r.file for r in found}))

    run = stream.writeStream.foreachBatch(keep).option("checkpointLocation", str(tmp_path / "c"))
    run.trigger(availableNow=True).start().awaitTermination()
    assert len(batches) == 6 and all(len(groups) <= 1 for _, groups, _ in batches)
    assert sorted(i for ids, _, _ in batches for i in ids) == list(range(n))
    assert [min(groups, default=None) for _, groups, _ in batches[:4]] == ([0, 1, 2, 3] if days == 28 else [0, None, None, None])
    assert len(batches[0][2]) == 3
