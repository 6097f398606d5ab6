"""Exact order statistics by selection: only rows next to a wanted rank are moved.

A mergeable quantile sketch, built where the rows are read, brackets every wanted rank of
every group: its error is a known share of the group's rows. A second pass counts, again
where the rows are read, how many lie between the brackets, and moves only the different
values inside them. Ranks among those few give the exact values. The sketch gets finer
as groups grow, so what is ordered per group grows with the square root of its rows. A rank
that is not inside its bracket, which the sketch's error bound excludes, is found by ordering
its whole group in ranges (``ranking``).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.ranking import percentiles, value_counts
from plumbline.functions.scalars import linear_between
from plumbline.session import settle

ACCURACY = 10_000
MAX_ACCURACY = 1_000_000
_MARGIN = 4  # a bracket reaches this many sketch errors to each side of its rank


# (group, n, _q) of every group: its row count and the sketch's values at the asked shares.
Sketch = Callable[[Sequence[float], int], DataFrame]


def _brackets(sketch: Sketch, group: Sequence[str], shares: Sequence[float], accuracy: int) -> DataFrame:
    """(group, n, lows, highs): settled, one row per group. Where a margin is no whole rank, and at the
    ends, a bracket is open."""
    margin = _MARGIN / accuracy
    asked = [min(1.0, max(0.0, s + side)) for s in shares for side in (-margin, margin)]
    sketched = sketch(asked, accuracy)
    small = F.col("n") <= accuracy // 2
    lows, highs = [], []
    for i, share in enumerate(shares):
        open_low, open_high = small | F.lit(share - margin <= 0), small | F.lit(share + margin >= 1)
        lows.append(F.when(open_low, F.lit(-math.inf)).otherwise(F.col("_q")[2 * i]))
        highs.append(F.when(open_high, F.lit(math.inf)).otherwise(F.col("_q")[2 * i + 1]))
    return settle(sketched.select(*group, "n", F.array(*lows).alias("lows"), F.array(*highs).alias("highs")), "brackets")


def reduced_ranks(known: DataFrame, brackets: DataFrame, group: Sequence[str], k: int) -> DataFrame:
    """(group, _j, _x, c): rows counted by the bracket they follow, and by value inside a bracket.

    Counts are combined where the rows are read; ``_x`` is null for rows between brackets.
    """
    if group:
        keyed = brackets.select(*[F.col(g).alias(f"_b_{g}") for g in group], "lows", "highs")
        same = reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(f"_b_{g}")) for g in group])
        placed = known.join(keyed, same)
    else:
        edge = brackets.select(F.struct("lows", "highs").alias("b")).scalar()
        placed = known.withColumn("_edge", edge).withColumns({"lows": F.col("_edge.lows"), "highs": F.col("_edge.highs")})
    started = reduce(lambda a, b: a + b, [(F.col("_v") >= F.col("lows")[i]).cast("int") for i in range(k)])
    inside = reduce(lambda a, b: a | b, [F.col("_v").between(F.col("lows")[i], F.col("highs")[i]) for i in range(k)])
    return (
        placed.select(*group, started.alias("_j"), F.when(inside, F.col("_v")).alias("_x"))
        .groupBy(*group, "_j", "_x")
        .agg(F.count(F.lit(1)).alias("c"))
    )


def sketch_of(known: DataFrame, group: Sequence[str]) -> Sketch:
    return lambda asked, accuracy: known.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n"), F.percentile_approx("_v", list(asked), accuracy).alias("_q")
    )


def percentiles_of(
    rows: DataFrame,
    group: Sequence[str],
    shares: Sequence[float],
    value: str = "value",
    sketch: Sketch | None = None,
) -> DataFrame:
    """(group, n, percentiles): exact linear-interpolation percentiles of ``value`` in each group.

    ``shares`` must ascend. Null and NaN values are left out, and groups that have nothing else;
    infinite values are values like others. A null group is a group. Two passes over the
    rows. ``sketch`` may give the same sketches in a cheaper way than from the long rows.
    """
    if list(shares) != sorted(shares):
        raise ValueError("shares must ascend")
    v = F.col(value).cast("double")
    known = rows.where(v.isNotNull() & ~F.isnan(v)).select(*group, v.alias("_v"))
    sketch, accuracy = sketch or sketch_of(known, group), ACCURACY
    while True:
        brackets = _brackets(sketch, group, shares, accuracy)
        largest = brackets.agg(F.max("n")).first()[0] or 0
        wanted = min(MAX_ACCURACY, math.isqrt(2 * (_MARGIN + 1) * len(shares) * largest))
        if wanted <= accuracy:
            break
        accuracy = wanted
    reduced = reduced_ranks(known, brackets, group, len(shares))
    order = Window.partitionBy(*group).orderBy("_j", F.col("_x").isNull(), "_x")
    ranked = reduced.withColumns(
        {
            "_upto": F.sum("c").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)),
            "n": F.sum("c").over(Window.partitionBy(*group)),
        }
    )
    last = (F.col("n") - 1).cast("double")

    def holds(rank: Column) -> Column:
        return (F.col("_upto") - F.col("c") <= rank) & (rank < F.col("_upto"))

    columns, missed = [], []
    for i, share in enumerate(shares):
        for side, rank in (("lo", F.floor(last * F.lit(float(share)))), ("hi", F.ceil(last * F.lit(float(share))))):
            columns.append(F.max(F.when(holds(rank), F.col("_x"))).alias(f"_{side}{i}"))
            missed.append(holds(rank) & F.col("_x").isNull())
    missed_any = F.max(reduce(lambda a, b: a | b, missed)).alias("_missed")
    picked = settle(ranked.groupBy(*group).agg(F.max("n").alias("n"), *columns, missed_any), "selected")
    span = (F.col("n") - 1).cast("double")
    between = []
    for i, share in enumerate(shares):
        low, high, at = F.col(f"_lo{i}"), F.col(f"_hi{i}"), span * F.lit(float(share))
        between.append(F.when(low == high, low).otherwise(linear_between(low, high, at - F.floor(at))))
    found = picked.select(*group, "n", F.array(*between).alias("percentiles"), "_missed").where("n IS NOT NULL")
    if not picked.where("_missed").isEmpty():
        found = _with_ordered(known, found, group, shares)
    return found.drop("_missed")


def _with_ordered(known: DataFrame, found: DataFrame, group: Sequence[str], shares: Sequence[float]) -> DataFrame:
    """The groups whose ranks were missed, by ordering all their rows."""
    if not group:
        counted = value_counts(known.withColumn("_all", F.lit(0)), ["_all"], "_v")
        return percentiles(counted, [], ["_all"], shares, "_v").select("n", "percentiles")
    again = found.where("_missed").select(*[F.col(g).alias(f"_b_{g}") for g in group])
    same = reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(f"_b_{g}")) for g in group])
    counted = value_counts(known.join(again, same, "left_semi"), group, "_v")
    ordered = percentiles(counted, [], group, shares, "_v").select(*group, "n", "percentiles")
    return found.where(~F.col("_missed")).drop("_missed").unionByName(ordered)


def medians(rows: DataFrame, group: Sequence[str], value: str) -> DataFrame:
    """(group, n, median): exact; no row for a group without values."""
    found = percentiles_of(rows, group, [0.5], value)
    return found.select(*group, "n", F.col("percentiles")[0].alias("median"))
