"""The largest gap between step functions by branch and bound.

Values fall into ranges cut at quantiles of the reference; both sides are counted per range
where they are read. Between the ends of a range each step function stays between its values
at the ends, which bounds the gap inside. Only ranges whose bound exceeds the largest gap seen
at any end can hold the largest gap of all; only their values are moved and, where there
are many of them, cut again, or else ordered. The gap is largest at, or just before, a
value of the window, so ranges without one are left out.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.scalars import rate
from plumbline.session import settle

PIVOTS = 255  # one less than a power of two
AT_ONCE = 2_000_000  # different values of one range that are ordered in one task
_LEVELS = 6  # range numbers stay below 2 ** 48


def quantile_pivots(reference: DataFrame) -> DataFrame:
    """(feature, _range, pivots): evenly spaced quantiles of the different values of every range."""
    shares = [(i + 1) / (PIVOTS + 1) for i in range(PIVOTS)]
    return reference.groupBy("feature", "_range").agg(F.percentile_approx("value", shares, 1000).alias("pivots"))


def thinned(cuts: DataFrame) -> DataFrame:
    """Pivots out of stored cuts (``ranking.range_cuts``); NaN, above all values, fills up what is missing."""
    every = F.col("_cuts.every")
    step = F.greatest(F.ceil(F.size(every) / F.lit(PIVOTS)), F.lit(1))
    chosen = F.filter(every, lambda _, i: i % step == 0)
    filled = F.slice(F.concat(chosen, F.array_repeat(F.lit(float("nan")), PIVOTS)), 1, PIVOTS)
    return cuts.select("feature", F.lit(0).cast("long").alias("_range"), filled.alias("pivots"))


def _placed(rows: DataFrame, pivots: DataFrame) -> DataFrame:
    """Rows with the part of their range they fall into: how many pivots are not above the value.

    A binary search over the sorted pivots. As a fold it is one short call in the generated code, where
    a projection a step makes methods too long for the compiler of the JVM. Pivots are one small row a range.
    """
    steps = [(PIVOTS + 1) >> i for i in range(1, (PIVOTS + 1).bit_length())]
    found = rows.join(F.broadcast(pivots), ["feature", "_range"], "left")

    def narrowed(part: Column, step: Column) -> Column:
        return part + F.when(F.col("value") >= F.get("pivots", part + step - 1), step).otherwise(0)

    part = F.aggregate(F.array(*[F.lit(step) for step in steps]), F.lit(0), narrowed)
    return found.withColumn("_part", part).drop("pivots")


def _counts(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Rows and their weight ``n`` per key, settled."""
    counted = rows.groupBy(*keys).agg(F.sum("n").alias(name), F.count(F.lit(1)).alias(f"{name}_rows"))
    return settle(counted, f"counts{name}")


def _bounded(r: DataFrame, c: DataFrame, totals: DataFrame, leads: DataFrame, window: str) -> DataFrame:
    """One row for each window and part with values: both step functions before and after it."""
    feature_range, keys = ["feature", "_range"], [window, "feature", "_range"]
    # The reference is known after every part, also those without a reference value: 256 rows a range.
    parts = r.select(*feature_range).distinct().withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(PIVOTS))))
    upto = Window.partitionBy(*feature_range).orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    grid = parts.join(r, [*feature_range, "_part"], "left").fillna(0, ["_r", "_r_rows"])
    grid = grid.withColumn("_r_in", F.sum("_r").over(upto))
    upto = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = (
        c.withColumn("_c_in", F.sum("_c").over(upto))
        .join(grid, [*feature_range, "_part"], "left")
        .join(leads, keys)
        .join(totals, [window, "feature"])
    )
    r_end, c_end = F.col("_r0") + F.col("_r_in"), F.col("_c0") + F.col("_c_in")
    found = found.select(
        *keys, "_part", "_r_rows", "_c_rows", "n_reference", "n_current",
        (r_end - F.col("_r")).alias("_r0"), (c_end - F.col("_c")).alias("_c0"), r_end.alias("_r1"), c_end.alias("_c1"),
    )
    ends = [rate(F.col(f"_{side}{i}"), F.col(total)) for i in (0, 1) for side, total in (("r", "n_reference"), ("c", "n_current"))]
    r0, c0, r1, c1 = ends
    return found.withColumns(
        {"_seen": F.greatest(F.abs(r0 - c0), F.abs(r1 - c1)), "_bound": F.greatest(r1 - c0, c1 - r0)}
    )


def _ordered(reference: DataFrame, current: DataFrame, ranges: DataFrame, window: str) -> DataFrame:
    """(window, feature, gap): the largest gap at the values of the open ranges, each ordered in one task."""
    place = ["feature", "_range"]
    tagged = reference.groupBy(*place, "value").agg(F.sum("n").alias("r")).withColumn("c", F.lit(0).cast("long"))
    own = current.groupBy(window, *place, "value").agg(F.sum("n").alias("c")).withColumn("r", F.lit(0).cast("long"))
    rows = tagged.unionByName(own, allowMissingColumns=True)
    by_value, own_value = Window.partitionBy(*place).orderBy("value"), Window.partitionBy(*place, window).orderBy("value")
    peers = by_value.rangeBetween(Window.currentRow, Window.currentRow)
    ranked = rows.withColumns(
        {"_r_upto": F.sum("r").over(by_value), "_r_here": F.sum("r").over(peers), "_c_upto": F.sum("c").over(own_value)}
    ).where(F.col("c") > 0)
    known = ranked.join(ranges.select(window, *place, "_r0", "_c0", "n_reference", "n_current"), [window, *place])

    def share(lead: str, inside: Column, total: str) -> Column:
        return rate(F.col(lead) + inside, F.col(total))

    here = F.abs(share("_r0", F.col("_r_upto"), "n_reference") - share("_c0", F.col("_c_upto"), "n_current"))
    below = F.abs(
        share("_r0", F.col("_r_upto") - F.col("_r_here"), "n_reference")
        - share("_c0", F.col("_c_upto") - F.col("c"), "n_current")
    )
    return known.groupBy(window, "feature").agg(F.max(F.greatest(here, below)).alias("gap"))


def largest_gaps(
    reference: DataFrame, current: DataFrame, window: str, cuts: DataFrame | None = None, at_once: int = AT_ONCE
) -> DataFrame:
    """(window, feature, n_reference, n_current, gap): the largest absolute gap between the
    step functions of ``reference`` (feature, value, n) and of every window of ``current``
    (window, feature, value, n), exactly.

    Values must not be null; equal values may come in several rows. A feature without a
    reference has ``n_reference`` 0 and no gap. A range of more than ``at_once`` rows is
    cut, one of fewer is ordered. ``cuts`` may hold stored cuts of the reference.
    """
    whole, zero = F.lit(0).cast("long").alias("_range"), F.lit(0).cast("long")
    place = ["feature", "_range"]
    r_rows, c_rows = reference.select("feature", whole, "value", "n"), current.select(window, "feature", whole, "value", "n")
    # One job counts both sides; the reference's rows have no window.
    both = r_rows.select("feature", "n", F.lit(1).alias("_side")).unionByName(
        c_rows.select(window, "feature", "n", F.lit(2).alias("_side")), allowMissingColumns=True
    )
    counted = settle(both.groupBy("_side", window, "feature").agg(F.sum("n").alias("_n"), F.count("n").alias("_rows")), "totals")
    r_count = counted.where("_side = 1").select("feature", F.col("_n").alias("n_reference"), F.col("_rows").alias("_r_rows"))
    c_count = counted.where("_side = 2").select(
        window, "feature", F.col("_n").alias("n_current"), F.col("_rows").alias("_c_rows")
    )
    found = c_count.join(r_count, "feature", "left").fillna(0, ["n_reference", "_r_rows"])
    totals = found.select(window, "feature", "n_reference", "n_current")
    ranges = found.select("*", whole, zero.alias("_r0"), zero.alias("_c0"))
    best, before = None, float("inf")
    for level in range(_LEVELS):
        # A range's reference values are ordered once, with the values of all windows for which it is open.
        sizes = ranges.groupBy(*place).agg((F.max("_r_rows") + F.sum("_c_rows")).alias("size"))
        largest = sizes.agg(F.max("size")).first()[0]
        # What does not get smaller is one value many times, which is one row when it is ordered.
        if largest is None or largest <= at_once or largest > 0.5 * before:
            break
        before = largest
        if level == 0:
            pivots = quantile_pivots(r_rows) if cuts is None else thinned(cuts)
        else:
            pivots = quantile_pivots(r_rows.unionByName(c_rows.drop(window)))
        pivots = settle(pivots, "pivots")
        r_placed, c_placed = _placed(r_rows, pivots), _placed(c_rows, pivots)
        r, c = _counts(r_placed, [*place, "_part"], "_r"), _counts(c_placed, [window, *place, "_part"], "_c")
        bounded = settle(_bounded(r, c, totals, ranges.select(window, *place, "_r0", "_c0"), window), "bounded")
        seen = bounded.groupBy(window, "feature").agg(F.max("_seen").alias("gap"))
        best = settle(seen if best is None else _largest(best, seen, window), "gaps")
        parts = settle(bounded.join(best, [window, "feature"]).where(F.col("_bound") > F.col("gap")).drop("gap"), "open")
        narrower = (F.col("_range") * (PIVOTS + 1) + F.col("_part")).alias("_range")
        c_open = c_placed.join(parts.select(window, *place, "_part"), [window, *place, "_part"], "left_semi")
        r_open = r_placed.join(parts.select(*place, "_part").distinct(), [*place, "_part"], "left_semi")
        c_rows = settle(c_open.select(window, "feature", narrower, "value", "n"), "open-current")
        r_rows = settle(r_open.select("feature", narrower, "value", "n"), "open-reference")
        ranges = parts.select(window, "feature", narrower, "_r_rows", "_c_rows", "_r0", "_c0", "n_reference", "n_current")
    ordered = _ordered(r_rows, c_rows, ranges, window)
    return totals.join(ordered if best is None else _largest(best, ordered, window), [window, "feature"], "left")


def _largest(a: DataFrame, b: DataFrame, window: str) -> DataFrame:
    return a.unionByName(b).groupBy(window, "feature").agg(F.max("gap").alias("gap"))
