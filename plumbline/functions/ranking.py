"""Order statistics that stay parallel when one group holds most of the rows.

``sum(...) over (partition by group order by value)`` sorts a whole group in one
task. Here a group is first cut into value ranges. The ranges come from a sample
of the lowest hashes, so every evaluation of the plan finds the same cuts, even
after a lost executor. Each range is then ordered on its own, and the sums of
the earlier ranges enter it as one extra leading row.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.scalars import linear_between

CUTS = 256
_STEP = 16
_RANGE = "_range"
_LEAD = "_lead"


def lowest_by(df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int, rank: str = "_rank") -> DataFrame:
    """The first k rows of each group; Spark limits each map task to k per group
    before the shuffle. ``rank`` is kept."""
    window = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= k)


def range_cuts(
    rows: DataFrame, split: Sequence[str], value: str, weights: Sequence[str], hash_on: Sequence[str], cuts: int = CUTS
) -> DataFrame:
    """One row per ``split`` key: at most ``cuts`` sorted cut values, and every
    16th of them on its own for a quick first look-up.

    The filter on the weights also keeps the read columns the same as in the
    branch that is cut, so that both take their rows from one shuffle.
    """
    rows = rows.where(reduce(lambda a, b: a | b, [F.col(w) > 0 for w in weights]))
    picked = lowest_by(rows, split, [F.xxhash64(*hash_on, value), F.col(value)], cuts)
    edges = picked.groupBy(*split).agg(F.array_sort(F.collect_set(value)).alias("every"))
    coarse = F.filter("every", lambda cut, i: i % _STEP == 0)
    return edges.select(*split, F.struct("every", coarse.alias("coarse")).alias("_cuts"))


def _range_of(value: Column, cuts: Column) -> Column:
    """How many cuts lie below the value."""
    start = F.greatest(F.size(F.filter(cuts["coarse"], lambda cut: cut < value)) - 1, F.lit(0)) * _STEP
    return start + F.size(F.filter(F.slice(cuts["every"], start + 1, _STEP), lambda cut: cut < value))


def running_sums(
    rows: DataFrame,
    split: Sequence[str],
    value: str,
    sums: Mapping[str, Sequence[str]],
    hash_on: Sequence[str] = (),
    cuts: int = CUTS,
    edges: DataFrame | None = None,
) -> DataFrame:
    """Add ``<c>_cum`` (sum of c up to and with the value), ``<c>_equal`` (sum of c
    at the value) and ``<c>_total``.

    ``sums`` maps a column (without nulls) to the group it is summed in; every group
    starts with the ``split`` columns, for which the cuts are drawn. The number of distinct
    ``split`` keys must be small (feature names), as their cuts are broadcast;
    groups may be many. ``edges`` may hold cuts drawn earlier by ``range_cuts``; they
    only decide how evenly the work is spread.
    """
    if edges is None:
        edges = range_cuts(rows, split, value, list(sums), hash_on, cuts)
    placed = rows.join(F.broadcast(edges), list(split), "left") if split else rows.withColumn(
        "_cuts", edges.scalar()
    )
    placed = placed.withColumn(_RANGE, _range_of(F.col(value), F.col("_cuts"))).drop("_cuts")
    stacked = placed.withColumn(_LEAD, F.lit(1))
    keys = list(dict.fromkeys(k for group in sums.values() for k in group))
    finest = placed.groupBy(*keys, _RANGE).agg(*[F.sum(name).alias(name) for name in sums])
    if len(sums) > 1:
        # All branches below read all sums, so the grouping is done once for them.
        finest = finest.dropna("any", subset=list(sums))
    for name, group in sums.items():
        per_range = finest if len(group) == len(keys) else finest.groupBy(*group, _RANGE).agg(F.sum(name).alias(name))
        within = Window.partitionBy(*group)
        before = within.orderBy(_RANGE).rowsBetween(Window.unboundedPreceding, -1)
        lead = per_range.select(
            *group,
            _RANGE,
            F.coalesce(F.sum(name).over(before), F.lit(0)).alias(name),
            F.sum(name).over(within).alias(f"{name}_total"),
            F.lit(0).alias(_LEAD),
        )
        stacked = stacked.unionByName(lead, allowMissingColumns=True)
    for name, group in sorted(sums.items(), key=lambda item: len(item[1])):
        ordered = Window.partitionBy(*split, _RANGE, *[g for g in group if g not in split]).orderBy(_LEAD, value)
        peers = ordered.rangeBetween(Window.currentRow, Window.currentRow)
        stacked = stacked.withColumns(
            {
                f"{name}_cum": F.sum(name).over(ordered),
                f"{name}_equal": F.sum(name).over(peers),
                f"{name}_total": F.max(f"{name}_total").over(ordered),
            }
        )
    return stacked.where(F.col(_LEAD) == 1).drop(_LEAD, _RANGE)


def value_counts(rows: DataFrame, group: Sequence[str], value: str = "value") -> DataFrame:
    """Distinct values of each group with their number ``n``; nulls are left out."""
    return rows.where(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count(F.lit(1)).alias("n"))


def percentiles(
    counted: DataFrame,
    split: Sequence[str],
    group: Sequence[str],
    shares: Sequence[float],
    value: str = "value",
) -> DataFrame:
    """Exact linear-interpolation percentiles of (group, value, n) rows, as one
    array per group, with the group's row count as ``n``."""
    ranked = running_sums(counted, split, value, {"n": group}, hash_on=[g for g in group if g not in split])
    last = (F.col("n_total") - 1).cast("double")

    def at(position: Column) -> Column:
        hit = (F.col("n_cum") - F.col("n") <= position) & (position < F.col("n_cum"))
        return F.max(F.when(hit, F.col(value)))

    columns = []
    for i, share in enumerate(shares):
        columns.append(at(F.floor(last * F.lit(float(share)))).alias(f"_lo{i}"))
        columns.append(at(F.ceil(last * F.lit(float(share)))).alias(f"_hi{i}"))
    picked = ranked.groupBy(*group).agg(F.max("n_total").alias("n"), *columns)
    span = (F.col("n") - 1).cast("double")
    between = [
        linear_between(
            F.col(f"_lo{i}"),
            F.col(f"_hi{i}"),
            span * F.lit(float(share)) - F.floor(span * F.lit(float(share))),
        )
        for i, share in enumerate(shares)
    ]
    return picked.select(*group, "n", F.array(*between).alias("percentiles"))
