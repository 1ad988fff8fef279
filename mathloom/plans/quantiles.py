"""Exact quantiles of groups of any size, without a buffer per group.

The range of a group's values is cut into bins; counts of bins, combined before the shuffle, tell
which bin holds a rank. Only what lies in that bin is looked at again, between the least and the
greatest value found there, until these are equal. A round narrows the range by the number of bins,
so a few rounds settle any doubles, and one or two settle coordinates.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .ranks import broadcast_if_small

BINS = 4096
_NAME, _VALUE = "_name", "_value"


def ranked_values(values: DataFrame, keys: list[str], ranks: DataFrame) -> DataFrame:
    """``(*keys, _rank, _value)``: the values that stand at 0-based ranks within their keys.

    ``values`` is ``(*keys, _value)`` without nulls, ``ranks`` is ``(*keys, _rank)``, a small table.
    """
    ends = values.groupBy(*keys).agg(F.min(_VALUE).alias("_low"), F.max(_VALUE).alias("_high"))
    # what is looked for: a rank counted from the least value of its range
    open_ranks = cut_lineage(ranks.join(ends, keys).withColumn("_within", F.col("_rank")))
    settled = []
    while True:
        done = F.col("_low") == F.col("_high")
        settled.append(open_ranks.filter(done).select(*keys, "_rank", F.col("_low").alias(_VALUE)))
        open_ranks = cut_lineage(open_ranks.filter(~done))
        if open_ranks.isEmpty():
            return reduce(DataFrame.unionByName, settled)
        ranges = broadcast_if_small(open_ranks.select(*keys, "_low", "_high").distinct())
        share = (F.col(_VALUE) - F.col("_low")) / (F.col("_high") - F.col("_low"))
        # a range that is too wide or too narrow to be divided is halved at its ends
        bin_ = F.when(F.col(_VALUE) == F.col("_high"), BINS).otherwise(F.least(F.floor(share * BINS), F.lit(BINS - 1)))
        inside = values.join(ranges, keys).filter(F.col(_VALUE).between(F.col("_low"), F.col("_high")))
        bins = inside.groupBy(*keys, "_low", "_high", bin_.cast("int").alias("_bin")).agg(
            F.count(F.lit(1)).alias("_n"), F.min(_VALUE).alias("_least"), F.max(_VALUE).alias("_most")
        )
        earlier = Window.partitionBy(*keys, "_low", "_high").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
        placed = bins.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
        found = open_ranks.join(placed, [*keys, "_low", "_high"]).filter(
            (F.col("_before") <= F.col("_within")) & (F.col("_within") < F.col("_before") + F.col("_n"))
        )
        open_ranks = cut_lineage(
            found.select(
                *keys, "_rank", (F.col("_within") - F.col("_before")).alias("_within"),
                F.col("_least").alias("_low"), F.col("_most").alias("_high"),
            )
        )


def exact_quantiles(df: DataFrame, keys: list[str], columns: dict[str, Column], shares: list[float]) -> DataFrame:
    """One row per group: for each name an array of its quantiles, interpolated as ``percentile`` does.

    Null values do not count; a group without values has a null array.
    """
    each = F.explode(F.array(*[F.struct(F.lit(n).alias(_NAME), c.cast("double").alias(_VALUE)) for n, c in columns.items()]))
    values = df.select(*keys, each.alias("_v")).select(*keys, "_v.*").filter(F.col(_VALUE).isNotNull())
    values = cut_lineage(values)
    named = [*keys, _NAME]
    sizes = values.groupBy(*named).agg(F.count(F.lit(1)).alias("_size"))
    place = lambda share: (F.col("_size") - 1) * F.lit(share)
    wanted = F.array_distinct(F.array(*[f(place(s)).cast("bigint") for s in shares for f in (F.floor, F.ceil)]))
    sizes = cut_lineage(sizes)
    found = ranked_values(values, named, sizes.select(*named, F.explode(wanted).alias("_rank")))
    at = found.groupBy(*named).agg(F.map_from_entries(F.collect_list(F.struct("_rank", _VALUE))).alias("_at"))

    def quantile(share: float) -> Column:
        low, high = F.floor(place(share)), F.ceil(place(share))
        below, above = F.element_at("_at", low.cast("bigint")), F.element_at("_at", high.cast("bigint"))
        return F.when((low == high) | (below == above), below).otherwise((high - place(share)) * below + (place(share) - low) * above)

    rows = sizes.join(at, named).select(*named, F.array(*map(quantile, shares)).alias("_quantiles"))
    return rows.groupBy(*keys).agg(
        *[F.max(F.when(F.col(_NAME) == name, F.col("_quantiles"))).alias(name) for name in columns]
    )
