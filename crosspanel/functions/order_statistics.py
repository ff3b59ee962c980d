"""Exact order statistics of groups of any size: no group, and no pooled table, is ever one task.

Equal values are counted first, where they lie. A bounded set of a group's own values (those of least hash, so the same in
every evaluation) cuts it into ranges; ranges are summed and ordered by themselves, and what lies below a value is the sum of
the ranges below its own plus a running sum within it.

The counted values are read three times, so they are kept once made, in memory and on disk beyond that, and worked out again
where an executor is lost; what they come from is read once. `spark.catalog.clearCache()` lets go of them.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANGES = 128


def _same(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Join on `keys`, missing keys equal to each other; the right side's are left out. No keys: the right is one row."""
    if not keys:
        return left.join(F.broadcast(right))
    renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    met = F.lit(True)
    for k in keys:
        met = met & F.col(k).eqNullSafe(F.col(f"_right_{k}"))
    return left.join(renamed, met).drop(*(f"_right_{k}" for k in keys))


def counted_ranks(df: DataFrame, value: str, keys: list[str], ranges: int = RANGES) -> DataFrame:
    """keys, value, _c (rows of that value), _lo (rows of the group below it), _n (rows of the group); missing values don't count.

    `ranges` bounds the values a group is cut at, not the rows of a range.
    """
    return ranged_ranks(df, value, keys, ranges).drop("_b")


def ranged_ranks(df: DataFrame, value: str, keys: list[str], ranges: int = RANGES) -> DataFrame:
    """Counted ranks with _b, the number of the range that a value lies in: `ranges` + 1 of them at most, in order."""
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_c")).persist(StorageLevel.MEMORY_AND_DISK)
    one = keys or [F.lit(0)]
    least = Window.partitionBy(*one).orderBy(F.xxhash64(value), value)
    cuts = counted.withColumn("_r", F.row_number().over(least)).where(F.col("_r") <= ranges)
    cuts = cuts.groupBy(*keys).agg(F.sort_array(F.collect_list(value)).alias("_cuts"))
    placed = _same(counted, cuts, keys).withColumn("_b", F.size(F.filter("_cuts", lambda c: c < F.col(value)))).drop("_cuts")
    totals = placed.groupBy(*keys, "_b").agg(F.sum("_c").alias("_t"))
    group = Window.partitionBy(*one)
    below = F.sum("_t").over(group.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_t")
    totals = totals.withColumns({"_below": below, "_n": F.sum("_t").over(group)}).drop("_t")
    inside = Window.partitionBy(*keys, "_b").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    out = _same(placed, totals, [*keys, "_b"]).withColumn("_lo", F.col("_below") + F.sum("_c").over(inside) - F.col("_c"))
    return out.select(*keys, value, "_c", "_lo", "_n", "_b")


def running(ranked: DataFrame, value: str, of: dict[str, Column], largest: bool) -> DataFrame:
    """Add, to the ranged ranks of one group, the largest of each column up to a value, or the least of it from a value on.

    Each range is scanned by itself; what the ranges before it come to is a scan over one row for each range.
    """
    pick, order = (F.max, F.asc) if largest else (F.min, F.desc)
    ranked = ranked.withColumns(of)
    ends = ranked.groupBy("_b").agg(*(pick(c).alias(f"_end_{c}") for c in of))
    before = Window.partitionBy(F.lit(0)).orderBy(order("_b")).rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(F.col("_b").alias("_at"), *(pick(f"_end_{c}").over(before).alias(f"_end_{c}") for c in of))
    inside = Window.partitionBy("_b").orderBy(order(value)).rowsBetween(Window.unboundedPreceding, 0)
    joined = ranked.join(F.broadcast(ends), F.col("_b") == F.col("_at"))  # a row for each range, of which there is a bounded number
    meet = F.greatest if largest else F.least
    return joined.withColumns({c: meet(pick(c).over(inside), F.col(f"_end_{c}")) for c in of}).drop("_at", *(f"_end_{c}" for c in of))


def at_rank(value: Column, rank: Column) -> Column:
    """Aggregate over counted ranks: the value of a rank from 0."""
    return F.max(F.when((F.col("_lo") <= rank) & (rank < F.col("_lo") + F.col("_c")), value))


def quantile_at(value: Column, share: float) -> Column:
    """Aggregate over counted ranks: the linearly interpolated quantile."""
    place = F.lit(float(share)) * (F.col("_n") - 1)
    low, high = at_rank(value, F.floor(place)), at_rank(value, F.ceil(place))
    part = F.max(place - F.floor(place))
    return (1 - part) * low + part * high


def lowest_mean(value: Column, k: Column) -> Column:
    """Aggregate over counted ranks: the mean of the k smallest."""
    share = F.greatest(F.lit(0), F.least(F.col("_c"), k - F.col("_lo")))
    return F.sum(value * share) / F.sum(share)


def quantiles(df: DataFrame, value: str, keys: list[str], shares: dict[str, float]) -> DataFrame:
    """keys and one column for each named share: linearly interpolated quantiles of the values that are there."""
    return counted_ranks(df, value, keys).groupBy(*keys).agg(*(quantile_at(F.col(value), s).alias(n) for n, s in shares.items()))
