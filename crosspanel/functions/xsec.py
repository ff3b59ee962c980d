"""Cross-section expressions: ranks, quantile bins, guarded correlation and order statistics, all as window or aggregate columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def both(x: Column, y: Column) -> tuple[Column, Column]:
    """x and y where neither is missing."""
    there = x.isNotNull() & y.isNotNull()
    return F.when(there, x), F.when(there, y)


def clean_number(x: Column) -> Column:
    """NaN as NULL: Spark orders NaN above every number and lets it through aggregates."""
    return F.when(F.isnan(x), None).otherwise(x)


def average_rank(df: DataFrame, column: str, keys: list[str], out: str) -> DataFrame:
    """Add the average rank (ties share their mean) of the non-null values of `column` within `keys`.

    The mean rank of ties is halfway between the first rank and the number of values up to them, both over one window,
    so a rank costs one sort, and a chain of ranks one shuffle by `keys`.
    """
    ordered = Window.partitionBy(*keys).orderBy(F.col(column).asc_nulls_last())
    rank = (F.rank().over(ordered) + F.count(column).over(ordered.rangeBetween(Window.unboundedPreceding, Window.currentRow))) / 2
    return df.withColumn(out, F.when(F.col(column).isNotNull(), rank))


def correlation(x: Column, y: Column, least: int = 3) -> Column:
    """Aggregate: Pearson correlation, NULL for fewer than `least` pairs or a constant side.

    Twelve digits, so that none is none and has no sign, in whatever order the rows were summed.
    """
    x, y = both(x, y)
    value = F.round(F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)), 12) + 0.0
    return F.when((F.count(x) >= least) & (F.min(x) < F.max(x)) & (F.min(y) < F.max(y)), value)


def quantile_edges(column: str, n: int, keys: list[str]) -> Column:
    """Window: the distinct linearly interpolated quantiles 0, 1/n .. 1 of the non-null values within `keys`."""
    shares = F.array(*(F.lit(i / n) for i in range(n + 1)))
    return F.array_distinct(F.percentile(F.col(column), shares).over(Window.partitionBy(*keys)))


def quantile_bin(df: DataFrame, column: str, n: int, keys: list[str], out: str) -> DataFrame:
    """Add right-closed quantile bins 1..n of `column` within `keys`; ties in the edges merge bins.

    NULL where the value or a key is missing, where the section has fewer values than bins, or is constant.
    """
    w = Window.partitionBy(*keys)
    named = F.lit(True)
    for k in keys:
        named = named & F.col(k).isNotNull()
    df = df.withColumn("_edges", quantile_edges(column, n, keys)).withColumn("_size", F.count(column).over(w))
    above = F.size(F.filter("_edges", lambda e: F.col(column) > e))
    usable = F.col(column).isNotNull() & named & (F.col("_size") >= n) & (F.size("_edges") > 1)
    return df.withColumn(out, F.when(usable, F.greatest(F.lit(1), above))).drop("_edges", "_size")


def numpy_round(x: Column, digits: int = 2) -> Column:
    """Rounding half to even after scaling, as array libraries do it."""
    scale = float(10**digits)
    return F.rint(x * scale) / scale


def tail_size(n: Column, level: float) -> Column:
    """Number of observations in the lower tail: ceil(level * n), at least one."""
    return F.greatest(F.lit(1), F.ceil(F.lit(level) * n)).cast("int")


def stacked(df: DataFrame, keys: list[str], columns: dict[str, dict[object, str]], name: str) -> DataFrame:
    """Wide to long: for each value of `name`, the columns that `columns` names for it."""
    values = list(next(iter(columns.values())))
    rows = [F.struct(F.lit(v).alias(name), *(F.col(columns[out][v]).alias(out) for out in columns)) for v in values]
    return df.select(*keys, F.explode(F.array(*rows)).alias("_r")).select(*keys, f"_r.{name}", *(f"_r.{out}" for out in columns))


def horizons_of(df: DataFrame, horizons: list[int] | None = None) -> list[int]:
    """Horizons of the `forward_return_h` columns, ascending, all or those asked for."""
    found = sorted(int(c.rsplit("_", 1)[1]) for c in df.columns if c.startswith("forward_return_") and c.rsplit("_", 1)[1].isdigit())
    return found if horizons is None else [h for h in found if h in set(horizons)]
