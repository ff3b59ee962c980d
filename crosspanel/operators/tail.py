"""Tail risk: exact order statistics, never interpolated where the definition isn't.

Pooled tails come from counted ranks, which no group's size holds up; a section (one date's assets) is ranked in a window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crosspanel.functions.order_statistics import at_rank, counted_ranks, lowest_mean, quantile_at
from crosspanel.functions.xsec import horizons_of, stacked, tail_size
from crosspanel.operators.inference import nw_summary


def _ranked(df: DataFrame, keys: list[str], value: str, level: float) -> DataFrame:
    """Non-missing values with _k (tail size of their group), _r (rank from below) and _cut (the k-th smallest)."""
    group = Window.partitionBy(*keys)
    out = df.where(F.col(value).isNotNull()).withColumn("_k", tail_size(F.count(value).over(group), level))
    out = out.withColumn("_r", F.row_number().over(group.orderBy(value)))
    return out.withColumn("_cut", F.max(F.when(F.col("_r") == F.col("_k"), F.col(value))).over(group))


def tail_risk(df: DataFrame, value: str, keys: list[str] | None = None, level: float = 0.05, mar: float = 0.0) -> DataFrame:
    """keys, n, value_at_risk (the k-th smallest), cvar (mean of the k smallest), downside_deviation, tail_ratio."""
    keys = keys or []
    x, rows = F.col(value), F.col("_c")
    k = tail_size(F.col("_n"), level)
    low = F.when(x < mar, (x - mar) * (x - mar) * rows)
    losses = F.sum(F.when(x < mar, rows))
    out = counted_ranks(df, value, keys).groupBy(*keys).agg(
        F.coalesce(F.sum(rows), F.lit(0)).alias("n"), at_rank(x, k - 1).alias("value_at_risk"), lowest_mean(x, k).alias("cvar"),
        F.when(losses >= 2, F.sqrt(F.sum(low) / losses)).alias("downside_deviation"),
        F.abs(F.try_divide(quantile_at(x, 1 - level), quantile_at(x, level))).alias("tail_ratio"),
    )
    return out


def crash_stats(df: DataFrame, value: str, keys: list[str] | None = None, level: float = 0.05, threshold: float | None = None) -> DataFrame:
    """keys, n, cut, hits, hit_rate, mean_crash, cvar: values at or below an absolute threshold, or the k-th smallest."""
    keys = keys or []
    x, rows = F.col(value), F.col("_c")
    k = tail_size(F.col("_n"), level)
    # at or below the k-th smallest: every value of which fewer than k lie below
    hit = F.col("_lo") < k if threshold is None else x <= F.lit(float(threshold))
    cut = at_rank(x, k - 1) if threshold is None else F.lit(float(threshold))
    hits = F.coalesce(F.sum(F.when(hit, rows)), F.lit(0))
    return counted_ranks(df, value, keys).groupBy(*keys).agg(
        F.coalesce(F.sum(rows), F.lit(0)).alias("n"), cut.alias("cut"), hits.alias("hits"), F.try_divide(hits, F.sum(rows)).alias("hit_rate"),
        F.try_divide(F.sum(F.when(hit, x * rows)), hits).alias("mean_crash"), lowest_mean(x, k).alias("cvar"),
    )


def tail_by_quantile(data: DataFrame, horizons: list[int] | None = None, level: float = 0.05, threshold: float | None = None) -> DataFrame:
    """Crash statistics by horizon and factor_quantile, over all dates. `data` holds factor_quantile."""
    long = _long(data, horizons)
    return crash_stats(long, "r", ["horizon", "factor_quantile"], level, threshold)


def _long(data: DataFrame, horizons: list[int] | None) -> DataFrame:
    hs = horizons_of(data, horizons)
    return stacked(data.where("factor_quantile is not null"), ["date", "asset", "factor_quantile"], {"r": {h: f"forward_return_{h}" for h in hs}}, "horizon").where("r is not null")


def crash_spread(data: DataFrame, n: int = 5, horizons: list[int] | None = None, level: float = 0.05, threshold: float | None = None, lags: int | None = None) -> DataFrame:
    """horizon, n_periods, mean_spread, hit_spread, t_nw of it, threshold: top against bottom bin, section by section.

    The cut is the section's own k-th smallest unless absolute; sections need two assets in either bin.
    """
    cut = F.col("_cut") if threshold is None else F.lit(float(threshold))
    df = _ranked(_long(data, horizons), ["date", "horizon"], "r", level).withColumn("_hit", (F.col("r") <= cut).cast("double"))
    side = lambda q, x: F.when(F.col("factor_quantile") == q, F.col(x))
    by_date = df.groupBy("date", "horizon").agg(
        F.count(side(n, "r")).alias("_t"), F.count(side(1, "r")).alias("_b"), (F.avg(side(n, "r")) - F.avg(side(1, "r"))).alias("mean_spread"),
        (F.avg(side(n, "_hit")) - F.avg(side(1, "_hit"))).alias("hit_spread"),
    ).where("_t >= 2 and _b >= 2")
    means = by_date.groupBy("horizon").agg(F.count("*").alias("n_periods"), F.avg("mean_spread").alias("mean_spread"), F.avg("hit_spread").alias("hit_spread"))
    nw = nw_summary(by_date, ["horizon"], "hit_spread", lags=lags, horizon_column="horizon").select("horizon", "t_nw")
    return means.join(F.broadcast(nw), "horizon").withColumn("threshold", F.lit(threshold).cast("double"))
