"""Information coefficients, rank autocorrelation and turnover: each section first, then over time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crosspanel.functions.xsec import average_rank, both, correlation, horizons_of, stacked
from crosspanel.operators.contracts import fail


def information_coefficient(data: DataFrame, horizons: list[int] | None = None, method: str = "spearman", keys: list[str] | None = None, complete: bool = False) -> DataFrame:
    """date[, keys], horizon, ic, n: correlation of the factor with each forward return over the pairs that have both.

    NULL for fewer than three pairs or a constant side. All ranks need one shuffle by date. `complete` says that no row
    lacks the factor or a return, as the cleaned sample's don't: the factor is then ranked once for all horizons.
    """
    if method not in ("spearman", "pearson"):
        fail("ic", "bad_method", f"{method!r} is neither spearman nor pearson")
    keys = ["date", *(keys or [])]
    horizons = horizons_of(data, horizons)
    rows, pairs = [], {}
    for h in horizons:
        x, y = (F.col("factor"), F.col(f"forward_return_{h}")) if complete else both(F.col("factor"), F.col(f"forward_return_{h}"))
        pairs[h] = ("_x" if complete else f"_x{h}", f"_y{h}")
        rows += [x.alias(pairs[h][0])] if not complete or not rows else []
        rows.append(y.alias(pairs[h][1]))
    df = data.select(*keys, *rows)
    if method == "spearman":
        for name in dict.fromkeys(c for pair in pairs.values() for c in pair):
            df = average_rank(df, name, keys, f"_r{name}")
        pairs = {h: (f"_r{a}", f"_r{b}") for h, (a, b) in pairs.items()}
    asked = [x for h, (a, b) in pairs.items() for x in (correlation(F.col(a), F.col(b)).alias(f"_ic{h}"), F.count(a).alias(f"_n{h}"))]
    wide = df.groupBy(*keys).agg(*asked)
    return stacked(wide, keys, {"ic": {h: f"_ic{h}" for h in horizons}, "n": {h: f"_n{h}" for h in horizons}}, "horizon")


def ic_summary(ic: DataFrame) -> DataFrame:
    """horizon, n, mean, std, icir, t_naive, positive_rate, abs_mean over the periods that have an IC."""
    x = F.col("ic")
    out = ic.groupBy("horizon").agg(
        F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"), F.avg((x > 0).cast("double")).alias("positive_rate"), F.avg(F.abs(x)).alias("abs_mean")
    )
    icir = F.try_divide("mean", "std")
    return out.select("horizon", "n", "mean", "std", icir.alias("icir"), (icir * F.sqrt("n")).alias("t_naive"), "positive_rate", "abs_mean")


def ic_decay(data: DataFrame, horizons: list[int] | None = None, method: str = "spearman", complete: bool = False) -> DataFrame:
    """Summary of the IC by horizon."""
    return ic_summary(information_coefficient(data, horizons, method, complete=complete))


def rolling_ic(ic: DataFrame, window: int = 252, min_periods: int | None = None) -> DataFrame:
    """date, horizon, rolling_ic: mean of the last `window` periods' IC, from `min_periods` on."""
    least = max(10, window // 4) if min_periods is None else min_periods
    w = Window.partitionBy("horizon").orderBy("date").rowsBetween(-(window - 1), 0)
    return ic.select("date", "horizon", F.when(F.count("ic").over(w) >= least, F.avg("ic").over(w)).alias("rolling_ic"))


def periods(df: DataFrame) -> DataFrame:
    """date, period: observed dates numbered from 0."""
    return df.select("date").distinct().withColumn("period", F.row_number().over(Window.orderBy("date")) - 1)


def rank_autocorrelation(data: DataFrame, column: str = "factor", lag: int = 1, min_n: int = 3) -> DataFrame:
    """date, autocorrelation, n: rank correlation of each period with the one `lag` before, over the assets of both."""
    own = data.select("date", "asset", F.col(column).alias("x")).where("x is not null")
    own = own.join(F.broadcast(periods(data)), "date")
    before = own.select("asset", (F.col("period") + lag).alias("period"), F.col("x").alias("y"))
    pairs = own.join(before, ["asset", "period"])
    ranked = average_rank(average_rank(pairs, "x", ["date"], "rx"), "y", ["date"], "ry")
    return ranked.groupBy("date").agg(correlation(F.col("rx"), F.col("ry"), min_n).alias("autocorrelation"), F.count("*").alias("n"))


def quantile_turnover(labels: DataFrame, lag: int = 1, method: str = "entering", n_quantiles: int | None = None) -> DataFrame:
    """date, factor_quantile, turnover from labels (date, asset, factor_quantile), of the bins 1 .. n_quantiles if that is given.

    `entering`: the share of a bin's members that were not in it `lag` periods before. `symmetric`: members in one of
    both, over members in either, halved.
    """
    own = labels.where("factor_quantile is not null").select("date", "asset", "factor_quantile")
    if n_quantiles is not None:
        own = own.where(F.col("factor_quantile").between(1, n_quantiles))
    numbers = F.broadcast(periods(labels))
    own = own.join(numbers, "date")
    before = own.select("asset", "factor_quantile", (F.col("period") + lag).alias("period"), F.lit(1).alias("was"))
    last = numbers.agg(F.max("period").alias("p"))
    now = own.select("asset", "factor_quantile", "period", F.lit(1).alias("is_in"))
    met = now.join(before, ["asset", "factor_quantile", "period"], "full_outer").join(F.broadcast(last)).where("period <= p and period >= " + str(lag))
    n = met.groupBy("period", "factor_quantile").agg(F.count("is_in").alias("size"), F.count_if(F.col("is_in").isNotNull() & F.col("was").isNull()).alias("new"),
                                                  F.count("*").alias("either"), F.count_if(F.col("is_in").isNotNull() & F.col("was").isNotNull()).alias("stay"), F.count("was").alias("had"))
    if method == "entering":
        value = F.when(F.col("had") > 0, F.try_divide(F.col("new").cast("double"), F.col("size")))
    elif method == "symmetric":
        value = F.when((F.col("had") > 0) & (F.col("size") > 0), (F.col("either") - F.col("stay")) / F.col("either") / 2)
    else:
        fail("turnover", "bad_method", f"{method!r} is neither entering nor symmetric")
    return n.join(numbers, "period").select("date", "factor_quantile", value.alias("turnover")).where("turnover is not null")
