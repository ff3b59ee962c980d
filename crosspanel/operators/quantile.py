"""Quantile portfolios: labels, returns, statistics and double sorts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crosspanel.functions.xsec import average_rank, correlation, horizons_of, quantile_bin, stacked
from crosspanel.operators.contracts import fail


def quantize(data: DataFrame, n: int = 5, by: str | None = None, method: str = "independent", column: str = "factor", n_by: int | None = None) -> DataFrame:
    """Add factor_quantile 1..n, and with `by` also by_quantile.

    independent: both over the whole section. conditional: the factor within (date, by_quantile); no label without one.
    """
    if method not in ("independent", "conditional"):
        fail("quantile", "bad_method", f"{method!r} is neither independent nor conditional")
    if by is None:
        return quantile_bin(data, column, n, ["date"], "factor_quantile")
    df = quantile_bin(data, by, n_by or n, ["date"], "by_quantile")
    return quantile_bin(df, column, n, ["date", "by_quantile"] if method == "conditional" else ["date"], "factor_quantile")


def _labelled(data: DataFrame, n: int, by: str | None, method: str) -> tuple[DataFrame, list[str]]:
    has = "factor_quantile" in data.columns and by is None
    df = data if has else quantize(data, n, by, method)
    keys = ["date", *(["by_quantile"] if by else []), "factor_quantile"]
    return df.dropna(subset=keys[1:]), keys


def quantile_returns(
    data: DataFrame, n: int = 5, by: str | None = None, method: str = "independent", horizons: list[int] | None = None, quantile_labels: DataFrame | None = None,
) -> DataFrame:
    """date[, by_quantile], factor_quantile, count and the mean of each forward return.

    Labels at hand, `quantile_labels` (date, asset, factor_quantile[, by_quantile]), come before those worked out here.
    """
    if quantile_labels is not None:
        keys = ["date", *(["by_quantile"] if by else []), "factor_quantile"]
        df = data.drop("factor_quantile", "by_quantile").join(quantile_labels.select("asset", *keys), ["date", "asset"]).dropna(subset=keys[1:])
    else:
        df, keys = _labelled(data, n, by, method)
    means = [F.avg(f"forward_return_{h}").alias(f"forward_return_{h}") for h in horizons_of(data, horizons)]
    return df.groupBy(*keys).agg(*means, F.count("*").alias("count"))


def long_short(returns: DataFrame, n: int, horizons: list[int] | None = None) -> DataFrame:
    """date and for each horizon the top bin's mean return less the bottom's, averaged over any outer bins."""
    asked = []
    for h in horizons_of(returns, horizons):
        r = F.col(f"forward_return_{h}")
        side = lambda q: F.avg(F.when(F.col("factor_quantile") == q, r))  # noqa: E731, B023
        asked.append((side(n) - side(1)).alias(f"forward_return_{h}"))
    return returns.groupBy("date").agg(*asked)


def quantile_stats(data: DataFrame, n: int = 5, by: str | None = None, method: str = "independent", horizons: list[int] | None = None) -> DataFrame:
    """horizon, factor_quantile, mean of the periods' means, mean count, periods; and over bins spread, t_naive, monotonicity."""
    horizons = horizons_of(data, horizons)
    returns = quantile_returns(data, n, by, method, horizons)
    flat = returns.withColumns({f"_c{h}": F.col("count") for h in horizons})
    long = stacked(flat, ["date", "factor_quantile"], {"r": {h: f"forward_return_{h}" for h in horizons}, "c": {h: f"_c{h}" for h in horizons}}, "horizon")
    bins = long.groupBy("horizon", "factor_quantile").agg(F.avg("r").alias("mean"), F.avg("c").alias("mean_count"), F.count_distinct("date").alias("n_periods"))
    ranked = average_rank(bins, "mean", ["horizon"], "_r")
    steps = ranked.groupBy("horizon").agg(correlation(F.col("factor_quantile").cast("double"), F.col("_r")).alias("monotonicity"))
    ls = stacked(long_short(returns, n, horizons), ["date"], {"s": {h: f"forward_return_{h}" for h in horizons}}, "horizon")
    spread = ls.groupBy("horizon").agg(F.avg("s").alias("spread"), F.try_divide(F.avg("s") * F.sqrt(F.count("s")), F.stddev_samp("s")).alias("t_naive"))
    return bins.join(F.broadcast(spread), "horizon").join(F.broadcast(steps), "horizon")


def monotonicity_test(data: DataFrame, n: int = 5, by: str | None = None, method: str = "conditional", horizons: list[int] | None = None) -> DataFrame:
    """horizon, spearman of bin and mean return, n_periods, and whether it reaches 0.9."""
    stats = quantile_stats(data, n, by, method, horizons)
    out = stats.groupBy("horizon").agg(F.first("monotonicity").alias("spearman"), F.max("n_periods").alias("n_periods"))
    return out.withColumn("monotonic", F.abs("spearman") >= 0.9)


def double_sort(data: DataFrame, by: str, n_by: int = 5, n: int = 5, method: str = "independent", horizons: list[int] | None = None) -> DataFrame:
    """by_quantile, factor_quantile, horizon over the whole grid: mean of period means, periods, observations, missing.

    Cells that no period fills stay in the grid with their reason. The grid has n_by * n cells.
    """
    horizons = horizons_of(data, horizons)
    returns = quantile_returns(quantize(data, n, by, method, n_by=n_by).drop("factor_quantile", "by_quantile"), n, by, method, horizons) if n_by == n else None
    if returns is None:
        labelled = quantize(data, n, by, method, n_by=n_by).dropna(subset=["by_quantile", "factor_quantile"])
        returns = labelled.groupBy("date", "by_quantile", "factor_quantile").agg(*(F.avg(f"forward_return_{h}").alias(f"forward_return_{h}") for h in horizons), F.count("*").alias("count"))
    flat = returns.withColumns({f"_c{h}": F.col("count") for h in horizons})
    long = stacked(flat, ["date", "by_quantile", "factor_quantile"], {"r": {h: f"forward_return_{h}" for h in horizons}, "c": {h: f"_c{h}" for h in horizons}}, "horizon")
    cells = long.groupBy("by_quantile", "factor_quantile", "horizon").agg(F.avg("r").alias("mean"), F.count("r").alias("n_periods"), F.sum("c").alias("n_obs"))
    spark = data.sparkSession
    grid = spark.range(n_by * n).select((F.floor(F.col("id") / n) + 1).cast("int").alias("by_quantile"), (F.col("id") % n + 1).cast("int").alias("factor_quantile"))
    grid = grid.withColumn("horizon", F.explode(F.array(*map(F.lit, horizons))))
    periods = data.select("date").distinct().agg(F.count("*").alias("_all"))
    out = grid.join(F.broadcast(cells), ["by_quantile", "factor_quantile", "horizon"], "left").join(F.broadcast(periods))
    missing = F.when(F.col("n_periods").isNull() | (F.col("n_periods") == 0), "all_missing").when(F.col("n_periods") < F.col("_all"), "part_missing")
    return out.withColumn("missing", missing).withColumns({"n_periods": F.coalesce("n_periods", F.lit(0)), "n_obs": F.coalesce("n_obs", F.lit(0))}).drop("_all")


def double_sort_monotonicity(data: DataFrame, by: str, n_by: int = 5, n: int = 5, method: str = "independent", horizons: list[int] | None = None) -> DataFrame:
    """by_quantile, horizon, spearman of factor bin and mean of the periods' mean returns; NULL below three bins.

    by_quantile 0 pools all outer bins, as `quantile_stats` does.
    """
    rolled = monotonicity_rollup(data, by, n_by, n, method, horizons).where("level < 2")
    return rolled.select(F.when(F.col("level") == 0, F.col("by_quantile")).otherwise(0).cast("int").alias("by_quantile"), "horizon", "spearman")


def monotonicity_rollup(data: DataFrame, by: str, n_by: int = 5, n: int = 5, method: str = "independent", horizons: list[int] | None = None) -> DataFrame:
    """horizon, by_quantile, level, n_bins, n_periods, mean, spearman: monotonicity within each outer bin, over all of them
    (level 1, by_quantile NULL), and over all horizons as well (level 2, horizon NULL, too).

    One aggregation with grouping sets makes the bins' means of all levels from the cells of the periods, of which there
    are few; ranks and correlations are of n means each.
    """
    horizons = horizons_of(data, horizons)
    labelled = quantize(data, n, by, method, n_by=n_by).dropna(subset=["by_quantile", "factor_quantile"])
    returns = labelled.groupBy("date", "by_quantile", "factor_quantile").agg(*(F.avg(f"forward_return_{h}").alias(f"forward_return_{h}") for h in horizons))
    long = stacked(returns, ["date", "by_quantile", "factor_quantile"], {"r": {h: f"forward_return_{h}" for h in horizons}}, "horizon").where("r is not null")
    sets = [[F.col(c) for c in own] for own in (["horizon", "by_quantile", "factor_quantile"], ["horizon", "factor_quantile"], ["factor_quantile"])]
    means = long.groupingSets(sets, "horizon", "by_quantile", "factor_quantile").agg(
        (F.grouping("horizon") + F.grouping("by_quantile")).cast("int").alias("level"), F.avg("r").alias("m"), F.count("r").alias("c")
    )
    keys = ["level", "horizon", "by_quantile"]
    ranked = average_rank(means, "m", keys, "_r")
    return ranked.groupBy(*keys).agg(
        F.count("m").alias("n_bins"), F.sum("c").alias("n_periods"), F.avg("m").alias("mean"), correlation(F.col("factor_quantile").cast("double"), F.col("_r")).alias("spearman")
    )


def double_sort_frame(cells: DataFrame, horizon: int, n: int) -> DataFrame:
    """by_quantile against factor_quantile, one horizon."""
    return cells.where(F.col("horizon") == horizon).groupBy("by_quantile").pivot("factor_quantile", list(range(1, n + 1))).agg(F.first("mean"))


def dropped_from_sort(data: DataFrame, by: str, n_by: int = 5, n: int = 5, method: str = "independent") -> DataFrame:
    """reason, n for the rows that a double sort leaves out; with its observations they make up all rows."""
    df = quantize(data, n, by, method, n_by=n_by)
    reason = (
        F.when(F.col(by).isNull(), "no_by").when(F.col("by_quantile").isNull(), "by_not_sorted")
        .when(F.col("factor").isNull(), "no_factor").when(F.col("factor_quantile").isNull(), "factor_not_sorted")
    )
    return df.withColumn("reason", reason).where("reason is not null").groupBy("reason").agg(F.count("*").alias("n"))


def factor_returns(data: DataFrame, n: int = 5, horizons: list[int] | None = None, by: str | None = None, method: str = "independent", top_less_bottom: bool = True) -> DataFrame:
    """date and each horizon's return of the top bin, less the bottom bin's unless told otherwise."""
    returns = quantile_returns(data, n, by, method, horizons)
    if top_less_bottom:
        return long_short(returns, n, horizons)
    asked = [F.avg(F.when(F.col("factor_quantile") == n, F.col(f"forward_return_{h}"))).alias(f"forward_return_{h}") for h in horizons_of(data, horizons)]
    return returns.groupBy("date").agg(*asked)


def weighted_returns(data: DataFrame, weight: str, horizons: list[int] | None = None) -> DataFrame:
    """date and each horizon's return of a portfolio with weights normalised by section; a section of weight 0 returns 0."""
    w = Window.partitionBy("date")
    share = F.coalesce(F.try_divide(F.col(weight), F.sum(weight).over(w)), F.lit(0.0))
    df = data.withColumn("_w", share)
    return df.groupBy("date").agg(*(F.sum(F.col("_w") * F.col(f"forward_return_{h}")).alias(f"forward_return_{h}") for h in horizons_of(data, horizons)))
