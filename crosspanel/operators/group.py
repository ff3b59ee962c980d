"""The factor within groups: IC by group, its weighting and its consistency."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crosspanel.functions.xsec import average_rank, both, correlation, horizons_of, stacked
from crosspanel.operators.contracts import fail
from crosspanel.operators.ic import information_coefficient


def series_stats(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, n_periods, mean, median, std, icir, positive_rate of a per-period value."""
    x = F.col(value)
    out = df.groupBy(*keys).agg(
        F.count(x).alias("n_periods"), F.avg(x).alias("mean"), F.median(x).alias("median"), F.stddev_samp(x).alias("std"), F.avg((x > 0).cast("double")).alias("positive_rate")
    )
    return out.withColumn("icir", F.try_divide("mean", "std"))


def grouped_ic(data: DataFrame, by: str, horizons: list[int] | None = None, method: str = "spearman", min_group_size: int = 5) -> DataFrame:
    """date, group, horizon, ic, n, reason: IC within each group; too small or constant ones have a reason instead."""
    if min_group_size < 3:
        fail("group", "bad_min_group_size", "a correlation needs at least 3")
    df = data.where(F.col(by).isNotNull()).withColumnRenamed(by, "group")
    ic = information_coefficient(df, horizons, method, keys=["group"])
    small = F.col("n") < min_group_size
    reason = F.when(small, "too_small").when(F.col("ic").isNull(), "constant")
    return ic.withColumn("reason", reason).withColumn("ic", F.when(~small, F.col("ic")))


def skipped_groups(ic: DataFrame) -> DataFrame:
    """group, horizon, reason, n of the cells without an IC."""
    return ic.where("reason is not null").groupBy("group", "horizon", "reason").agg(F.count("*").alias("n"))


def grouped_summary(ic: DataFrame) -> DataFrame:
    """Statistics over time by group and horizon."""
    return series_stats(ic, ["group", "horizon"], "ic")


def ic_rollup(ic: DataFrame) -> DataFrame:
    """horizon, group, level and the statistics of the ICs of a group (level 0), of all groups of a horizon (1) and of all (2).

    NULL stands for what is pooled. One aggregation with ROLLUP.
    """
    x = F.col("ic")
    out = ic.rollup("horizon", "group").agg(
        (F.grouping("horizon") + F.grouping("group")).cast("int").alias("level"), F.count(x).alias("n_cells"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"),
        F.avg((x > 0).cast("double")).alias("positive_rate"), F.count_if(F.col("reason").isNotNull()).alias("n_skipped"),
    )
    return out.withColumn("icir", F.try_divide("mean", "std"))


def grouped_frame(ic: DataFrame, value: str = "mean") -> DataFrame:
    """horizon against group: one statistic over time of each cell. The groups are the ones that are there, a column each."""
    summary = grouped_summary(ic)
    names = sorted(r["group"] for r in summary.select("group").distinct().collect())
    return summary.groupBy("horizon").pivot("group", names).agg(F.first(value))


def weighted_ic(ic: DataFrame) -> DataFrame:
    """date, horizon, ic: group ICs weighted by their pairs, over the groups that have one."""
    there = F.col("ic").isNotNull()
    return ic.groupBy("date", "horizon").agg(F.try_divide(F.sum(F.col("ic") * F.col("n")), F.sum(F.when(there, F.col("n")))).alias("ic"))


def within_group_rank_ic(data: DataFrame, by: str, horizons: list[int] | None = None) -> DataFrame:
    """date, horizon, ic: correlation over the whole section of ranks taken within groups."""
    df, asked = data.where(F.col(by).isNotNull()), []
    horizons = horizons_of(data, horizons)
    for h in horizons:
        x, y = both(F.col("factor"), F.col(f"forward_return_{h}"))
        df = df.withColumns({f"_x{h}": x, f"_y{h}": y})
        df = average_rank(average_rank(df, f"_x{h}", ["date", by], f"_rx{h}"), f"_y{h}", ["date", by], f"_ry{h}")
        asked.append(correlation(F.col(f"_rx{h}"), F.col(f"_ry{h}")).alias(f"_ic{h}"))
    return stacked(df.groupBy("date").agg(*asked), ["date"], {"ic": {h: f"_ic{h}" for h in horizons}}, "horizon")


def group_consistency(ic: DataFrame, overall: DataFrame) -> DataFrame:
    """group, horizon: sign of the mean IC, and how often a period's sign agrees with it and with the overall IC's."""
    both_ = ic.where("ic is not null").join(overall.select("date", "horizon", F.col("ic").alias("all_ic")), ["date", "horizon"])
    means = both_.groupBy("group", "horizon").agg(F.avg("ic").alias("mean"), F.avg("all_ic").alias("mean_all"))
    met = both_.join(means, ["group", "horizon"])
    same = (F.signum("ic") == F.signum("mean")).cast("double")
    alike = (F.signum("ic") == F.signum("all_ic")).cast("double")
    return met.groupBy("group", "horizon").agg(F.first("mean").alias("mean"), F.signum(F.first("mean")).alias("sign"), F.avg(same).alias("same_sign_rate"), F.avg(alike).alias("sign_vs_global_rate"))


def across_groups(consistency: DataFrame) -> DataFrame:
    """horizon: spread of group means, and the share of groups on the majority's side."""
    up = F.avg((F.col("sign") > 0).cast("double"))
    return consistency.groupBy("horizon").agg(F.count("*").alias("n_groups"), F.stddev_samp("mean").alias("dispersion"), F.greatest(up, 1 - up).alias("agreement"))


def apply_by_date(data: DataFrame, function, schema: str, keys: list[str] | None = None, min_size: int = 1) -> DataFrame:
    """A Python function of each (date, keys) section, a pandas frame in and out; sections that are too small are left out."""
    keys = ["date", *(keys or [])]
    return data.groupBy(*keys).applyInPandas(lambda section: function(section) if len(section) >= min_size else function(section.head(0)), schema)
