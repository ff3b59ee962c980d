"""Cross-sectional preparation of a factor: rows stay, missing stays missing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from crosspanel.functions.normal_equations import finite, fitted
from crosspanel.functions.order_statistics import counted_ranks, quantiles
from crosspanel.functions.xsec import average_rank
from crosspanel.operators.contracts import KEYS, fail


class PreprocessLog:
    """What each step did, counted in the pass that reads its result: rows, values changed, sections left as they were.

    Give it to the steps, run whatever job the panel is for, then ask: the numbers are those of the first job over it.
    """

    COLUMNS = "step string, n_rows long, n_changed long, n_skipped_sections long"

    def __init__(self) -> None:
        self.steps: list[tuple[str, Observation]] = []

    def watch(self, df: DataFrame, step: str, before: Column, after: Column, skipped: Column) -> DataFrame:
        """`skipped` holds in rows of a section that the step leaves out; sections are dates, so a set of them is small."""
        seen = Observation()
        self.steps.append((step, seen))
        metrics = [F.count(F.lit(1)).alias("n_rows"), F.count_if(~before.eqNullSafe(after)).alias("n_changed"), F.size(F.collect_set(F.when(skipped, F.col("date")))).alias("n_skipped")]
        return df.observe(seen, *metrics)

    def rows(self) -> list[tuple[str, int, int, int]]:
        """step, n_rows, n_changed, n_skipped_sections, in order; waits for the first job."""
        return [(step, found["n_rows"], found["n_changed"], found["n_skipped"]) for step, found in ((step, seen.get) for step, seen in self.steps)]

    def frame(self, spark: SparkSession) -> DataFrame:
        """The same as a table; empty without steps."""
        return spark.createDataFrame(self.rows(), self.COLUMNS)


def _put(panel: DataFrame, column: str, new: str, skipped: str, log: PreprocessLog | None, step: str, columns: list[str]) -> DataFrame:
    """The panel with `column` taken from `new`, and the step logged."""
    if log is not None:
        panel = log.watch(panel, step, F.col(column), F.col(new), F.col(skipped))
    return panel.select(*(F.col(new).alias(column) if c == column else F.col(c) for c in columns))


def winsorize(
    panel: DataFrame, column: str = "factor", method: str = "mad", n: float = 3.0, limits: tuple[float, float] = (0.01, 0.99), by_date: bool = True, log: PreprocessLog | None = None,
) -> DataFrame:
    """Clip to median +- n * 1.4826 * MAD, to mean +- n standard deviations, or to linear quantiles, section by section.

    With by_date=False, over the whole table: its bounds are aggregates of one row, looked up by every row.
    """
    if method not in ("mad", "sigma", "quantile"):
        fail("preprocess", "bad_method", f"{method!r} is none of mad, sigma, quantile")
    x = F.col(column)
    if not by_date:
        low, high = _pooled_bounds(panel, column, method, n, limits)
        pooled = panel.withColumns({"_new": F.when(x.isNotNull() & low.isNotNull(), F.greatest(low, F.least(high, x))).otherwise(x), "_skipped": low.isNull()})
        return _put(pooled, column, "_new", "_skipped", log, "winsorize", panel.columns)
    w = Window.partitionBy("date")
    if method == "mad":
        df = panel.withColumn("_mid", F.percentile(x, F.lit(0.5)).over(w))
        df = df.withColumn("_half", F.percentile(F.abs(x - F.col("_mid")), F.lit(0.5)).over(w) * 1.4826 * n)
    elif method == "sigma":
        df = panel.withColumn("_mid", F.avg(x).over(w)).withColumn("_half", F.stddev_samp(x).over(w) * n)
    else:
        q = F.percentile(x, F.array(F.lit(limits[0]), F.lit(limits[1]))).over(w)
        df = panel.withColumn("_q", q).withColumn("_mid", (F.col("_q")[0] + F.col("_q")[1]) / 2).withColumn("_half", (F.col("_q")[1] - F.col("_q")[0]) / 2)
    low, high = (F.col("_q")[0], F.col("_q")[1]) if method == "quantile" else (F.col("_mid") - F.col("_half"), F.col("_mid") + F.col("_half"))
    usable = (F.count(x).over(w) >= 2) & (F.lit(True) if method == "quantile" else F.col("_half") > 0)
    clipped = F.when(x.isNotNull(), F.greatest(low, F.least(high, x)))
    df = df.withColumn("_usable", F.coalesce(usable, F.lit(False))).withColumns({"_new": F.when(F.col("_usable"), clipped).otherwise(x), "_skipped": ~F.col("_usable")})
    return _put(df, column, "_new", "_skipped", log, "winsorize", panel.columns)


def _pooled_bounds(panel: DataFrame, column: str, method: str, n: float, limits: tuple[float, float]) -> tuple[Column, Column]:
    """Bounds of the whole column as constants, missing where it isn't to be clipped: two values, whatever the table's size."""
    x = F.col(column)
    if method == "quantile":
        found = quantiles(panel, column, [], {"low": limits[0], "high": limits[1]}).first()
        size = panel.agg(F.count(x)).first()[0]
        low, high = (found["low"], found["high"]) if size >= 2 else (None, None)
    else:
        if method == "mad":
            mid = quantiles(panel, column, [], {"mid": 0.5}).first()["mid"]
            off = panel.select(F.abs(x - F.lit(mid).cast("double")).alias("off"))
            size, half = panel.agg(F.count(x)).first()[0], quantiles(off, "off", [], {"half": 0.5}).first()["half"]
            half = None if half is None else half * 1.4826 * n
        else:
            size, mid, sd = panel.agg(F.count(x), F.avg(x), F.stddev_samp(x)).first()
            half = None if sd is None else sd * n
        low, high = (mid - half, mid + half) if size >= 2 and half and half > 0 else (None, None)
    return F.lit(low).cast("double"), F.lit(high).cast("double")


def standardize(panel: DataFrame, column: str = "factor", method: str = "zscore", by_date: bool = True, log: PreprocessLog | None = None) -> DataFrame:
    """zscore (a constant section stays), rank ((average rank - 0.5) / n) or demean, section by section or over the whole table."""
    if method not in ("zscore", "rank", "demean"):
        fail("preprocess", "bad_method", f"{method!r} is none of zscore, rank, demean")
    x = F.col(column)
    if not by_date:
        if method == "rank":
            places = counted_ranks(panel, column, []).select(F.col(column).alias("_v"), ((F.col("_lo") + F.col("_c") / 2) / F.col("_n")).alias("_new"))
            df = panel.join(places, x == F.col("_v"), "left").withColumn("_skipped", F.lit(False))
        else:
            mean, sd = panel.agg(F.avg(x), F.stddev_samp(x)).first()
            new = x - F.lit(mean).cast("double") if method == "demean" else (x - mean) / sd if sd else x
            df = panel.withColumns({"_new": new, "_skipped": F.lit(method == "zscore" and not sd)})
        return _put(df, column, "_new", "_skipped", log, "standardize", panel.columns)
    keys = ["date"]
    w = Window.partitionBy(*keys)
    if method == "zscore":
        df = panel.withColumn("_sd", F.stddev_samp(x).over(w)).withColumn("_m", F.avg(x).over(w)).withColumn("_skipped", ~F.coalesce(F.col("_sd") > 0, F.lit(False)))
        df = df.withColumn("_new", F.when(~F.col("_skipped"), (x - F.col("_m")) / F.col("_sd")).otherwise(x))
    elif method == "rank":
        df = average_rank(panel, column, keys, "_r").withColumn("_size", F.count(x).over(w)).withColumns({"_new": (F.col("_r") - 0.5) / F.col("_size"), "_skipped": F.col("_size") == 0})
    else:
        df = panel.withColumn("_m", F.avg(x).over(w)).withColumns({"_new": x - F.col("_m"), "_skipped": F.col("_m").isNull()})
    return _put(df, column, "_new", "_skipped", log, "standardize", panel.columns)


def neutralize(
    panel: DataFrame, column: str = "factor", exposures: list[str] | None = None, groups: str | None = None, min_obs: int = 10, log: PreprocessLog | None = None,
) -> DataFrame:
    """Take out group means, or the least-squares fit on exposures, section by section.

    A row without a group, or without some exposure, becomes missing; so does a section with too few rows. The fit is
    worked out from each section's cross products and looked up by date, so rows are not shipped for it. An exposure
    that others explain adds nothing.
    """
    if groups:
        x = F.col(column) - F.avg(column).over(Window.partitionBy("date", groups))
        within = panel.withColumns({"_new": F.when(F.col(groups).isNotNull(), x), "_skipped": F.lit(False)})
        panel = _put(within, column, "_new", "_skipped", log, "neutralize_groups", panel.columns)
    if not exposures:
        return panel
    fits = fitted(panel, ["date"], column, exposures)
    fits = fits.select(F.col("date").alias("_date"), F.col("n").alias("_n"), F.col("a").alias("_a"), F.col("b").alias("_b"))
    enough = F.coalesce(F.col("_n") >= max(min_obs, len(exposures) + 2), F.lit(False))
    fit, there = F.col("_a"), finite(F.col(column)) & enough
    for i, e in enumerate(exposures):
        fit, there = fit + F.get("_b", F.lit(i)) * F.col(e), there & finite(F.col(e))
    found = panel.join(fits, F.col("date") == F.col("_date"), "left")
    found = found.withColumns({"_new": F.when(there, F.col(column) - fit), "_skipped": ~enough})
    return _put(found, column, "_new", "_skipped", log, "neutralize_exposures", panel.columns)


def orthogonalize(panel: DataFrame, column: str, others: list[str], min_obs: int = 10) -> DataFrame:
    """What of a factor other factors don't explain."""
    return neutralize(panel, column, others, min_obs=min_obs)


def combine(factors: dict[str, DataFrame], weights: dict[str, float] | None = None, standardize_first: bool = True, min_obs: int | None = None) -> DataFrame:
    """Weighted sum of factors (date, asset, factor), standardised before and after.

    A row needs `min_obs` of them, by default all but one, and is missing below that; what is missing adds nothing.
    """
    names = list(factors)
    weights = weights or {n: 1.0 for n in names}
    total = sum(weights[n] for n in names)
    if not total:
        fail("preprocess", "bad_weights", "the weights sum to 0")
    parts = []
    for n in names:
        p = factors[n].select(*KEYS, "factor")
        parts.append((standardize(p) if standardize_first else p).withColumnRenamed("factor", n))
    joined = reduce(lambda a, b: a.join(b, KEYS, "full_outer"), parts)
    there = sum(F.col(n).isNotNull().cast("int") for n in names)
    value = sum(F.coalesce(F.col(n), F.lit(0.0)) * (weights[n] / total) for n in names)
    mixed = joined.withColumn("factor", F.when(there >= (max(1, len(names) - 1) if min_obs is None else min_obs), value)).select(*KEYS, "factor")
    return standardize(mixed)
