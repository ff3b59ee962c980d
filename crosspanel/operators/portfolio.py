"""Return series of portfolios: equity curves, summaries, turnover cost, and in-sample splits."""

from __future__ import annotations

import datetime as dt
from bisect import bisect_left
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crosspanel.operators.contracts import fail


def cumulative_returns(returns: DataFrame, column: str = "ret", keys: list[str] | None = None) -> DataFrame:
    """Add equity, the running product of 1 + return; a missing return counts as 0. One row a period, so one task a series."""
    w = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return returns.withColumn("equity", F.product(1 + F.coalesce(column, F.lit(0.0))).over(w))


def periods_per_year(dates: list[dt.date]) -> float | None:
    """From the median gap in days: 252 for daily, else by days a year; None for fewer than three dates."""
    days = sorted(set(dates))
    if len(days) < 3:
        return None
    gaps = sorted((b - a).days for a, b in zip(days, days[1:], strict=False))
    mid = len(gaps) // 2
    gap = gaps[mid] if len(gaps) % 2 else (gaps[mid - 1] + gaps[mid]) / 2
    return 252.0 if gap <= 1 else float(round(252 / gap)) if gap <= 4 else float(round(365 / gap))


def portfolio_summary(returns: DataFrame, column: str = "ret", keys: list[str] | None = None, per_year: float | None = None) -> DataFrame:
    """keys, n, total, annual, vol, sharpe, max_drawdown, win_rate, mean, periods_per_year of return series (date, ret)."""
    keys = keys or []
    if per_year is None:
        per_year = periods_per_year([r.date for r in returns.select("date").distinct().collect()])
    df = cumulative_returns(returns, column, keys)
    w = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("_peak", F.greatest(F.lit(1.0), F.max("equity").over(w)))
    df = df.withColumn("_drop", F.col("equity") / F.col("_peak") - 1)
    x = F.col(column)
    asked = [F.count(x).alias("n"), (F.max_by("equity", "date") - 1).alias("total"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"),
             F.min("_drop").alias("max_drawdown"), F.avg((x > 0).cast("double")).alias("win_rate")]
    out = df.groupBy(*keys).agg(*asked) if keys else df.agg(*asked)
    p = F.lit(per_year).cast("double")
    annual = F.when(F.col("total") > -1, F.pow(1 + F.col("total"), p / F.col("n")) - 1)
    return out.select(*keys, "n", "total", annual.alias("annual"), (F.col("sd") * F.sqrt(p)).alias("vol"),
                      (F.try_divide("mean", "sd") * F.sqrt(p)).alias("sharpe"), "max_drawdown", "win_rate", "mean", p.alias("periods_per_year"))


def turnover_summary(turnover: DataFrame, cost_bps: float = 15.0) -> DataFrame:
    """factor_quantile, mean turnover, cost of trading it both ways, n."""
    return turnover.groupBy("factor_quantile").agg(F.avg("turnover").alias("turnover"), (F.avg("turnover") * 2 * cost_bps / 1e4).alias("cost"), F.count("turnover").alias("n"))


@dataclass(frozen=True)
class Split:
    """Dates in sample and out of it, and those purged between."""

    in_sample: list[dt.date]
    out_of_sample: list[dt.date]
    purged: list[dt.date]


def split_is_oos(
    dates: list[dt.date], *, ratio: float = 0.7, cut: dt.date | None = None, embargo: int = 0, min_periods: int = 8,
    calendar: list[dt.date] | None = None, purge_horizons: list[int] | None = None, entry_lag: int = 1,
) -> Split:
    """Chronological split at a share or at a date (which is out of sample).

    Purged are `embargo` periods before the cut, or exactly those whose longest holding reaches the cut's session. Where
    too few periods are left, the refusal names the ratios, or the dates of a cut, that would do.
    """
    if embargo and purge_horizons:
        fail("split", "two_purges", "embargo and purge_horizons exclude each other")
    if purge_horizons and not calendar:
        fail("split", "no_calendar", "purging by horizon needs the calendar")
    purge = Purge(sorted(set(dates)), embargo, sorted(set(calendar or [])), max(purge_horizons or [0]) if purge_horizons else None, entry_lag)
    days = purge.days
    if cut is None:
        if not 0 < ratio < 1:
            fail("split", "bad_ratio", f"{ratio} is not between 0 and 1")
        at = int(len(days) * ratio)
        where = days[at] if at < len(days) else None
    else:
        at, where = bisect_left(days, cut), cut
    keep = purge.kept(at, where)
    after = days[at:]
    if len(keep) < min_periods or len(after) < min_periods:
        hint = feasible_ratio_hint(purge, min_periods) if cut is None else feasible_cut_hint(purge, cut, min_periods)
        fail("split", "too_few_periods", f"{len(keep)} in sample and {len(after)} out of it, {min_periods} needed: {hint}")
    return Split(keep, after, [d for d in days[:at] if d not in set(keep)])


@dataclass(frozen=True)
class Purge:
    """Periods, and what of those before a cut overlaps it."""

    days: list[dt.date]
    embargo: int
    calendar: list[dt.date]
    longest: int | None
    entry_lag: int

    def kept(self, at: int, cut: dt.date | None = None) -> list[dt.date]:
        """The periods before number `at` that stay in sample when the cut is at it, or at a date."""
        cut = cut or (self.days[at] if at < len(self.days) else None)
        if self.longest is None:
            return self.days[: max(0, at - self.embargo)]
        edge = len(self.calendar) if cut is None else bisect_left(self.calendar, cut)
        pos = {d: i for i, d in enumerate(self.calendar)}
        return [d for d in self.days[:at] if d in pos and pos[d] + self.entry_lag + self.longest < edge]

    def feasible(self, least: int) -> tuple[int, int] | None:
        """The first and last period that a cut may be at so that `least` periods stay on both sides, or None.

        What stays in sample grows with the cut and what is out of it shrinks, so the first is found by bisection.
        """
        last = len(self.days) - least
        first = bisect_left(range(last + 1), least, key=lambda at: len(self.kept(at))) if last >= 0 else last + 1
        return (first, last) if first <= last else None


def feasible_ratio_hint(purge: Purge, min_periods: int) -> str:
    """The ratios that leave enough periods on both sides after purging."""
    found, n = purge.feasible(min_periods), len(purge.days)
    if found is None:
        return f"there are too few periods ({n}) for any ratio; a longer sample is needed"
    fits = [r / 100 for r in range(1, 100) if found[0] <= int(n * (r / 100)) <= found[1]]
    if not fits:  # the range is narrower than a hundredth
        return f"a ratio of {(found[0] + 0.5) / n:.4f} does, of {n} periods"
    return f"a ratio from {fits[0]:.2f} to {fits[-1]:.2f} does, of {n} periods"


def feasible_cut_hint(purge: Purge, cut: dt.date, min_periods: int) -> str:
    """The cuts that leave enough periods on both sides after purging."""
    found = purge.feasible(min_periods)
    if found is None:
        return f"there are too few periods ({len(purge.days)}) for any cut; a longer sample is needed"
    return f"a cut from {purge.days[found[0]]} to {purge.days[found[1]]} does, {cut} does not"
