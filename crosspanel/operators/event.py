"""Event studies: complete windows around events, abnormal returns, and their summary over time."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crosspanel.functions.order_statistics import quantiles
from crosspanel.functions.xsec import quantile_bin
from crosspanel.operators.calendars import days_of, position, session
from crosspanel.operators.contracts import KEYS, fail
from crosspanel.operators.inference import nw_summary


@dataclass
class EventWindows:
    """rows: event_id, asset, date, rel_day, rel_date, ret, abn_ret, cum_ret, car; dropped: event_id, reason."""

    rows: DataFrame
    dropped: DataFrame


def align_event_windows(
    prices: DataFrame, events: DataFrame, calendar: DataFrame, window: tuple[int, int] = (-5, 20), base_day: int = 0,
    benchmark: DataFrame | None = None, price: str = "adj_close",
) -> EventWindows:
    """Each event's returns over its window of sessions; only complete windows stay, the rest have a reason.

    Returns are over the asset's row before, never filled; the benchmark (date, price) is filled over the calendar.
    An event becomes one row for each day of its window, so the join with prices is an equality join.
    """
    lo, hi = window
    if not lo <= base_day <= hi:
        fail("event", "bad_window", f"base day {base_day} is outside {window}")
    w = Window.partitionBy("asset").orderBy("date")
    days = days_of(calendar)
    n = len(days)
    own = prices.select(*KEYS, F.col(price).alias("px"), position(days, F.col("date")).alias("pos"))
    own = own.withColumn("ret", F.try_divide(F.col("px"), F.lag("px").over(w)) - 1)
    carried = [c for c in events.columns if c not in (*KEYS, "event_id")]
    ids = events.select(*KEYS, *carried).distinct().withColumn("event_id", F.concat_ws("|", F.col("date").cast("string"), "asset", *(["event_type"] if "event_type" in carried else [])))
    placed = ids.withColumn("pos", position(days, F.col("date")))
    fits = F.col("pos").isNotNull() & (F.col("pos") + lo >= 0) & (F.col("pos") + hi < n)
    off = placed.where(~fits).select("event_id", F.lit("not_on_calendar").alias("reason"))
    spread = placed.where(fits).withColumn("rel_day", F.explode(F.sequence(F.lit(lo), F.lit(hi)))).withColumn("at", F.col("pos") + F.col("rel_day")).drop("pos")
    met = spread.join(own.select("asset", F.col("pos").alias("at"), "ret"), ["asset", "at"], "left")
    met = met.withColumn("rel_date", session(days, F.col("at")))
    if benchmark is not None:
        filled = calendar.join(benchmark.select("date", F.col(price if price in benchmark.columns else "price").alias("b")), "date", "left")
        every = Window.orderBy("pos")  # one row a session
        filled = filled.withColumn("b", F.last("b", ignorenulls=True).over(every.rowsBetween(Window.unboundedPreceding, 0)))
        filled = filled.select(F.col("pos").alias("at"), (F.try_divide(F.col("b"), F.lag("b").over(every)) - 1).alias("bench"))
        met = met.join(F.broadcast(filled), "at", "left").withColumn("abn_ret", F.col("ret") - F.col("bench"))
    else:
        met = met.withColumn("bench", F.lit(0.0)).withColumn("abn_ret", F.col("ret"))
    event = Window.partitionBy("event_id")
    whole = F.count_if(F.col("ret").isNull()).over(event)
    bare = F.count_if(F.col("bench").isNull()).over(event)
    met = met.withColumn("_why", F.when(whole > 0, "missing_price").when(bare > 0, "no_benchmark"))
    lost = met.where("_why is not null").select("event_id", F.col("_why").alias("reason")).distinct()
    run = event.orderBy("rel_day").rowsBetween(Window.unboundedPreceding, 0)
    rows = met.where("_why is null").withColumns({"cum_ret": F.product(1 + F.col("ret")).over(run) - 1, "_cum": F.product(1 + F.col("abn_ret")).over(run) - 1})
    base = F.max(F.when(F.col("rel_day") == base_day, F.col("_cum"))).over(event)
    rows = rows.withColumn("car", F.col("_cum") - base)
    return EventWindows(rows.select("event_id", *KEYS, *carried, "rel_day", "rel_date", "ret", "abn_ret", "cum_ret", "car"), off.unionByName(lost))


def event_summary(windows: DataFrame, value: str = "car", lags: int | None = None) -> DataFrame:
    """rel_day, n, mean, median, hit_rate, std, t_naive, and t_nw over calendar days, on which events cluster."""
    x = F.col(value)
    out = windows.groupBy("rel_day").agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.avg((x > 0).cast("double")).alias("hit_rate"), F.stddev_samp(x).alias("std"))
    middle = quantiles(windows, value, ["rel_day"], {"median": 0.5})
    out = out.join(F.broadcast(middle), "rel_day", "left").withColumn("t_naive", F.try_divide(F.col("mean") * F.sqrt("n"), F.col("std")))
    out = out.select("rel_day", "n", "mean", "median", "hit_rate", "std", "t_naive")
    daily = windows.groupBy("rel_day", F.col("rel_date").alias("date")).agg(F.avg(x).alias("_v"))
    nw = nw_summary(daily, ["rel_day"], "_v", lags=lags).select("rel_day", "t_nw", F.col("n").alias("n_days"))
    return out.join(F.broadcast(nw), "rel_day")


def event_path_by_group(windows: DataFrame, group: str, value: str = "car", quantiles: int | None = None, bins: int = 5) -> DataFrame:
    """group, rel_day, mean, n: the average path by an attribute of the event, cut by quantiles or into equal widths."""
    one = windows.groupBy("event_id").agg(F.first(group).alias("_a"))
    if quantiles:
        one = quantile_bin(one.withColumn("_all", F.lit(0)), "_a", quantiles, ["_all"], "group").drop("_all")
    elif dict(windows.dtypes)[group] != "string":
        ends = one.agg(F.min("_a").cast("double").alias("_lo"), F.max("_a").cast("double").alias("_hi"))
        share = F.try_divide(F.col("_a") - F.col("_lo"), F.col("_hi") - F.col("_lo"))
        one = one.join(F.broadcast(ends)).withColumn("group", F.greatest(F.lit(1), F.ceil(share * bins)).cast("int"))
    else:
        one = one.withColumn("group", F.col("_a"))
    met = windows.join(one.where("group is not null").select("event_id", "group"), "event_id")
    return met.groupBy("group", "rel_day").agg(F.avg(value).alias("mean"), F.count(value).alias("n"))


def path_spread(paths: DataFrame) -> DataFrame:
    """rel_day, spread: the last group's path less the first's."""
    return paths.groupBy("rel_day").agg((F.max_by("mean", "group") - F.min_by("mean", "group")).alias("spread"))
