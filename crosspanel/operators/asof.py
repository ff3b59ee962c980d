"""Joins in time: as-of, interval, and resampling to period ends."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crosspanel.operators.calendars import days_of, position_after, session


def asof_backward(
    left: DataFrame, right: DataFrame, by: list[str], left_on: str, right_on: str, values: list[str], most_days: int | None = None, stretch: int = 32,
) -> DataFrame:
    """Each left row with the latest right row of its key at or before its time: what was known then.

    A key's time is cut into stretches of `stretch` days. The last right row of each stretch is carried into the next
    ones that hold left rows, after which every (key, stretch) is a running last value of its own: one shuffle of all
    rows, no range join, and a key of any size is spread over its stretches. Of several right rows at one time the one
    with the greatest values counts; right rows without a time never match. Values older than `most_days` are dropped.
    """
    held = lambda t: F.floor(F.unix_date(t) / stretch).alias("_part")
    l = left.select(*by, F.col(left_on).cast("date").alias("_t"), F.lit(1).alias("_side"), F.struct("*").alias("_row"))
    r = right.select(*by, F.col(right_on).cast("date").alias("_t"), F.lit(0).alias("_side"), F.struct(F.col(right_on).cast("date").alias("_at"), F.struct(*values).alias("_v")).alias("_own"))
    r = r.where("_t IS NOT NULL")
    both = l.unionByName(r, allowMissingColumns=True).withColumn("_part", held(F.col("_t")))
    # what a (key, stretch) starts with: the last right row of the key's stretches before it; a row for each of them
    ends = l.select(*by, held(F.col("_t")), F.lit(None).cast(r.schema["_own"].dataType).alias("_own")).unionByName(r.select(*by, held(F.col("_t")), "_own"))
    ends = ends.groupBy(*by, "_part").agg(F.max("_own").alias("_own"))
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.withColumn("_own", F.last("_own", ignorenulls=True).over(before)).where("_own IS NOT NULL")
    both = both.unionByName(carried.select(*by, "_part", "_own", F.col("_own._at").alias("_t"), F.lit(0).alias("_side")), allowMissingColumns=True)
    w = Window.partitionBy(*by, "_part").orderBy("_t", "_side", F.col("_own").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("_last", F.last("_own", ignorenulls=True).over(w)).where("_side = 1")
    fresh = F.lit(True) if most_days is None else F.datediff("_t", "_last._at") <= most_days
    return both.select("_row.*", *(F.when(fresh, F.col(f"_last._v.{v}")).alias(v) for v in values), F.when(fresh, F.col("_last._at")).alias(f"{right_on}_matched"))


def first_session_after(df: DataFrame, calendar: DataFrame, date: str, out: str) -> DataFrame:
    """Add the first session strictly after a date; NULL after the last."""
    days = days_of(calendar)
    return df.withColumn(out, session(days, position_after(days, F.col(date))))


#: Days from year 1 to year 9999 fit into 2 ** LEVELS; the first of them in days from 1970.
LEVELS, FIRST_DAY = 22, -719_528


def blocks_of_span(start: Column, end: Column) -> Column:
    """The aligned blocks of 1, 2, 4, ... days that together are the days from `start` to `end`, two of each size at most."""

    def two(level: Column) -> Column:
        size = F.pow(F.lit(2.0), level)
        first, beyond = F.ceil((start - FIRST_DAY) / size), F.floor((end + 1 - FIRST_DAY) / size)
        block = lambda odd, at: F.when((first < beyond) & (odd % 2 == 1), F.struct(level.alias("level"), at.alias("block")))
        return F.array(block(first, first), block(beyond, beyond - 1))

    return F.array_compact(F.flatten(F.transform(F.sequence(F.lit(0), F.lit(LEVELS)), two)))


def blocks_around(day: Column, longest: Column | None = None) -> Column:
    """The aligned blocks that hold a day, of all sizes or of those that a span of at most `longest` days can have."""
    last = F.lit(LEVELS) if longest is None else F.floor(F.log2(longest.cast("double"))).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda level: F.struct(level.alias("level"), F.floor((day - FIRST_DAY) / F.pow(F.lit(2.0), level)).alias("block")))


def interval_join(left: DataFrame, spans: DataFrame, by: list[str], on: str, start: str, end: str, values: list[str]) -> DataFrame:
    """Each left row with the span of its key that is valid at its time (open ends last for ever); the latest start wins.

    What holds of a key changes only where a span starts or has ended. A span falls into two aligned blocks of days of
    each size at most, a day lies in one of each; so the spans that hold at a change are found by equality of blocks, of
    which each keeps its latest span. Work and space follow the number of spans, however many of them overlap. What
    holds at a left row's time is then an as-of match, so left rows are neither numbered nor multiplied. Of spans with
    one start the one with the greatest values counts.
    """
    last = F.lit("9999-12-30").cast("date")
    s = spans.select(*by, F.col(start).cast("date").alias("_from"), F.least(F.coalesce(F.col(end).cast("date"), last), last).alias("_to"), F.struct(*values).alias("_v"))
    s = s.where("_from <= _to")
    blocks = s.select(*by, F.explode(blocks_of_span(F.unix_date("_from"), F.unix_date("_to"))).alias("_b"), F.struct("_from", "_v").alias("_span"))
    latest = blocks.groupBy(*by, "_b").agg(F.max("_span").alias("_span"))
    changes = s.select(*by, F.explode(F.array(F.col("_from"), F.date_add("_to", 1))).alias("_at")).distinct()
    longest = s.agg((F.max(F.datediff("_to", "_from")) + 1).alias("_longest"))  # one row
    around = changes.join(F.broadcast(longest)).withColumn("_b", F.explode(blocks_around(F.unix_date("_at"), F.col("_longest")))).drop("_longest")
    # a change without a span, too, is a step: to nothing
    held = around.join(latest, [*by, "_b"], "left").groupBy(*by, "_at").agg(F.max("_span").alias("_best"))
    steps = held.select(*by, "_at", *(F.col(f"_best._v.{v}").alias(v) for v in values))
    return asof_backward(left, steps, by, on, "_at", values).drop("_at_matched")


def month_end_sessions(calendar: DataFrame) -> DataFrame:
    """The last session of each month."""
    return calendar.groupBy(F.date_trunc("month", "date").cast("date").alias("month")).agg(F.max("date").alias("date"))


def resample_month_end(panel: DataFrame, calendar: DataFrame) -> DataFrame:
    """Rows of a panel on month-end sessions."""
    return panel.join(F.broadcast(month_end_sessions(calendar).select("date")), "date", "left_semi")


def latest_version(df: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Of several rows of a key, the one of the latest version."""
    w = Window.partitionBy(*keys).orderBy(F.desc(version))
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def spread(df: DataFrame, rows: list[str], column: str, names: list[str], value: str) -> DataFrame:
    """One row of each key `rows`, with a column for each of the values of `column` that are stated."""
    return df.groupBy(*rows).pivot(column, names).agg(F.first(value))


def to_wide(panel: DataFrame, value: str, assets: list[str]) -> DataFrame:
    """date x asset, for a stated list of assets."""
    return spread(panel, ["date"], "asset", assets, value)


def to_long(wide: DataFrame, value: str) -> DataFrame:
    """date, asset, value from a wide table; missing cells are left out."""
    names = [c for c in wide.columns if c != "date"]
    return wide.unpivot("date", names, "asset", value).where(F.col(value).isNotNull())
