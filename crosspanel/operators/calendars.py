"""Trading calendars: a table (date, pos). Arithmetic is a look-up, never a guess from a frequency.

Calendars have one row a session, tens of thousands over a century. They are worked out once and kept as local tables;
session numbers of dates and dates of session numbers come from a constant array, without a join.
"""

from __future__ import annotations

import datetime as dt
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crosspanel.operators.contracts import fail


def from_dates(dates: DataFrame) -> DataFrame:
    """Calendar from a table with a `date` column; repeated dates count once."""
    days = dates.select(F.col("date").cast("date").alias("date")).where(F.col("date").isNotNull()).distinct()
    found = sorted(r.date for r in days.collect())
    table = pa.table({"date": pa.array(found, pa.date32()), "pos": pa.array(range(len(found)), pa.int32())})
    return dates.sparkSession.createDataFrame(table)


def days_of(calendar: DataFrame) -> list[dt.date]:
    """The sessions in order; no job where the calendar is a local table."""
    return sorted(r.date for r in calendar.select("date").collect())


def _constant(values: list[int]) -> Column:
    """A constant array of whole numbers, -1 for none."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<int>")


def position(days: list[dt.date], date: Column) -> Column:
    """The session number of a date; NULL off the calendar."""
    if not days:
        return F.lit(None).cast("int")
    numbers = [-1] * ((days[-1] - days[0]).days + 1)
    for at, day in enumerate(days):
        numbers[(day - days[0]).days] = at
    return F.nullif(F.get(_constant(numbers), F.datediff(date, F.lit(days[0]))), F.lit(-1))


def session(days: list[dt.date], pos: Column) -> Column:
    """The date of a session number; NULL off the calendar."""
    if not days:
        return F.lit(None).cast("date")
    return F.date_from_unix_date(F.get(_constant([(x - dt.date(1970, 1, 1)).days for x in days]), pos.cast("int")))


def position_after(days: list[dt.date], date: Column) -> Column:
    """The number of the first session strictly after a date; NULL after the last."""
    if not days:
        return F.lit(None).cast("int")
    numbers, at = [], 0
    for n in range((days[-1] - days[0]).days):
        at += (days[at] - days[0]).days <= n
        numbers.append(at)
    since = F.datediff(date, F.lit(days[0]))
    return F.when(since < 0, 0).otherwise(F.get(_constant(numbers or [-1]), since)) if numbers else F.when(since < 0, 0)


def from_panels(*panels: DataFrame) -> DataFrame:
    """Calendar of all dates that any of the panels has."""
    return from_dates(reduce(DataFrame.unionByName, [p.select("date").distinct() for p in panels]))


def with_pos(df: DataFrame, calendar: DataFrame, date: str = "date", pos: str = "pos") -> DataFrame:
    """Add the session number of a date; NULL off the calendar."""
    return df.withColumn(pos, position(days_of(calendar), F.col(date)))


def shift_dates(df: DataFrame, calendar: DataFrame, n: int, date: str, out: str) -> DataFrame:
    """Add the date n sessions on: the date must be a session itself, else (or out of range) NULL."""
    days = days_of(calendar)
    return df.withColumn(out, session(days, position(days, F.col(date)) + n))


def shift(calendar: DataFrame, day, n: int):
    """The session n on from a day. Off the calendar, n > 0 counts from the last session before it, n < 0 from the first after."""
    if n == 0:
        return day
    side = calendar.where(F.col("date") <= F.lit(day)) if n > 0 else calendar.where(F.col("date") >= F.lit(day))
    pos = side.agg((F.max if n > 0 else F.min)("pos").alias("p")).first().p
    if pos is None:
        return None
    found = calendar.where(F.col("pos") == pos + n).first()
    return found.date if found else None


def next_session(calendar: DataFrame, day):
    """The first session after a day."""
    return calendar.where(F.col("date") > F.lit(day)).agg(F.min("date").alias("d")).first().d


def previous_session(calendar: DataFrame, day):
    """The last session before a day."""
    return calendar.where(F.col("date") < F.lit(day)).agg(F.max("date").alias("d")).first().d


def between(calendar: DataFrame, start, end) -> DataFrame:
    """Sessions of a closed range."""
    return calendar.where(F.col("date").between(F.lit(start), F.lit(end)))


def sessions(calendar: DataFrame, start, end) -> int:
    """Number of sessions of a closed range."""
    return between(calendar, start, end).count()


def contains(calendar: DataFrame, day) -> bool:
    """Whether a day is a session."""
    return bool(calendar.where(F.col("date") == F.lit(day)).limit(1).count())


def validate_dates(df: DataFrame, calendar: DataFrame, contract: str = "Calendar") -> DataFrame:
    """The table itself, if all its dates are sessions."""
    off = df.select("date").distinct().join(F.broadcast(calendar.select("date")), "date", "left_anti").orderBy("date").limit(3).collect()
    if off:
        fail(contract, "off_calendar", "; ".join(str(r.date) for r in off))
    return df
