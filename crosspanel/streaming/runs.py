"""State over a stream: sessions of activity, and runs of suspension; each with its batch twin, which gives the same rows."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

RUNS = "asset string, start date, end date, n long, kind string"
_STATE = "start date, last date, n long, seen date"

#: Kinds of rows: a run of suspension that ended, and a row that came after a later one of its asset and changed nothing.
ENDED, LATE = "ended", "late"


def activity_sessions(events: DataFrame, key: str, time: str, value: str, gap: str = "30 minutes", late: str | None = None) -> DataFrame:
    """key, start, end, n and total of stretches of events of a key with at most `gap` between neighbours; end is `gap` after the last.

    On a stream, `late` is how long a session is kept open for events that come late (a watermark); what comes later
    still is left out and counted by the query's progress (`numRowsDroppedByWatermark`); events are judged by the
    watermark of the batch before. Sessions come out once they are final, in append mode.
    """
    rows = events.where(F.col(key).isNotNull() & F.col(time).isNotNull())
    if late is not None:
        rows = rows.withWatermark(time, late)
    found = rows.groupBy(key, F.session_window(time, gap).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return found.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "total")


def suspension_runs(panel: DataFrame) -> DataFrame:
    """asset, start, end, n, kind: runs of rows without volume of each asset (date, asset, volume), once a row with volume ends them.

    A run still open has no row. Of rows with one date and asset the one with the most volume counts.
    """
    rows = panel.groupBy("asset", "date").agg(F.max(F.coalesce("volume", F.lit(0.0))).alias("volume")).where("date IS NOT NULL")
    w = Window.partitionBy("asset").orderBy("date")
    rows = rows.withColumn("_idle", F.col("volume") <= 0).withColumn("_run", F.sum((~F.col("_idle")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    last = F.max(F.when(~F.col("_idle"), F.col("date"))).over(Window.partitionBy("asset"))
    runs = rows.withColumn("_last", last).where("_idle").groupBy("asset", "_run").agg(F.min("date").alias("start"), F.max("date").alias("end"), F.count(F.lit(1)).alias("n"), F.first("_last").alias("_last"))
    return runs.where("end < _last").select("asset", "start", "end", "n", F.lit(ENDED).alias("kind"))


def streamed_suspension_runs(stream: DataFrame) -> DataFrame:
    """The same over a stream that brings each asset's dates in order, in append mode; a row of an earlier date is reported as late.

    State is four values an asset, however long the stream; a date that comes again in a later batch is late, too.
    """

    def follow(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start, last, n, seen = state.get if state.exists else (None, None, 0, None)
        out = []
        rows = pd.concat(list(frames)).dropna(subset=["date"])
        rows = rows.assign(volume=rows["volume"].fillna(0.0)).groupby("date", as_index=False)["volume"].max().sort_values("date")
        for date, volume in zip(rows["date"], rows["volume"], strict=True):
            if seen is not None and date <= seen:
                out.append((key[0], date, date, 1, LATE))
                continue
            seen = date
            if volume <= 0:
                start, last, n = (date if n == 0 else start), date, n + 1
            elif n:
                out.append((key[0], start, last, n, ENDED))
                start, last, n = None, None, 0
        state.update((start, last, n, seen))
        yield pd.DataFrame(out, columns=["asset", "start", "end", "n", "kind"])

    rows = stream.select("asset", "date", F.col("volume").cast("double").alias("volume"))
    return rows.groupBy("asset").applyInPandasWithState(follow, RUNS, _STATE, "append", GroupStateTimeout.NoTimeout)
