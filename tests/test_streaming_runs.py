"""Streams against their batch twins, with rows that come late."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from crosspanel.streaming import runs

DAY = dt.date(2024, 1, 1)


def streamed(spark, make, files, schema, path, name, **options):
    """The rows that a stream over some files, one a batch, gives, and its progress."""
    for i, rows in enumerate(files):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{path}/in")
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in")
    query = make(source).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    query.awaitTermination(180)
    return sorted(map(tuple, spark.table(name).collect()), key=str), query.recentProgress


def test_streamed_runs_of_suspension_equal_batch(spark, tmp_path):
    rng = random.Random(3)
    rows = [(DAY + dt.timedelta(d), f"{a:02d}", None if rng.random() < 0.1 else float(rng.random() < 0.5)) for d in range(40) for a in range(6)]
    schema = "date date, asset string, volume double"
    files = [[r for r in rows if lo <= (r[0] - DAY).days < lo + 10] for lo in range(0, 40, 10)]
    got, _ = streamed(spark, runs.streamed_suspension_runs, files, schema, tmp_path, "runs_all")
    want = sorted(map(tuple, runs.suspension_runs(spark.createDataFrame(rows, schema)).collect()), key=str)
    assert got == want and len(want) > 30 and {r[4] for r in got} == {runs.ENDED}


def test_a_late_row_changes_nothing_and_is_told(spark, tmp_path):
    on = lambda d, v, a="x": (DAY + dt.timedelta(d), a, v)
    files = [[on(0, 1.0), on(1, 0.0), on(2, 0.0)], [on(1, 5.0), on(3, 0.0), (None, "x", 1.0)], [on(4, 2.0), on(5, 0.0)]]
    got, _ = streamed(spark, runs.streamed_suspension_runs, files, "date date, asset string, volume double", tmp_path, "runs_late")
    assert got == sorted([("x", DAY + dt.timedelta(1), DAY + dt.timedelta(3), 3, "ended"), ("x", DAY + dt.timedelta(1), DAY + dt.timedelta(1), 1, "late")], key=str)
    batch = runs.suspension_runs(spark.createDataFrame([on(0, 1.0), on(1, 0.0), on(1, 5.0), on(2, 0.0), on(3, None)], "date date, asset string, volume double"))
    assert batch.count() == 0  # the day that has a row with volume is not idle, and the run after it is still open


def test_streamed_sessions_equal_batch_and_late_events_are_counted(spark, tmp_path):
    at = lambda minutes: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minutes)
    schema = "user string, ts timestamp, value double"
    first = [("a", at(0), 1.0), ("a", at(30), 2.0), ("b", at(5), 3.0), ("a", at(61), 4.0)]
    second = [("a", at(300), 5.0), ("b", at(290), 1.0), (None, at(291), 9.0)]
    third, fourth = [("a", at(900), 7.0)], [("a", at(10), 100.0), ("b", at(880), 2.0)]  # the first of the fourth is hours late, the second is not
    make = lambda df: runs.activity_sessions(df, "user", "ts", "value", late="1 hour")
    got, progress = streamed(spark, make, [first, second, third, fourth, [("a", at(2000), 0.0)]], schema, tmp_path, "sessions")
    kept = spark.createDataFrame([*first, *second, *third, fourth[1]], schema)
    want = sorted(map(tuple, runs.activity_sessions(kept, "user", "ts", "value").collect()), key=str)
    assert got == want and [r for r in got if r[0] == "a"][0][3] == 2  # 31 minutes apart are two sessions
    assert sum(int(o["numRowsDroppedByWatermark"]) for p in progress for o in p["stateOperators"]) == 1


@pytest.mark.parametrize("rows", [[], [(DAY, "a", 0.0)]])
def test_runs_of_nothing(spark, rows):
    assert runs.suspension_runs(spark.createDataFrame(rows, "date date, asset string, volume double")).count() == 0
    assert runs.activity_sessions(spark.createDataFrame([], "k string, t timestamp, v double"), "k", "t", "v").select(F.count("*")).first()[0] == 0
