"""The month folders as a data source: round trips, months skipped, and what a failed write leaves."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from crosspanel.sources import monthly

DAY = dt.date(2023, 11, 20)


@pytest.fixture(scope="module")
def panel(spark):
    monthly.register(spark)
    rows = [(DAY + dt.timedelta(d), f"{a:02d}", d * 10.0 + a, None if a else "x") for d in range(130) for a in range(3)] + [(None, "99", 1.0, "y")]
    return spark.createDataFrame(rows, "date date, asset string, raw_close double, note string").repartition(3)


def rows_of(df):
    return sorted(map(str, df.collect()))


def test_round_trip_and_append(spark, panel, tmp_path):
    path = f"{tmp_path}/panel"
    panel.write.format(monthly.NAME).mode("append").save(path)
    back = spark.read.format(monthly.NAME).load(path)
    assert back.schema == panel.schema and rows_of(back) == rows_of(panel)
    assert list(monthly.month_files(path)) == ["2023-11", "2023-12", "2024-01", "2024-02", "2024-03", "none"]
    more = panel.where("asset = '01'").withColumn("asset", F.lit("new"))
    more.write.format(monthly.NAME).mode("append").save(path)
    assert spark.read.format(monthly.NAME).load(path).count() == panel.count() + more.count()
    more.write.format(monthly.NAME).mode("overwrite").save(path)
    assert rows_of(spark.read.format(monthly.NAME).load(path)) == rows_of(more)
    assert rows_of(spark.read.format(monthly.NAME).load("file://" + path)) == rows_of(more)


@pytest.mark.parametrize("where, months", [
    ("date >= DATE '2024-02-10'", ["2024-02", "2024-03"]), ("date = DATE '2023-12-31'", ["2023-12"]), ("date < DATE '2023-12-01'", ["2023-11", "2023-12"]),
    ("date BETWEEN DATE '2023-12-05' AND DATE '2024-01-02' AND asset = '01'", ["2023-12", "2024-01"]), ("date > DATE '2030-01-01'", []),
    ("asset = '99'", ["2023-11", "2023-12", "2024-01", "2024-02", "2024-03", "none"]), ("date IS NOT NULL", ["2023-11", "2023-12", "2024-01", "2024-02", "2024-03"]),
])
def test_months_are_skipped(spark, panel, tmp_path, where, months):
    path = f"{tmp_path}/panel"
    panel.coalesce(1).write.format(monthly.NAME).mode("append").save(path)
    found = spark.read.format(monthly.NAME).load(path).where(where)
    assert rows_of(found) == rows_of(panel.where(where))
    assert found.rdd.getNumPartitions() == max(1, len(months))  # a file of each month that is left, of all six


def test_a_failed_write_leaves_nothing_to_read(spark, panel, tmp_path):
    path = f"{tmp_path}/panel"
    panel.write.format(monthly.NAME).mode("append").save(path)
    bad = panel.withColumn("raw_close", F.when(F.col("asset") == "02", F.raise_error(F.lit("broken")).cast("double")).otherwise(F.col("raw_close")))
    with pytest.raises(Exception, match="broken"):
        bad.write.format(monthly.NAME).mode("append").save(path)
    assert rows_of(spark.read.format(monthly.NAME).load(path)) == rows_of(panel)
    with pytest.raises(Exception, match="no_panel"):
        spark.read.format(monthly.NAME).load(f"{tmp_path}/nothing")
    with pytest.raises(Exception, match="missing_column"):
        panel.drop("date").write.format(monthly.NAME).mode("append").save(f"{tmp_path}/other")
