"""Registered queries against their SQL twins, report, sources and streaming."""

import datetime as dt
import math

import duckdb
import pytest
from pyspark.sql import functions as F

from crosspanel.operators.report import build_report
from crosspanel.plans import catalog
from crosspanel.plans import panels as P
from crosspanel.sources import adapters
from crosspanel.streaming.bars import daily_bars, read_events

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def canonical(rows):
    cell = lambda v: "" if v is None else f"{v:.4f}" if isinstance(v, float) and math.isfinite(v) else str(v)
    return sorted(tuple(map(cell, r)) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    want = duck.sql(catalog.ORACLES[name])
    assert sorted(want.columns) == cols
    want = duck.sql("SELECT " + ", ".join(f'"{c}"' for c in cols) + " FROM want").fetchall()
    assert canonical(map(tuple, got.select(*(f"`{c}`" for c in cols)).collect())) == canonical(want)


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLES)


def test_pivot_keeps_every_row(spark):
    px, wide = P.prices(spark, SF), catalog.QUERIES["pivot_months"](spark, SF)
    cells = wide.unpivot(["asset", "year"], [c for c in wide.columns if c not in ("asset", "year")], "month", "raw_close").where("raw_close IS NOT NULL")
    assert cells.count() == px.where("raw_close IS NOT NULL").count() and wide.select("asset").distinct().count() == px.select("asset").distinct().count()


def test_report_and_sources(spark, tmp_path):
    px = P.prices(spark, SF)
    px.drop("adj_factor", "adj_open", "adj_high", "adj_low", "adj_close").write.parquet(f"{tmp_path}/prices.parquet")
    P.factor(px).write.parquet(f"{tmp_path}/factors/demo.parquet")
    source = adapters.ParquetAdapter(spark, str(tmp_path))
    loaded = adapters.load_prices(source, start=dt.date(1993, 1, 1))
    factor = adapters.load_factor("demo", source, start=dt.date(1993, 1, 1))
    assert "prev_close" in loaded.columns and factor.columns == ["date", "asset", "value", "available_at"]
    assert source.panel("universe") is None
    with pytest.raises(adapters.contracts.ContractError):
        source.factor("none")
    calendar = adapters.load_calendar(source, start=dt.date(1993, 1, 1))
    report = build_report(factor, loaded, calendar, horizons=(1, 2), quantiles=2, tradability=loaded.select("date", "asset", F.lit(False).alias("suspended")), n_trials=4, is_oos=0.6)
    text = report.to_markdown()
    assert report.sections()[-1] == "verdict" and "ic_summary" in text and report.verdict.main.n > 10
    assert report.equity_curves().count() > 10
    where = report.save(f"{tmp_path}/out")
    assert spark.read.parquet(where["ic_summary"]).count() == 2


def test_streamed_bars_equal_batch(spark, tmp_path):
    path = f"{tmp_path}/events"
    spark.read.parquet(f"{SF}/events.parquet").repartition(3).write.parquet(path)
    schema = spark.read.parquet(path).schema
    query = daily_bars(read_events(spark, path, schema)).writeStream.format("memory").queryName("bars").outputMode("complete").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    query.awaitTermination(120)
    batch = daily_bars(spark.read.parquet(path))
    assert sorted(map(tuple, spark.table("bars").collect())) == sorted(map(tuple, batch.collect()))
