"""What a user reads: report sections and notes, health details, the ledger, and options of single operators."""

import datetime as dt
import re

import pytest
from pyspark.sql import functions as F

from crosspanel.operators import adjust, health, ic, quantile
from crosspanel.operators.contracts import ContractError
from crosspanel.operators.ledger import CLEARED, ResearchLedger
from crosspanel.operators.report import SECTIONS, UNCORRECTED, build_report
from crosspanel.plans import panels as P

SF = "/root/testdata/sf0.001"
DAY = dt.date(2024, 1, 1)


@pytest.fixture(scope="module")
def reported(spark):
    px = P.prices(spark, SF).withColumn("prev_close", F.col("raw_open"))
    flags = px.select("date", "asset", F.lit(False).alias("suspended"))
    return lambda **more: build_report(P.factor(px), px, P.calendar(px), horizons=(1, 2), quantiles=2, tradability=flags, **more)


def test_markdown_has_its_sections_in_a_fixed_order(reported):
    text = reported(n_trials=12, is_oos=0.6).to_markdown(rows=3)
    found = re.findall(r"^## (\w+): ", text, re.M)
    assert found == [k for k in SECTIONS if k in found] + ["reading"]
    assert {"verdict", "health", "ledger", "ic_summary", "newey_west", "quantiles", "portfolio", "stability", "tail", "turnover", "returns_ledger", "in_sample"} <= set(found)
    assert "n_trials = 12" in text and "p_adj" in text and UNCORRECTED not in text and "not a tradable equity curve" in text
    assert "1.0000 |" not in re.findall(r"## ic_summary.*?\n\n", text, re.S)[0]  # horizons are whole numbers
    assert "needs an absolute threshold" in text


def test_markdown_says_what_was_not_corrected_and_which_threshold(reported):
    report = reported(crash_threshold=-0.2, check_health=False)
    text = report.to_markdown(rows=2)
    assert UNCORRECTED in text and "-20.0%" in text and "needs an absolute threshold" not in text and "## health" not in text
    assert report.tables["crash_spread"].first().threshold == -0.2


def test_health_shows_rows_behind_a_finding(spark):
    rows = [(DAY + dt.timedelta(d), f"{a:02d}", 10.0, 12.0, 9.0 if a else 11.0, 10.0 * (1 + 9 * (d == 3))) for d in range(6) for a in range(4)]
    px = spark.createDataFrame(rows, "date date, asset string, raw_open double, raw_high double, raw_low double, raw_close double").withColumn("adj_close", F.col("raw_close"))
    report = health.check(px)
    text = report.to_markdown(max_detail=2)
    assert "### ohlc" in text and "### extreme_moves" in text and text.count("The first 2; there are more.") == 2 and text.startswith("# Health of data\n\nNot passed: ")
    assert f"| {DAY} | 00 | 10 | 12 | 11 | 10 |" in text and "still_large" in text
    assert "###" not in report.to_markdown(max_detail=0)
    assert health.HealthReport().to_markdown().endswith("nothing checked.\n")


def test_ledger_families_names_and_clocks(spark, tmp_path):
    for path in (None, f"{tmp_path}/ledger"):
        led = ResearchLedger(spark, path)
        for goal, factor in (("", "f"), ("g", ""), (None, "f"), ("g", None)):
            with pytest.raises(ValueError, match="no_name"):
                led.record(goal=goal, factor=factor)
        for goal in ("a", "b"):
            led.record(goal=goal, factor="x", horizon=1)
        assert led.n_trials("a") == 1 and led.n_trials("a", family="*") == led.n_trials(family="*") == led.n_trials() == 2
        with pytest.raises(ValueError, match="bad_family"):
            led.n_trials(family="mine")
        led.clear("a")
        # an entry of a driver whose clock is an hour slow: recorded after the clearing, and not struck by it
        late = ResearchLedger(spark, path)
        late.held = led.held
        late.record(goal="a", factor="late", horizon=1)
        if path is None:
            led.held[-1] = (*led.held[-1][:8], "2000-01-01T00:00:00+00:00", *led.held[-1][9:])
        assert led.n_trials("a") == 1 and led.entries("a").first().factor == "late"
        assert led.entries().where(F.col("method") == CLEARED).count() == 0


def test_ledger_reads_what_older_versions_wrote(spark, tmp_path):
    (tmp_path / "old").mkdir()
    (tmp_path / "old" / "a.json").write_text('{"goal":"g","factor":"f","horizon":1,"ts":"2024-01-01"}\n{ this is not json\n{"goal":"g","factor":"h","horizon":1,"ts":"2024-01-02"}\n')
    (tmp_path / "old" / "b.json").write_text('{"goal":"x","factor":"f","horizon":1,"method":"bhy","ts":"2024-01-01"}\n{"goal":"x","method":"(cleared)","ts":"2024-01-02"}\n{"goal":"x","factor":"k","horizon":1,"ts":"2024-01-03"}\n')
    led = ResearchLedger(spark, f"{tmp_path}/old")
    assert [r.factor for r in led.entries("x").collect()] == ["k"]
    assert led.n_trials("g") == 2 and led.hypotheses("g").where("factor = 'f'").count() == 1
    led.clear()
    assert led.n_trials() == 0


def test_one_event_of_a_day_counts_whole(spark):
    px = spark.createDataFrame([(DAY + dt.timedelta(i), "a", 10.0) for i in range(3)], "date date, asset string, raw_close double")
    columns = "date date, asset string, category int, fenhong double, peigu double, peigujia double, songzhuangu double"
    day = DAY + dt.timedelta(1)
    twice = spark.createDataFrame([(day, "a", 1, 1.0, 0.0, 0.0, 9.0), (day, "a", 1, 2.0, 0.0, 0.0, 0.0), (day, "a", 2, 99.0, 0.0, 0.0, 0.0)], columns)
    factor = lambda e: adjust.compute_adj_factor(px, e).orderBy("date").collect()[-1].adj_factor
    assert factor(twice) == factor(twice.repartition(3)) == pytest.approx(100 / 98)
    assert factor(twice.withColumn("seq", F.when(F.col("songzhuangu") > 0, 2).otherwise(1))) == pytest.approx(10 / ((100 - 1) / 19))


def test_labels_at_hand_and_bins_asked_for(spark):
    data = spark.createDataFrame([(DAY + dt.timedelta(d), f"{a}", float(a), float(a * d)) for d in range(3) for a in range(6)], "date date, asset string, factor double, forward_return_1 double")
    labels = data.select("date", "asset", (F.col("factor") % 2 + 1).cast("int").alias("factor_quantile"))
    got = {(r.date, r.factor_quantile): r.forward_return_1 for r in quantile.quantile_returns(data, quantile_labels=labels).collect()}
    assert got[DAY + dt.timedelta(2), 1] == pytest.approx((0 + 2 + 4) * 2 / 3) and len(got) == 6
    turnover = ic.quantile_turnover(labels, n_quantiles=1)
    assert {r.factor_quantile for r in turnover.collect()} == {1} and ic.quantile_turnover(labels).count() == 2 * turnover.count()
