"""Hand-computed answers of the factor engine."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from crosspanel.operators import (
    adjust, asof, calendars, clean, contracts, event, group, health, ic, inference, parity, portfolio, preprocess, quantile, regression, returns, tail, tradability,
)
from crosspanel.operators.contracts import ContractError
from crosspanel.operators.ledger import ResearchLedger

DAYS = [dt.date(2024, 1, d) for d in (1, 2, 3, 4, 5, 8, 9, 10, 11, 12)]


def panel(spark, columns, rows):
    double = [c.split()[1] == "double" for c in columns.split(", ")]
    return spark.createDataFrame([tuple(float(v) if d and v is not None else v for v, d in zip(r, double)) for r in rows], columns)


def cal(spark, n=len(DAYS)):
    return calendars.from_dates(spark.createDataFrame([(d,) for d in DAYS[:n]], "date date"))


def collected(df, *cols):
    return [tuple(r) for r in df.orderBy(*[c for c in ("date", "asset") if c in df.columns]).select(*cols).collect()]


def test_adjust_ten_for_ten(spark):
    px = panel(spark, "date date, asset string, raw_close double", [(d, "000001", c) for d, c in zip(DAYS, (10.0, 10, 5, 5, 5))])
    ev = panel(spark, "date date, asset string, category int, fenhong double, peigu double, peigujia double, songzhuangu double", [(DAYS[2], "000001", 1, 0.0, 0.0, 0.0, 10.0)])
    assert [r[0] for r in collected(adjust.compute_adj_factor(px, ev), "adj_factor")] == [1, 1, 2, 2, 2]
    assert [r[0] for r in collected(adjust.compute_adj_factor(px, ev, "qfq"), "adj_factor")] == [0.5, 0.5, 1, 1, 1]


def test_adjust_cash_and_event_off_the_index(spark):
    fields = "date date, asset string, category int, fenhong double, peigu double, peigujia double, songzhuangu double"
    px = panel(spark, "date date, asset string, raw_close double", [(d, "a", c) for d, c in zip(DAYS, (10.0, 10.0, 9.5))])
    out = collected(adjust.compute_adj_factor(px, panel(spark, fields, [(DAYS[2], "a", 1, 5.0, 0.0, 0.0, 0.0)])), "adj_factor")
    assert out[0][0] == 1 and out[2][0] == pytest.approx(10 / 9.5)
    px = panel(spark, "date date, asset string, raw_close double", [(DAYS[0], "a", 10.0), (DAYS[1], "a", 10.0), (DAYS[4], "a", 5.0)])
    out = collected(adjust.compute_adj_factor(px, panel(spark, fields, [(DAYS[3], "a", 1, 0.0, 0.0, 0.0, 10.0)])), "adj_factor")
    assert [r[0] for r in out] == [1, 1, 2]


def prices(spark, rows):
    df = panel(spark, "date date, asset string, raw_open double, raw_close double", rows)
    return df.withColumns({"raw_high": F.greatest("raw_open", "raw_close"), "raw_low": F.least("raw_open", "raw_close"), "adj_factor": F.lit(1.0), "adj_open": F.col("raw_open"), "adj_close": F.col("raw_close")})


def test_forward_return_next_open(spark):
    px = prices(spark, [(d, "a", float(o), float(c)) for d, o, c in zip(DAYS, (10, 11, 13, 15, 17), (10, 12, 14, 16, 18))])
    row = returns.forward_returns(px, cal(spark, 5), [1]).where(F.col("date") == DAYS[0]).first()
    assert row.forward_return_1 == pytest.approx(13 / 11 - 1) and row.overnight_gap_1 == pytest.approx(11 / 10 - 1)
    assert (row.entry_date, row.exit_date_1) == (DAYS[1], DAYS[2])
    assert row.total_return_1 == pytest.approx(13 / 11 * 1.1 - 1)


@pytest.mark.parametrize("policy, cut, expected", [("last_price", 0.0, -0.2), ("haircut", -0.3, -0.44), ("nan", 0.0, None)])
def test_delisting(spark, policy, cut, expected):
    rows = [(d, "A", 10.0, 10.0) for d in DAYS[:6]] + [(d, "B", p, p) for d, p in zip(DAYS, (10.0, 9.0, 8.0))]
    model = returns.ReturnModel(entry="same_open", delist_policy=policy, delist_return=cut)
    out = returns.forward_returns(prices(spark, rows), cal(spark, 6), [3], model=model)
    row = out.where((F.col("asset") == "B") & (F.col("date") == DAYS[0])).first()
    assert row.delisted_3 and (row.forward_return_3 is None if expected is None else row.forward_return_3 == pytest.approx(expected))


def test_suspension_is_not_delisting(spark):
    rows = [(d, "B", 10.0, 10.0) for i, d in enumerate(DAYS[:6]) if i not in (2, 3)] + [(d, "A", 1.0, 1.0) for d in DAYS[:6]]
    out = returns.forward_returns(prices(spark, rows), cal(spark, 6), [2], model=returns.ReturnModel(entry="same_open", delist_policy="last_price"))
    row = out.where((F.col("asset") == "B") & (F.col("date") == DAYS[0])).first()
    assert row.forward_return_2 is None and not row.delisted_2


def test_exit_policies(spark):
    px = prices(spark, [(d, "a", float(10 + i), float(10 + i)) for i, d in enumerate(DAYS[:6])])
    flags = panel(spark, "date date, asset string, can_buy_open boolean, can_sell_open boolean, reason_buy string", [(d, "a", True, i != 2, "ok") for i, d in enumerate(DAYS[:6])])
    get = lambda p: returns.forward_returns(px, cal(spark, 6), [1], tradability=flags, model=returns.ReturnModel(exit_policy=p)).where(F.col("date") == DAYS[0]).first()
    assert get("assume").forward_return_1 == pytest.approx(12 / 11 - 1)
    assert get("drop").forward_return_1 is None
    late = get("delay")
    assert late.exit_delayed_1 and late.forward_return_1 == pytest.approx(13 / 11 - 1) and late.exit_date_1 == DAYS[3]
    with pytest.raises(ContractError):
        returns.forward_returns(px, cal(spark, 6), [1], model=returns.ReturnModel(exit_policy="drop"))


def test_limits(spark):
    assert tradability.limit_prices(10, "600000") == (11.0, 9.0)
    assert tradability.limit_prices(10, "600000", "*ST x") == (10.5, 9.5)
    assert tradability.limit_prices(10, "300001", "ST x") == (12.0, 8.0)
    px = panel(spark, "date date, asset string, raw_open double, raw_close double, prev_close double", [(DAYS[0], "600000", 11.0, 11.0, 10.0), (DAYS[1], "600000", 10.99, 10.0, 10.0), (DAYS[2], "600000", None, None, 10.0)])
    out = collected(tradability.compute_tradability(px), "can_buy_open", "can_sell_open", "reason_buy")
    assert out == [(False, True, "limit_up"), (True, True, "ok"), (False, False, "suspended")]


def test_listed_days(spark):
    px = panel(spark, "date date, asset string, raw_open double, raw_close double", [(d, "600000", 10.0, 10.0) for d in DAYS])
    lists = panel(spark, "asset string, list_date date", [("600000", DAYS[2])])
    out = tradability.compute_tradability(px.where(F.col("date") >= DAYS[2]), cal(spark), list_dates=lists, new_stock_days=3)
    assert [r[:2] for r in collected(out, "listed_days", "is_new_stock")] == [(i + 1, i < 3) for i in range(8)]


def analysis(spark, n_dates=4, n_assets=10, sign=1.0):
    rows = [(d, f"{a:06d}", float(a), sign * a / 100) for d in DAYS[:n_dates] for a in range(n_assets)]
    return panel(spark, "date date, asset string, factor double, forward_return_1 double", rows)


def test_ic(spark):
    assert {r[0] for r in collected(ic.information_coefficient(analysis(spark)), "ic")} == {1.0}
    assert {r[0] for r in collected(ic.information_coefficient(analysis(spark, sign=-1.0)), "ic")} == {-1.0}
    flat = analysis(spark).withColumn("factor", F.lit(1.0))
    assert {r[0] for r in collected(ic.information_coefficient(flat), "ic")} == {None}
    few = analysis(spark, n_assets=2)
    assert {r[0] for r in collected(ic.information_coefficient(few), "ic")} == {None}


def test_autocorrelation_and_turnover(spark):
    assert {r[0] for r in collected(ic.rank_autocorrelation(analysis(spark)), "autocorrelation")} == {1.0}
    labels = [(DAYS[0], str(a), 1) for a in (0, 1, 2, 3, 4)] + [(DAYS[1], str(a), 1) for a in (0, 1, 2, 5, 6)]
    df = panel(spark, "date date, asset string, factor_quantile int", labels)
    assert collected(ic.quantile_turnover(df), "turnover") == [(0.4,)]
    assert collected(ic.quantile_turnover(df, method="symmetric"), "turnover")[0][0] == pytest.approx(4 / 7 / 2)


def test_quantiles(spark):
    out = collected(quantile.quantize(analysis(spark, 1), 5), "factor_quantile")
    assert [r[0] for r in out] == [1, 1, 2, 2, 3, 3, 4, 4, 5, 5]
    assert {r[0] for r in collected(quantile.quantize(analysis(spark, 1, 4), 5), "factor_quantile")} == {None}
    ls = collected(quantile.factor_returns(analysis(spark), 5), "forward_return_1")
    assert ls[0][0] == pytest.approx(0.08)


def test_double_sort_accounts_for_all_rows(spark):
    data = analysis(spark, 2, 12).withColumn("size", F.when(F.col("asset") != "000003", F.col("factor") % 5))
    cells = quantile.double_sort(data, "size", 2, 2, "independent", [1])
    lost = quantile.dropped_from_sort(data, "size", 2, 2)
    assert cells.count() == 4
    assert cells.agg(F.sum("n_obs")).first()[0] + (lost.agg(F.sum("n")).first()[0] or 0) == data.count()


def test_event_window(spark):
    px = panel(spark, "date date, asset string, adj_close double", [(d, "a", p) for d, p in zip(DAYS, (100.0, 100, 100, 100, 110, 110, 110, 121, 121, 121))])
    ev = panel(spark, "date date, asset string, event_type string", [(DAYS[4], "a", "x"), (DAYS[0], "a", "x")])
    out = event.align_event_windows(px, ev, cal(spark), (-2, 4))
    got = out.rows.orderBy("rel_day").select("ret", "car").collect()
    assert [round(r.ret, 6) for r in got] == [0, 0, 0.1, 0, 0, 0.1, 0]
    assert [round(r.car, 6) for r in got] == [-0.1, -0.1, 0, 0, 0, 0.11, 0.11]
    assert [r.reason for r in out.dropped.collect()] == ["not_on_calendar"]


def test_tail(spark):
    df = spark.createDataFrame([(x,) for x in (-0.5, -0.4, -0.3, -0.2, -0.1, 0.0, 0.1, 0.2, 0.3, 1.0)], "r double")
    at = lambda level: tail.tail_risk(df, "r", level=level).first()
    assert (at(0.05).value_at_risk, at(0.1).value_at_risk, at(0.2).value_at_risk) == (-0.5, -0.5, -0.4)
    assert at(0.2).cvar == pytest.approx(-0.45) and at(0.5).cvar == pytest.approx(-0.3)


def test_regression(spark):
    df = panel(spark, "date date, asset string, x double, y double", [(DAYS[0], str(i), float(i), 2.0 * i) for i in range(1, 4)])
    got = {r.regressor: r.coef for r in regression.cross_sectional_regression(df, "y", ["x"], min_obs=3).collect()}
    assert got["const"] == pytest.approx(0, abs=1e-12) and got["x"] == pytest.approx(2)
    rng = np.random.default_rng(0)
    rows = [(d, f"{a}", *map(float, rng.normal(size=4))) for d in DAYS[:3] for a in range(30)]
    df = panel(spark, "date date, asset string, f1 double, f2 double, y double, w double", rows).withColumn("w", F.abs("w"))
    for w in (None, "w"):
        got = {(r.date, r.regressor): r.coef for r in regression.cross_sectional_regression(df, "y", ["f1", "f2"], weights=w).collect()}
        for d in DAYS[:3]:
            own = np.array([r[2:] for r in rows if r[0] == d])
            root = np.sqrt(np.abs(own[:, 3])) if w else np.ones(len(own))
            fit = np.linalg.lstsq(np.column_stack([np.ones(30), own[:, :2]]) * root[:, None], own[:, 2] * root, rcond=None)[0]
            assert [got[d, n] for n in ("const", "f1", "f2")] == pytest.approx(list(fit))


def test_winsorize(spark):
    df = panel(spark, "date date, asset string, factor double", [(DAYS[0], f"{i:02d}", float(i)) for i in range(20)])
    got = [r[0] for r in collected(preprocess.winsorize(df, n=1.0), "factor")]
    assert min(got) == pytest.approx(2.087) and max(got) == pytest.approx(16.913)
    assert df.count() == preprocess.standardize(df).count()


def test_neutralize_is_orthogonal(spark):
    rng = np.random.default_rng(1)
    rows = [(DAYS[0], f"{i}", *map(float, rng.normal(size=3))) for i in range(40)]
    df = panel(spark, "date date, asset string, factor double, a double, b double", rows)
    one = preprocess.neutralize(df, exposures=["a"]).toPandas()
    two = preprocess.neutralize(df, exposures=["a", "b"]).toPandas()
    assert abs(np.dot(one.factor, one.a)) < 1e-9 and abs(np.dot(two.factor, two.b)) < 1e-9 and abs(two.factor.sum()) < 1e-9


def test_thresholds_and_adjustment():
    assert [round(inference.t_threshold(n), 3) for n in (4, 20, 100, 316)] == [2.498, 3.023, 3.481, 3.778]
    p = [inference.p_from_t(t) for t in (0.177, -0.102, -3.687, -3.257)]
    adjusted = inference.benjamini_yekutieli(p)
    assert [round(x, 4) for x in adjusted[2:]] == [0.0019, 0.0047]
    for method in inference.METHODS:
        assert (inference.adjust(p, method) >= np.array(p) - 1e-15).all()
    assert inference.adjust(p, "bh", 400)[2] == pytest.approx(inference.adjust(list(p) + [1.0] * 396, "bh")[2])


def test_adjust_column_equals_list(spark):
    rng = np.random.default_rng(2)
    p = list(map(float, rng.uniform(size=30) ** 3))
    df = spark.createDataFrame([(i, x) for i, x in enumerate(p)], "i int, p double")
    for method in inference.METHODS:
        for n in (None, 50):
            got = [r.q for r in inference.adjust_column(df, "p", "q", method, n).orderBy("i").collect()]
            assert got == pytest.approx(list(inference.adjust(p, method, n)))


def test_newey_west_in_spark_equals_driver(spark):
    rng = np.random.default_rng(3)
    for n in (2, 3, 12, 150):
        x = np.cumsum(rng.normal(size=n)) + 0.3
        rows = [(dt.date(2000, 1, 1) + dt.timedelta(i), 5, float(v)) for i, v in enumerate(x)]
        got = inference.nw_summary(spark.createDataFrame(rows, "date date, horizon int, v double"), ["horizon"], "v", horizon=5).first()
        want = inference.nw_tstat(x, horizon=5)
        assert got.n == want["n"] and got.mean == pytest.approx(want["mean"])
        if n >= 3:
            assert got.t_nw == pytest.approx(want["t_nw"]) and got.vif == pytest.approx(want["vif"]) and got.vif >= 1
        else:
            assert got.t_nw is None


def test_deflation():
    rng = np.random.default_rng(4)
    x = rng.normal(size=200)
    assert inference.psr(x - x.mean()) == pytest.approx(0.5)
    assert inference.dsr(x, 1).dsr == pytest.approx(inference.psr(x))
    assert inference.dsr(x + 0.1, 1000).dsr < inference.dsr(x + 0.1, 2).dsr
    assert math.isinf(inference.min_track_record_length(x - x.mean(), 10))


def test_stability():
    assert inference.subsample_stability([1.0] * 4)["same_sign"] is None
    assert inference.subsample_stability(np.arange(1, 21))["same_sign"] == 1.0
    falling = inference.decay_test(np.linspace(1, 0.2, 40) + np.random.default_rng(0).normal(size=40) * 0.01)
    assert falling["decaying"] and falling["half_life"] > 0
    assert inference.decay_test([1, 2, 3])["decaying"] is None
    assert inference.perturb_series(np.ones(10) + np.arange(10) * 0.01)["same_sign"] == 1.0
    assert len(inference.robustness_report(np.arange(20.0))) == 6
    assert math.isnan(inference.subsample_stability([1.0, -1.0] * 10)["same_sign"]) and math.isnan(inference.nw_variance([1.0, 2.0]))
    assert inference.perturb_series(np.arange(1.0, 30), agg=np.median, mode="bootstrap")["base"] == 15.0


def test_decay():
    rng, t = np.random.default_rng(7), np.arange(240)
    found = inference.decay_test(0.08 - 0.0006 * t + rng.normal(0, 0.02, 240))
    assert found["decaying"] is True and found["t_nw"] < -10 and 0.5 < found["t_nw"] / found["t_naive"] < 2
    assert found["annual_slope"] == pytest.approx(252 * found["slope"]) and found["half_life"] > 0
    assert inference.decay_test(np.random.default_rng(8).normal(0.03, 0.02, 300))["decaying"] is False
    rising = inference.decay_test(-0.08 + 0.0006 * t)  # a negative level that fades rises, which is no decay
    assert rising["decaying"] is False and rising["half_life"] is None
    assert math.isfinite(inference.decay_test(np.arange(10.0))["slope"]) and math.isnan(inference.decay_test(np.arange(5.0))["slope"])


def test_p_of_student():
    assert inference.p_from_t(2.0, 10) == pytest.approx(0.073388, abs=1e-6) and inference.p_from_t(-12.706205, 1) == pytest.approx(0.05, abs=1e-6)
    assert inference.p_from_t(0.0, 5) == pytest.approx(1.0) and inference.p_from_t(1.5, 1e6) == pytest.approx(inference.p_from_t(1.5), abs=1e-5)
    assert math.isnan(inference.p_from_t(1.0, 0))


def test_tables_of_hypotheses_and_estimates():
    table = inference.adjusted_table([0.04, 0.001], ["a", "b"], t=[2.1, 3.3], method="bonferroni", n_trials=10)
    assert list(table.label) == ["b", "a"] and list(table.p_adj) == pytest.approx([0.01, 0.4]) and list(table.significant_adj) == [True, False]
    assert table.attrs["n_trials"] == 10 and table.attrs["t_threshold"] == pytest.approx(inference.t_threshold(10))
    one = inference.estimate_from_series(np.random.default_rng(1).normal(0.1, 0.1, 60), "x", 3, n_trials=4)
    rows = inference.estimates_table([one, one])
    assert len(rows) == 2 and rows.horizon[0] == 3 and rows.lags[0] >= 2 and inference.estimates_table([]).empty


def test_verdict(spark):
    loser = inference.assess([], returns=[-0.001] * 100, turnover=[0.5] * 100, n_trials=4)
    assert "costs take more than 30 % of the gross return" in loser.warnings and loser.cost == pytest.approx(0.15)
    assert loser.threshold_used == pytest.approx(2.498, abs=1e-3) and loser.method == "bhy"
    rng = np.random.default_rng(2)
    ic = spark.createDataFrame([(i, h, float(v)) for h in (1, 5) for i, v in enumerate(rng.normal(0.05, 0.1, 60))], "date int, horizon int, ic double")
    found = inference.assess(ic=ic, horizon=5, n_trials=2, crash={"hit_rate": 0.1})
    assert found.main.horizon == 5 and len(found.estimates) == 2 and found.crash == {"hit_rate": 0.1}
    px = prices(spark, [(d, f"{a:06d}", 10.0 + a + i, 10.0 + a + i) for i, d in enumerate(DAYS) for a in range(5)])
    sample = clean.clean(px.select("date", "asset", F.col("raw_open").alias("factor")), returns.forward_returns(px, cal(spark), [1]))
    assert inference.assess([], ledger=sample).tradable_ratio == pytest.approx(0.8)
    with pytest.raises(ValueError, match="empty_ic|no period"):
        inference.assess(ic=ic.where("ic is null"))


def test_intervals_do_not_depend_on_row_order(spark):
    day = lambda n: dt.date(2024, 1, 1) + dt.timedelta(n)
    spans = [("a", day(0), day(10), 1), ("a", day(3), day(5), 2), ("a", day(8), None, 3), ("b", day(2), day(4), 4), ("b", day(6), day(5), 9)]
    left = [(k, day(n), n) for k in "abc" for n in range(-1, 14)] + [("a", None, 99)]
    want = set()
    for k, at, n in left:
        held = [(s, v) for key, s, e, v in spans if key == k and at is not None and s <= at <= (e or day(9999))]
        want.add((k, n, max(held)[1] if held else None))
    s = spark.createDataFrame(spans, "key string, start date, end date, v int")
    rows = spark.createDataFrame(left, "key string, at date, n int")
    for parts in (1, 3, 7):
        got = asof.interval_join(rows.repartition(parts), s, ["key"], "at", "start", "end", ["v"])
        assert got.columns == ["key", "at", "n", "v"] and {(r.key, r.n, r.v) for r in got.collect()} == want


def test_calendar_look_ups(spark):
    days = [dt.date(2024, 1, 2), dt.date(2024, 1, 5), dt.date(2024, 1, 9)]
    probe = spark.range(-3, 12).select(F.date_add(F.lit(days[0]), F.col("id").cast("int")).alias("d"))
    got = probe.select("d", calendars.position(days, F.col("d")).alias("p"), calendars.position_after(days, F.col("d")).alias("a")).collect()
    for r in got:
        assert r.p == (days.index(r.d) if r.d in days else None)
        assert r.a == next((i for i, x in enumerate(days) if x > r.d), None)
    back = spark.range(-1, 5).select("id", calendars.session(days, F.col("id")).alias("d")).collect()
    assert [r.d for r in back] == [None, *days, None, None]
    assert probe.select(calendars.position([], F.col("d")).alias("p")).where("p is not null").count() == 0


def test_clean_ledger_balances(spark):
    px = prices(spark, [(d, f"{a:06d}", 10.0 + a + i, 10.0 + a + i) for i, d in enumerate(DAYS) for a in range(5)])
    f = px.select("date", "asset", F.when(F.col("asset") != "000002", F.col("raw_open")).alias("factor"))
    f = f.unionByName(f.limit(2))
    out = clean.clean(f, returns.forward_returns(px, cal(spark), [1]), universe=px.select("date", "asset", (F.col("asset") != "000004").alias("in_universe")))
    out.check()
    ledger = {r.reason: r["count"] for r in out.ledger().collect()}
    assert ledger["duplicate"] == 2 and ledger["no_factor"] == 10 and ledger["not_in_universe"] == 8 and sum(ledger.values()) == 52


def full_prices(spark, factor=1.0):
    px = prices(spark, [(d, f"{a:06d}", 10.0 + a, 10.0 + a) for d in DAYS for a in range(4)])
    return px.withColumns({"adj_high": F.col("raw_high") * factor, "adj_low": F.col("raw_low"), "prev_close": F.col("raw_close")})


@pytest.mark.parametrize("rule, change", [
    ("not_positive", lambda p: p.withColumn("raw_open", F.lit(0.0)).withColumn("adj_open", F.lit(0.0))),
    ("not_finite", lambda p: p.withColumn("prev_close", F.lit(float("inf")))),
    ("missing_column", lambda p: p.drop("adj_low")),
    ("adjust_inconsistent", lambda p: p.withColumn("adj_close", F.col("adj_close") * 2)),
    ("adjust_incomplete", lambda p: p.withColumn("adj_close", F.lit(None).cast("double"))),
    ("duplicate_key", lambda p: p.unionByName(p.limit(1))),
    ("asset_dtype", lambda p: p.withColumn("asset", F.col("asset").cast("int"))),
])
def test_price_contract(spark, rule, change):
    contracts.validate(full_prices(spark), contracts.PRICES)
    with pytest.raises(ContractError) as refused:
        contracts.validate(change(full_prices(spark)), contracts.PRICES)
    assert refused.value.rule == rule


def test_factor_contract(spark):
    px = full_prices(spark)
    good = px.select("date", "asset", F.col("raw_open").alias("value"), F.col("date").alias("available_at"))
    assert contracts.validate_inputs(good, px, cal(spark))
    for rule, f in (("lookahead", good.withColumn("available_at", F.date_add("date", 1))), ("not_in_prices", good.withColumn("date", F.date_add("date", 0)).unionByName(
        good.limit(1).withColumn("asset", F.lit("999999")))), ("all_missing", good.withColumn("value", F.lit(None).cast("double")))):
        with pytest.raises(ContractError) as refused:
            contracts.validate_inputs(f, px, cal(spark))
        assert refused.value.rule == rule


def test_calendar(spark):
    c = cal(spark)
    assert calendars.shift(c, DAYS[0], 2) == DAYS[2] and calendars.shift(c, DAYS[-1], 1) is None
    assert calendars.shift(c, dt.date(2024, 1, 6), 1) == dt.date(2024, 1, 8) and calendars.shift(c, dt.date(2024, 1, 6), -1) == dt.date(2024, 1, 5)
    assert calendars.next_session(c, DAYS[4]) == DAYS[5] and calendars.previous_session(c, DAYS[5]) == DAYS[4]
    assert calendars.sessions(c, DAYS[1], DAYS[3]) == 3


def test_grouped_ic_and_health_and_split(spark):
    data = analysis(spark, 3, 20).withColumn("grp", F.when(F.col("factor") < 10, "low").when(F.col("factor") < 18, "high"))
    out = group.grouped_ic(data, "grp")
    assert {r.ic for r in out.collect()} == {1.0} and {r.ic for r in group.weighted_ic(out).collect()} == {1.0}
    report = health.check(full_prices(spark), calendar=cal(spark))
    assert report.ok and any(f.severity == "skip" for f in report.findings) and not health.check().ok
    days = [dt.date(2024, 1, 1) + dt.timedelta(i) for i in range(40)]
    split = portfolio.split_is_oos(days, ratio=0.5, calendar=days, purge_horizons=[3])
    assert len(split.in_sample) == 16 and len(split.purged) == 4 and len(split.out_of_sample) == 20
    with pytest.raises(ContractError):
        portfolio.split_is_oos(days[:10], ratio=0.5)


def test_ledger(spark, tmp_path):
    for path in (None, f"{tmp_path}/ledger"):
        led = ResearchLedger(spark, path)
        for h in (1, 5, 21, 63, 1):
            led.record(goal="g", factor="f", horizon=h, t=2.0)
        assert led.n_trials() == 4 and led.hypotheses().count() == 4 and not led.check_n_trials(3)
        assert led.threshold() == pytest.approx(inference.t_threshold(4)) and len(led.fingerprint()) == 12
        led.clear("g")
        assert led.n_trials() == 0


def test_parity(spark):
    a = analysis(spark)
    keys = ["date", "asset"]
    assert parity.check_parity({"x": (a, a, keys, "factor")}).ok and not parity.ParityReport(1e-10).ok
    assert not parity.check_parity({"x": (a, a.withColumn("factor", F.col("factor") + 1), keys, "factor")}).ok


def test_session_gaps(spark):
    day = lambda i: dt.date(2024, 1, 1) + dt.timedelta(i)
    table = lambda days: spark.createDataFrame([(day(i),) for i in days], "date date")
    ask = lambda own, cal_: tuple(health.session_gaps(table(own), table(cal_)).first())
    assert ask([1, 2, 2, 5, 6], range(9)) == (0, 1.0, 2, day(3))
    assert ask([1, 2, 3, 20], range(9)) == (1, 1.0, 5, day(4))
    assert ask([0, 30, 60], range(61)) == (0, 30.0, None, None)
    assert ask([1, 2], range(9))[2] is None
    assert ask([], range(9))[0] == 0


def test_cleared_ledger_keeps_other_goals_and_later_entries(spark, tmp_path):
    for path in (None, f"{tmp_path}/struck"):
        led = ResearchLedger(spark, path)
        for goal, name in (("a", "x"), ("b", "y")):
            led.record(goal=goal, factor=name, horizon=1)
        led.clear("a")
        assert (led.n_trials(), led.n_trials("a")) == (1, 0)
        led.record(goal="a", factor="z", horizon=1)
        assert led.n_trials("a") == 1
        led.clear()
        assert led.n_trials() == 0
