"""Joins in time, contracts, regressions, adjusted p-values, redraws and splits: results of the parts against those of the whole."""

import datetime as dt
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from crosspanel.functions.normal_equations import fitted, solve
from crosspanel.functions.order_statistics import ranged_ranks, running
from crosspanel.operators import asof, calendars, contracts, group, inference, portfolio, preprocess, quantile, redraws, regression
from crosspanel.operators.contracts import ContractError
from crosspanel.sources import adapters

DAY = dt.date(2020, 1, 1)


def day(n):
    return DAY + dt.timedelta(int(n))


def tasks_with_rows(df):
    """Rows of each partition that has any."""
    return [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]


# joins in time


@pytest.mark.parametrize("stretch", [1, 7, 32, 100_000])
def test_asof_equals_a_scan_for_any_stretch(spark, stretch):
    rng = np.random.default_rng(stretch)
    left = [(k, day(t), i) for i, (k, t) in enumerate(zip(rng.choice(list("abc"), 300).tolist(), rng.integers(-50, 900, 300).tolist(), strict=True))] + [("a", None, 999), (None, day(5), 998)]
    right = [(k, day(t), int(v)) for k, t, v in zip(rng.choice(list("ab"), 40).tolist(), rng.integers(0, 800, 40).tolist(), rng.integers(0, 9, 40).tolist(), strict=True)] + [("a", None, 77), ("a", day(30), None)]
    l, r = spark.createDataFrame(left, "k string, t date, i int"), spark.createDataFrame(right, "k string, s date, v int")
    got = {x.i: (x.v, x.s_matched) for x in asof.asof_backward(l, r, ["k"], "t", "s", ["v"], stretch=stretch).collect()}
    for k, t, i in left:
        known = [(s, -1 if v is None else v) for key, s, v in right if key == k and k is not None and t is not None and s is not None and s <= t]
        best = max(known) if known else (None, None)
        assert got[i] == (None if best[1] == -1 else best[1], best[0]), (k, t)
    fresh = {x.i: x.v for x in asof.asof_backward(l, r, ["k"], "t", "s", ["v"], most_days=3, stretch=stretch).collect()}
    assert all(fresh[i] in (None, v) and (fresh[i] is None) == (v is None or (dict((n, t) for _, t, n in left)[i] - s).days > 3) for i, (v, s) in got.items())


def test_asof_spreads_a_hot_key(spark):
    left = spark.range(200_000).select(F.lit(1).alias("k"), F.date_add(F.lit(DAY), (F.col("id") % 2500).cast("int")).alias("t"), "id")
    right = spark.range(2500).where("id % 3 = 0").select(F.lit(1).alias("k"), F.date_add(F.lit(DAY), F.col("id").cast("int")).alias("s"), F.col("id").alias("v"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = asof.asof_backward(left, right, ["k"], "t", "s", ["v"])
        sizes = tasks_with_rows(out)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(sizes) == 4 and max(sizes) < 0.5 * sum(sizes) and sum(sizes) == 200_000
    assert out.where("v <> (id % 2500) - (id % 2500) % 3").count() == 0


def test_blocks_cover_a_span_once(spark):
    spans = [(0, 0), (0, 6), (3, 3), (5, 1000), (1, 2**20), (-719_162, 2_932_896)]
    rows = spark.createDataFrame(spans, "a int, b int")
    for r in rows.select("a", "b", asof.blocks_of_span(F.col("a"), F.col("b")).alias("blocks")).collect():
        parts = sorted((x.block * 2**x.level, (x.block + 1) * 2**x.level) for x in r.blocks)
        assert parts[0][0] == r.a - asof.FIRST_DAY and parts[-1][1] == r.b + 1 - asof.FIRST_DAY
        assert all(p[1] == q[0] for p, q in zip(parts, parts[1:], strict=False)) and len(parts) <= 2 * asof.LEVELS
    around = spark.createDataFrame([(5,)], "d int").select(asof.blocks_around(F.col("d")).alias("b")).first().b
    assert [x.block for x in around] == [(5 - asof.FIRST_DAY) >> level for level in range(asof.LEVELS + 1)]


def test_interval_join_of_many_open_spans(spark):
    """16,000 spans of one key that all overlap: work follows their number, not its square."""
    spans = spark.range(16_000).select(F.lit("k").alias("k"), F.date_add(F.lit(DAY), F.col("id").cast("int")).alias("s"), F.lit(None).cast("date").alias("e"), F.col("id").alias("v"))
    left = spark.createDataFrame([("k", day(i * 1777), i) for i in range(10)], "k string, at date, i int")
    asof.interval_join(left, spans.limit(10), ["k"], "at", "s", "e", ["v"]).collect()
    began = time.time()
    got = {r.i: r.v for r in asof.interval_join(left, spans, ["k"], "at", "s", "e", ["v"]).collect()}
    took = time.time() - began
    assert got == {i: min(i * 1777, 15_999) for i in range(10)} and took < 20, took


def test_interval_join_equals_a_scan(spark):
    rng = np.random.default_rng(4)
    spans = [(k, day(s), None if n < 3 else day(s + n), int(v)) for k, s, n, v in zip(rng.choice(list("ab"), 200).tolist(), rng.integers(0, 300, 200), rng.integers(0, 90, 200), rng.integers(0, 50, 200), strict=True)]
    left = [(k, day(t), t) for k in "abc" for t in range(-3, 420, 7)]
    got = {(r.k, r.i): r.v for r in asof.interval_join(spark.createDataFrame(left, "k string, at date, i int"), spark.createDataFrame(spans, "k string, s date, e date, v int"), ["k"], "at", "s", "e", ["v"]).collect()}
    for k, t, i in left:
        held = [(s, v) for key, s, e, v in spans if key == k and s <= t and (e is None or t <= e)]
        assert got[k, i] == (max(held)[1] if held else None)


# contracts


def big_panel(spark, dates=400, assets=500):
    rows = spark.range(dates * assets).select(F.date_add(F.lit(DAY), (F.col("id") / assets).cast("int")).alias("date"), F.lpad((F.col("id") % assets).cast("string"), 6, "0").alias("asset"), (10.0 + F.col("id") % 7).alias("p"))
    raw = {f"raw_{k}": F.col("p") for k in contracts.PRICE_KINDS} | {f"adj_{k}": F.col("p") for k in contracts.PRICE_KINDS}
    return rows.withColumns(raw | {"prev_close": F.col("p"), "adj_factor": F.lit(1.0)}).drop("p")


def jobs_of(spark, action):
    """Jobs that an action starts."""
    group_id = f"counted-{time.time_ns()}"
    spark.sparkContext.setJobGroup(group_id, "counted")
    try:
        action()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group_id))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_validation_guardrail(spark):
    px = big_panel(spark).cache()
    factor = px.select("date", "asset", F.col("raw_open").alias("value"), F.col("date").alias("available_at")).cache()
    calendar = calendars.from_panels(px)
    assert px.count() == factor.count() == 200_000
    contracts.validate_inputs(factor, px, calendar)
    began = time.time()
    assert contracts.validate_inputs(factor, px, calendar)
    took = time.time() - began
    px.unpersist(), factor.unpersist()
    assert took < 6, took  # 2 seconds on a machine that does nothing else


def test_rules_are_counted_in_one_job(spark):
    px = big_panel(spark, 20, 30)
    spoiled = px.withColumn("raw_open", F.when(F.col("asset") == "000003", F.lit(-1.0)).otherwise(F.col("raw_open"))).unionByName(px.where("asset = '000007'"))
    found = {(r.rule, r.column): (r.n, r.note) for r in contracts.rule_counts(spoiled, contracts.PRICES).collect()}
    assert found["not_positive", "raw_open"] == (20, f"{DAY} 000003") and found["duplicate_key", "date, asset"] == (20, f"{DAY} 000007")
    assert found["adjust_inconsistent", "adj_open"][0] == 1 and all(n == 0 for (rule, c), (n, _) in found.items() if c not in ("raw_open", "adj_open", "date, asset"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # which makes a job of each stage
    try:
        assert jobs_of(spark, lambda: contracts.validate(px, contracts.PRICES)) == 1
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_watched_panels_need_no_job_of_their_own(spark):
    px = big_panel(spark, 10, 10)
    good = contracts.watched(px, contracts.PRICES)
    assert jobs_of(spark, lambda: None) == 0 and good.rows.count() == 100 and good.verify() is good.rows
    bad = contracts.watched(px.withColumn("prev_close", F.when(F.col("asset") == "000002", float("inf")).otherwise(F.col("prev_close"))), contracts.PRICES)
    bad.rows.select("date").where("asset > '000001'").write.format("noop").mode("overwrite").save()
    assert bad.counts()["not_finite", "prev_close"] == 10
    with pytest.raises(ContractError) as refused:
        bad.verify()
    assert refused.value.rule == "not_finite"
    with pytest.raises(ContractError, match="missing_column"):
        contracts.watched(px.drop("adj_low"), contracts.PRICES)
    none = contracts.watched(px.select("date", "asset", F.lit(None).cast("double").alias("value"), F.col("date").alias("available_at")), contracts.FACTOR)
    none.rows.count()
    with pytest.raises(ContractError, match="all_missing"):
        none.verify()


def test_groupings_and_adjusted_series(spark):
    px = big_panel(spark, 4, 3)
    assert contracts.group_col(px.select("date", "asset", F.lit("x").alias("sector"))) == "sector"
    assert contracts.group_col(px.select("date", "asset", F.lit("x").alias("sector"), F.lit("y").alias("group"))) == "group"
    with pytest.raises(ContractError, match="ambiguous_group"):
        contracts.group_col(px.select("date", "asset", F.lit("x").alias("a"), F.lit("y").alias("b")))
    factor = px.select("date", "asset", F.col("raw_open").alias("value"), F.col("date").alias("available_at"))
    receipt = contracts.ensure_contract(factor, px, calendars.from_panels(px), grouping=px.select("date", "asset", F.lit(1.0).alias("a"), F.lit(2.0).alias("b")))
    assert any("2 columns" in n for n in receipt.notices)
    a = px.select("date", "asset", (F.dayofmonth("date") * 1.0).alias("adj_close"))
    b = a.withColumn("adj_close", F.col("adj_close") * 3)
    assert contracts.check_adjust_agreement(a, b)["n"] == 9
    gap = a.where(F.col("date") != F.lit(day(2)))
    assert contracts.check_adjust_agreement(gap, b, calendar=calendars.from_panels(px))["n"] == 3
    with pytest.raises(ContractError, match="mine and theirs"):
        contracts.check_adjust_agreement(a, a.withColumn("adj_close", F.col("adj_close") + F.dayofmonth("date") ** 2), name_a="mine", name_b="theirs")


def test_prices_with_events_at_hand(spark):
    px = big_panel(spark, 4, 1).select("date", "asset", "raw_open", "raw_high", "raw_low", "raw_close")
    event = spark.createDataFrame([("000000", day(2), 1, 1.0, 0.0, 0.0, 0.0)], "asset string, date date, category int, fenhong double, peigu double, peigujia double, songzhuangu double")
    source = adapters.DataFrameAdapter(px)
    plain, fixed = (adapters.load_prices(source, xdxr=e).orderBy("date").collect() for e in (None, event))
    assert all(r.adj_factor == 1.0 for r in plain) and fixed[0].adj_factor == 1.0 and fixed[-1].adj_factor > 1.0


# regressions


def sections(spark, seed=0, dates=6, n=40, xs=3):
    rng = np.random.default_rng(seed)
    rows = []
    for d in range(dates):
        x = rng.normal(size=(n, xs)) * [1, 1e3, 1e-3][:xs] + [5, -2e4, 0.1][:xs]
        y = x @ np.array([0.5, 2e-3, -300.0])[:xs] + rng.normal(size=n) + 1e3
        rows += [(day(d), f"{i:03d}", float(y[i]), *map(float, x[i]), float(rng.integers(1, 5))) for i in range(n)]
    return rows, spark.createDataFrame(rows, "date date, asset string, y double, " + ", ".join(f"x{i} double" for i in range(xs)) + ", w double")


@pytest.mark.parametrize("constant, weight", [(True, None), (False, None), (True, "w"), (False, "w")])
def test_three_regressors_equal_least_squares(spark, constant, weight):
    rows, df = sections(spark)
    xs = ["x0", "x1", "x2"]
    got = {(r.date, r.regressor): r.coef for r in regression.cross_sectional_regression(df, "y", xs, constant, weights=weight).collect()}
    for d in sorted({r[0] for r in rows}):
        own = np.array([r[2:] for r in rows if r[0] == d])
        x = np.column_stack([*([np.ones(len(own))] if constant else []), own[:, 1:4]])
        root = np.sqrt(own[:, 4]) if weight else np.ones(len(own))
        want = np.linalg.lstsq(x * root[:, None], own[:, 0] * root, rcond=None)[0]
        assert [got[d, name] for name in [*(["const"] if constant else []), *xs]] == pytest.approx(want.tolist(), rel=1e-6)


def test_singular_sections_have_no_coefficients_but_residuals(spark):
    rows, df = sections(spark, xs=2)
    df = df.withColumn("x2", F.when(F.col("date") == F.lit(day(1)), 2 * F.col("x0") - F.col("x1")).otherwise(F.col("x1") ** 2)).withColumn("x3", F.when(F.col("date") == F.lit(day(2)), 7.0).otherwise(F.rand(3)))
    coefs = regression.cross_sectional_regression(df, "y", ["x0", "x1", "x2", "x3"])
    missing = {r.date for r in coefs.where("coef is null").collect()}
    assert missing == {day(1), day(2)} and coefs.where("coef is null").count() == 10
    rest = preprocess.neutralize(df, "y", ["x0", "x1", "x2", "x3"]).toPandas()
    for d, own in df.toPandas().groupby("date"):
        x = np.column_stack([np.ones(len(own)), own[["x0", "x1", "x2", "x3"]]])
        x = x / np.abs(x).max(0)
        want = own["y"] - x @ np.linalg.lstsq(x, own["y"], rcond=None)[0]
        assert rest[rest.date == d].sort_values("asset")["y"].tolist() == pytest.approx(want[own.sort_values("asset").index].tolist(), abs=1e-5)


def test_fits_leave_out_what_is_not_finite(spark):
    rows, df = sections(spark, dates=1, xs=1)
    holed = df.withColumn("x0", F.when(F.col("asset") == "000", float("nan")).when(F.col("asset") == "001", float("inf")).when(F.col("asset") != "002", F.col("x0")))
    assert fitted(holed, ["date"], "y", ["x0"]).first().n == 37
    assert preprocess.neutralize(holed, "y", ["x0"]).where("y is null").count() == 3
    plan = preprocess.neutralize(df, "y", ["x0"])._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan
    assert regression.cross_sectional_regression(df.limit(0), "y", ["x0"]).count() == 0
    none = spark.range(1).select(solve(F.array(F.array(F.lit(0.0), F.lit(0.0)))).alias("s")).first().s
    assert none.b == [0.0] and none.singular


# adjusted p-values


@pytest.mark.parametrize("n_trials", [None, 500])
def test_adjusted_over_ranges_equal_the_list(spark, n_trials):
    rng = np.random.default_rng(9)
    p = [*rng.beta(0.4, 3, 300).round(3).tolist(), *[1.0] * 40, *[0.0] * 3]
    df = spark.createDataFrame(list(enumerate(p)) + [(999, None)], "i int, p double").repartition(7)
    out = inference.adjust_columns(df, "p", {m: m for m in inference.METHODS}, n_trials)
    rows = {r.i: r for r in out.collect()}
    assert len(rows) == len(p) + 1 and all(rows[999][m] is None for m in inference.METHODS)
    for m in inference.METHODS:
        assert [rows[i][m] for i in range(len(p))] == pytest.approx(inference.adjust(p, m, n_trials).tolist())
    assert inference.adjust_columns(df.where("i < 0"), "p", {"q": "holm"}).count() == 0


def test_running_extremes_over_few_and_many_ranges(spark):
    xs = np.random.default_rng(2).permutation(500).tolist()
    df = spark.createDataFrame([(float(x), float((x * 37) % 101)) for x in xs], "x double, y double")
    for ranges in (1, 5, 128):
        ranked = ranged_ranks(df, "x", [], ranges).join(df, "x")
        up = {r.x: r.m for r in running(ranked, "x", {"m": F.col("y")}, True).collect()}
        down = {r.x: r.m for r in running(ranked, "x", {"m": F.col("y")}, False).collect()}
        ys = [(x * 37) % 101 for x in range(500)]
        assert [up[float(x)] for x in range(500)] == np.maximum.accumulate(ys).tolist()
        assert [down[float(x)] for x in range(500)] == np.minimum.accumulate(ys[::-1])[::-1].tolist()
        assert ranked.select("_b").distinct().count() <= ranges + 1


# rollups, redraws, logs, splits


def test_rollups(spark):
    rows = [(day(d), g, h, None if (d + h) % 5 == 0 else float(d * h), 9, "constant" if (d + h) % 5 == 0 else None) for d in range(12) for g in ("a", "b") for h in (1, 3)]
    ic = spark.createDataFrame(rows, "date date, group string, horizon int, ic double, n int, reason string")
    found = {(r.level, r.horizon, r["group"]): r for r in group.ic_rollup(ic).collect()}
    assert len(found) == 4 + 2 + 1
    every = [r[3] for r in rows if r[3] is not None]
    assert found[2, None, None].mean == pytest.approx(np.mean(every)) and found[2, None, None].n_skipped == len(rows) - len(every)
    assert found[1, 3, None].mean == pytest.approx(np.mean([r[3] for r in rows if r[3] is not None and r[2] == 3]))
    frame = group.grouped_frame(ic).orderBy("horizon").collect()
    assert frame[0].asDict().keys() == {"horizon", "a", "b"} and frame[1]["a"] == pytest.approx(found[0, 3, "a"].mean)


def test_monotonicity_of_all_levels(spark):
    rng = np.random.default_rng(8)
    rows = [(day(d), f"{a:03d}", float(a), float(rng.normal()), float(a + rng.normal()), float(-a)) for d in range(8) for a in range(60)]
    data = spark.createDataFrame(rows, "date date, asset string, factor double, size double, forward_return_1 double, forward_return_3 double")
    found = {(r.level, r.horizon, r.by_quantile): r for r in quantile.monotonicity_rollup(data, "size", 2, 4).collect()}
    assert set(found) == {(0, h, b) for h in (1, 3) for b in (1, 2)} | {(1, 1, None), (1, 3, None), (2, None, None)}
    assert found[1, 1, None].spearman == 1.0 and found[0, 3, 2].spearman == -1.0 and found[0, 1, 1].n_bins == 4
    old = {(r.by_quantile, r.horizon): r.spearman for r in quantile.double_sort_monotonicity(data, "size", 2, 4).collect()}
    assert old == {(b or 0, h): found[level, h, b].spearman for level, h, b in found if level < 2}


def test_redraws_do_not_depend_on_partitions(spark):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(i, "ab"[i % 2], float(x)) for i, x in enumerate(rng.normal(0.3, 1, 400))] + [(999, "a", None), (998, "b", float("nan"))], "i int, g string, x double")
    first = {r.g: r for r in redraws.perturb_panel(df, "x", ["i"], ["g"], n_draws=100).collect()}
    again = {r.g: r for r in redraws.perturb_panel(df.repartition(7, "x"), "x", ["i"], ["g"], n_draws=100).collect()}
    for g in "ab":
        assert first[g].n == 200 and tuple(first[g][1:]) == pytest.approx(tuple(again[g][1:]))
        assert first[g].p5 < first[g].base < first[g].p95 and first[g].p95 - first[g].p5 == pytest.approx(2 * 1.645 / 200**0.5, rel=0.25)
    weights = redraws.drawn(df.where("x is not null"), ["i"], 200).groupBy("draw").agg(F.sum("weight").alias("n")).agg(F.avg("n"), F.stddev("n")).first()
    assert weights[0] == pytest.approx(401, rel=0.02) and weights[1] == pytest.approx(20, rel=0.25)
    whole = redraws.perturb_panel(df, "x", ["i"], mode="subsample", frac=1.0, n_draws=5).first()
    assert whole.p5 == pytest.approx(whole.base) and whole.same_sign == whole.within_tol == 1.0
    median = redraws.perturb_panel(df, "x", ["i"], ["g"], n_draws=40, agg=np.median).orderBy("g").collect()
    assert [r.base for r in median] == pytest.approx([float(np.median([r.x for r in df.where("x is not null and not isnan(x)").collect() if r.i % 2 == k])) for k in (0, 1)])
    with pytest.raises(ContractError, match="bad_mode"):
        redraws.perturb_panel(df, "x", ["i"], mode="jackknife")


def test_preprocess_log_counts_in_the_same_pass(spark):
    rows = [(day(d), f"{a:03d}", float(a) if d else 1.0, float(a % 3)) for d in range(3) for a in range(20)] + [(day(2), "999", 1e6, 1.0), (day(9), "000", 3.0, 1.0)]
    df = spark.createDataFrame(rows, "date date, asset string, factor double, size double")
    log = preprocess.PreprocessLog()
    assert log.frame(spark).count() == 0 and log.frame(spark).columns == ["step", "n_rows", "n_changed", "n_skipped_sections"]
    out = preprocess.neutralize(preprocess.standardize(preprocess.winsorize(df, log=log), log=log), exposures=["size"], log=log)
    assert out.columns == df.columns and out.count() == 62
    got = {r[0]: r[1:] for r in log.rows()}
    assert got["winsorize"] == (62, 1, 2) and got["standardize"][2] == 2 and got["neutralize_exposures"] == (62, 62, 1)
    plain = preprocess.neutralize(preprocess.standardize(preprocess.winsorize(df)), exposures=["size"])
    assert sorted(map(str, out.collect())) == sorted(map(str, plain.collect()))


def test_combine_needs_as_many_as_asked(spark):
    base = spark.createDataFrame([(DAY, f"{a}", float(a)) for a in range(6)], "date date, asset string, factor double")
    parts = {"a": base, "b": base.where("asset > '1'"), "c": base.where("asset > '3'")}
    there = lambda n: preprocess.combine(parts, min_obs=n).where("factor is not null").count()
    assert (there(1), there(2), there(3), there(None)) == (6, 4, 2, 4)


@pytest.mark.parametrize("settings", [{}, {"embargo": 4}, {"purge_horizons": [1, 5]}])
def test_split_hints_are_exactly_what_works(settings):
    days = [day(i) for i in range(60)]
    if "purge_horizons" in settings:
        settings = settings | {"calendar": days}

    def works(**how):
        try:
            portfolio.split_is_oos(days, min_periods=15, **how, **settings)
        except ContractError as refused:
            return str(refused)
        return True

    for r in (0.01, 0.99):
        hint = works(ratio=r)
        low, high = (float(x) for x in hint.split("a ratio from ")[1].split(" does")[0].split(" to "))
        fits = [x / 100 for x in range(1, 100) if works(ratio=x / 100) is True]
        assert (low, high) == (fits[0], fits[-1])
    for c in (days[2], days[-3]):
        hint = works(cut=c)
        low, high = (dt.date.fromisoformat(x) for x in hint.split("a cut from ")[1].split(" does")[0].split(" to "))
        fits = [d for d in days if works(cut=d) is True]
        assert (low, high) == (fits[0], fits[-1])
    with pytest.raises(ContractError, match="too few periods \\(20\\)"):
        portfolio.split_is_oos(days[:20], min_periods=15)
