"""Queries that conclude: portfolios, regressions, dependence, multiplicity, events, tails, entropy."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crosspanel.operators import event, ic, inference, parity, portfolio, quantile, regression, tail
from crosspanel.operators.report import build_report
from crosspanel.plans import panels as P
from crosspanel.plans.panels import DATA_SQL, PX_SQL, QUANT_SQL, RANKED_SQL, sql, tidy
from crosspanel.plans.queries_analysis import IC_SUMMARY_SQL
from crosspanel.plans.registry import query


def _q(*names: str) -> str:
    return ", ".join(f"round({n}, 6) + 0.0 AS {n}" for n in names)


_LS = QUANT_SQL + ",\nls AS (SELECT date, avg(forward_return_1) FILTER (factor_quantile = 5) - avg(forward_return_1) FILTER (factor_quantile = 1) AS ret FROM qr GROUP BY date)"


def _long_short(spark: SparkSession, d: str) -> DataFrame:
    return quantile.factor_returns(P.sample(spark, d), horizons=[1]).select("date", F.col("forward_return_1").alias("ret"))


@query("equity_curve", sql(_LS, "SELECT date, round(ret, 6) + 0.0 AS ret, round(product(1 + coalesce(ret, 0)) OVER (ORDER BY date), 6) + 0.0 AS equity FROM ls"))
def equity(spark: SparkSession, d: str) -> DataFrame:
    return tidy(portfolio.cumulative_returns(_long_short(spark, d)))


@query("portfolio_summary", sql(_LS, """, eq AS (SELECT *, product(1 + coalesce(ret, 0)) OVER (ORDER BY date) e FROM ls), dd AS (SELECT *, e / greatest(1, max(e) OVER (ORDER BY date)) - 1 dr FROM eq),
  s AS (SELECT count(ret) n, arg_max(e, date) - 1 total, avg(ret) mean, stddev_samp(ret) sd, min(dr) max_drawdown, avg(CASE WHEN ret > 0 THEN 1.0 WHEN ret IS NOT NULL THEN 0.0 END) win_rate FROM dd)
  SELECT n, round(total, 6) + 0.0 AS total, round(CASE WHEN total > -1 THEN pow(1 + total, 12.0 / n) - 1 END, 6) + 0.0 AS annual, round(sd * sqrt(12), 6) + 0.0 AS vol, round(mean / sd * sqrt(12), 6) + 0.0 AS sharpe,
  round(max_drawdown, 6) + 0.0 AS max_drawdown, round(win_rate, 6) + 0.0 AS win_rate, round(mean, 6) + 0.0 AS mean, 12.0::DOUBLE AS periods_per_year FROM s"""))
def summary(spark: SparkSession, d: str) -> DataFrame:
    return tidy(portfolio.portfolio_summary(_long_short(spark, d)))


@query("turnover_cost", sql(QUANT_SQL, """, pd AS (SELECT date, row_number() OVER (ORDER BY date) p FROM (SELECT DISTINCT date FROM lab)), m AS (SELECT p, asset, factor_quantile q FROM lab JOIN pd USING (date) WHERE factor_quantile IS NOT NULL),
  tv AS (SELECT m.p, m.q, count(*) FILTER (b.asset IS NULL) / count(*) t FROM m LEFT JOIN m b ON b.p = m.p - 1 AND b.q = m.q AND b.asset = m.asset WHERE m.p > 1 AND EXISTS (SELECT 1 FROM m z WHERE z.p = m.p - 1 AND z.q = m.q) GROUP BY m.p, m.q)
  SELECT CAST(q AS BIGINT) AS factor_quantile, round(avg(t), 6) + 0.0 AS turnover, round(avg(t) * 30 / 1e4, 6) + 0.0 AS cost, count(*) AS n FROM tv GROUP BY q"""))
def cost(spark: SparkSession, d: str) -> DataFrame:
    return tidy(portfolio.turnover_summary(ic.quantile_turnover(quantile.quantize(P.sample(spark, d)))))


_COEF = DATA_SQL + """,
rg AS (SELECT date, count(*) n, regr_slope(forward_return_1, factor) b, avg(forward_return_1) - regr_slope(forward_return_1, factor) * avg(factor) a FROM data GROUP BY date),
cf AS (SELECT date, n, 'const' regressor, CASE WHEN n >= 10 THEN a END coef FROM rg UNION ALL SELECT date, n, 'factor', CASE WHEN n >= 10 THEN b END FROM rg)"""


@query("cross_sectional_regression", sql(_COEF, f"SELECT date, regressor, {_q('coef')}, n FROM cf"))
def regress(spark: SparkSession, d: str) -> DataFrame:
    return tidy(regression.cross_sectional_regression(P.sample(spark, d), "forward_return_1", ["factor"]))


_TWO = DATA_SQL + """,
mm AS (SELECT date, count(*) n, covar_pop(forward_return_1, factor) ya, covar_pop(forward_return_1, ln_volume) yb, var_pop(factor) aa, var_pop(ln_volume) bb, covar_pop(factor, ln_volume) ab,
  avg(forward_return_1) my, avg(factor) ma, avg(ln_volume) mb FROM data GROUP BY date),
bt AS (SELECT *, CASE WHEN n >= 10 THEN (ya * bb - yb * ab) / nullif(aa * bb - ab * ab, 0) END b1, CASE WHEN n >= 10 THEN (yb * aa - ya * ab) / nullif(aa * bb - ab * ab, 0) END b2 FROM mm)"""


@query("regression_two", sql(_TWO, """SELECT date, regressor, round(coef, 6) + 0.0 AS coef, n FROM (SELECT date, 'const' regressor, my - b1 * ma - b2 * mb coef, n FROM bt UNION ALL SELECT date, 'factor', b1, n FROM bt
  UNION ALL SELECT date, 'ln_volume', b2, n FROM bt)"""))
def regress_two(spark: SparkSession, d: str) -> DataFrame:
    return tidy(regression.cross_sectional_regression(P.sample(spark, d, True), "forward_return_1", ["factor", "ln_volume"]))


def _nw(source: str, key: str, value: str, lag: str) -> str:
    """Newey-West in SQL over a table of series, `lag` the SQL of the horizon."""
    return f""",
s0 AS (SELECT {key} k, date, {value} v FROM {source} WHERE {value} IS NOT NULL),
s1 AS (SELECT k, list(v ORDER BY date) x, count(*) n, avg(v) m, stddev_samp(v) sd FROM s0 GROUP BY k),
s2 AS (SELECT *, list_transform(x, lambda e: e - m) d, least(CASE WHEN n < 3 THEN 0 ELSE least(greatest(floor(4 * pow(n / 100.0, 2.0 / 9)), {lag} - 1), greatest(1, n // 4)) END, greatest(0, n - 2))::INT L FROM s1),
lg AS (SELECT k, d, n, L, unnest(range(0, L + 1)) j FROM s2),
ac AS (SELECT k, j, L, list_sum(list_transform(range(1, n - j + 1), lambda i: d[i] * d[i + j])) / (n - 1) g FROM lg),
lr AS (SELECT k, sum(CASE WHEN j = 0 THEN g ELSE 2 * (1 - j / (L + 1.0)) * g END) s, max(g) FILTER (j = 0) g0 FROM ac GROUP BY k),
nw AS (SELECT s2.k, n, m AS mean, sd AS std, m / sqrt(g0 / n) t_naive, m / sqrt(greatest(s, g0) / n) t_nw, n / (greatest(s, g0) / g0) n_eff, L AS lags, greatest(s, g0) / g0 vif FROM s2 JOIN lr USING (k))"""


_NW_COLUMNS = f"n, {_q('mean', 'std', 't_naive', 't_nw', 'n_eff')}, CAST(lags AS BIGINT) AS lags, {_q('vif')}"


@query("fama_macbeth", sql(_COEF + _nw("cf", "regressor", "coef", "1"), f"SELECT k AS regressor, {_NW_COLUMNS} FROM nw"))
def fama_macbeth(spark: SparkSession, d: str) -> DataFrame:
    return tidy(regression.fama_macbeth(P.sample(spark, d), "forward_return_1", ["factor"]))


@query("newey_west", sql(RANKED_SQL + _nw("ic", "horizon", "ic", "k"), f"SELECT CAST(k AS BIGINT) AS horizon, {_NW_COLUMNS}, round(t_naive / t_nw, 6) + 0.0 AS t_inflation FROM nw"))
def newey_west(spark: SparkSession, d: str) -> DataFrame:
    return tidy(inference.newey_west_summary(ic.information_coefficient(P.sample(spark, d), complete=True)))


_P = PX_SQL + """,
sp AS (SELECT asset, avg(m) / (stddev_samp(m) / sqrt(count(m))) t FROM (SELECT asset, raw_close / lag(raw_close) OVER (PARTITION BY asset ORDER BY date) - 1 m FROM px) GROUP BY asset),
pv AS (SELECT asset, 1 / (1 + t * t) p FROM sp), nn AS (SELECT *, row_number() OVER (ORDER BY p) k, count(*) OVER () n FROM pv), hc AS (SELECT sum(1.0 / i) c FROM (SELECT unnest(range(1, (SELECT max(n) FROM nn) + 1)) i))"""


@query("multiplicity", sql(_P, """SELECT asset, round(p, 6) + 0.0 AS p, round(least(1, n * p), 6) + 0.0 AS bonferroni, round(least(1, max((n - k + 1) * p) OVER (ORDER BY p, k)), 6) + 0.0 AS holm,
  round(least(1, min(n / k * p) OVER (ORDER BY p DESC, k DESC)), 6) + 0.0 AS bh, round(least(1, min(n * c / k * p) OVER (ORDER BY p DESC, k DESC)), 6) + 0.0 AS bhy FROM nn, hc"""))
def multiplicity(spark: SparkSession, d: str) -> DataFrame:
    px = P.prices(spark, d)
    from pyspark.sql import Window

    move = F.col("raw_close") / F.lag("raw_close").over(Window.partitionBy("asset").orderBy("date")) - 1
    t = px.withColumn("m", move).groupBy("asset").agg((F.avg("m") / (F.stddev_samp("m") / F.sqrt(F.count("m")))).alias("t"))
    out = t.select("asset", (1 / (1 + F.col("t") * F.col("t"))).alias("p"))
    return tidy(inference.adjust_columns(out, "p", {m: m for m in inference.METHODS}))


_EV = PX_SQL + """,
evn AS (SELECT px.date, px.asset, pos FROM px JOIN (SELECT asset, sum(volume) / count(*) m FROM px GROUP BY asset) USING (asset) JOIN cal USING (date) WHERE volume > 1.5 * m),
pr AS (SELECT px.date, asset, pos, raw_close / lag(raw_close) OVER (PARTITION BY asset ORDER BY px.date) - 1 ret FROM px JOIN cal USING (date)),
win AS (SELECT e.date, e.asset, e.pos, d.rel_day FROM evn e, (SELECT unnest(range(-2, 5)) rel_day) d WHERE e.pos - 2 >= 0 AND e.pos + 4 < (SELECT count(*) FROM cal)),
wr AS (SELECT w.*, pr.ret, c.date rel_date, count(*) FILTER (pr.ret IS NULL) OVER (PARTITION BY w.date, w.asset) gaps FROM win w LEFT JOIN pr ON pr.asset = w.asset AND pr.pos = w.pos + w.rel_day JOIN cal c ON c.pos = w.pos + w.rel_day),
cu AS (SELECT *, product(1 + ret) OVER (PARTITION BY date, asset ORDER BY rel_day) - 1 cum FROM wr WHERE gaps = 0),
ew AS (SELECT *, cum - max(cum) FILTER (rel_day = 0) OVER (PARTITION BY date, asset) car FROM cu)"""


def _windows(spark: SparkSession, d: str) -> event.EventWindows:
    px = P.prices(spark, d)
    return event.align_event_windows(px, P.events(spark, d), P.calendar(px), (-2, 4))


@query("event_windows", sql(_EV, f"SELECT date, asset, CAST(rel_day AS BIGINT) AS rel_day, rel_date, {_q('ret', 'car')} FROM ew"))
def event_windows(spark: SparkSession, d: str) -> DataFrame:
    return tidy(_windows(spark, d).rows.select("date", "asset", "rel_day", "rel_date", "ret", "car"))


@query("event_dropped", sql(_EV, """SELECT reason, count(*) AS n FROM (SELECT 'not_on_calendar' AS reason FROM evn WHERE pos - 2 < 0 OR pos + 4 >= (SELECT count(*) FROM cal)
  UNION ALL SELECT 'missing_price' FROM (SELECT DISTINCT date, asset FROM wr WHERE gaps > 0)) GROUP BY reason"""))
def event_dropped(spark: SparkSession, d: str) -> DataFrame:
    return _windows(spark, d).dropped.groupBy("reason").agg(F.count("*").alias("n"))


@query("event_summary", sql(_EV, """SELECT CAST(rel_day AS BIGINT) AS rel_day, count(car) AS n, round(avg(car), 6) + 0.0 AS mean, round(median(car), 6) + 0.0 AS median, round(avg(CASE WHEN car > 0 THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS hit_rate,
  round(stddev_samp(car), 6) + 0.0 AS std, count(DISTINCT rel_date) AS n_days FROM ew GROUP BY rel_day"""))
def event_summary(spark: SparkSession, d: str) -> DataFrame:
    return tidy(event.event_summary(_windows(spark, d).rows).select("rel_day", "n", "mean", "median", "hit_rate", "std", "n_days"))


_TAIL = QUANT_SQL + """,
tl AS (SELECT date, asset, factor_quantile q, h AS horizon, CASE h WHEN 1 THEN forward_return_1 ELSE forward_return_3 END r FROM lab, (VALUES (1), (3)) v(h) WHERE factor_quantile IS NOT NULL),
tr AS (SELECT *, row_number() OVER (PARTITION BY horizon, q ORDER BY r) rn, greatest(1, ceil(0.05 * count(*) OVER (PARTITION BY horizon, q))) k FROM tl),
tc AS (SELECT *, max(r) FILTER (rn = k) OVER (PARTITION BY horizon, q) cut FROM tr)"""


@query("tail_by_quantile", sql(_TAIL, """SELECT CAST(horizon AS BIGINT) AS horizon, CAST(q AS BIGINT) AS factor_quantile, count(*) AS n, round(any_value(cut), 6) + 0.0 AS cut, count(*) FILTER (r <= cut) AS hits,
  round(avg(CASE WHEN r <= cut THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS hit_rate, round(avg(r) FILTER (r <= cut), 6) + 0.0 AS mean_crash, round(avg(r) FILTER (rn <= k), 6) + 0.0 AS cvar FROM tc GROUP BY horizon, q"""))
def tail_quantile(spark: SparkSession, d: str) -> DataFrame:
    return tidy(tail.tail_by_quantile(quantile.quantize(P.sample(spark, d))))


@query("tail_risk", sql(_TAIL, """SELECT CAST(q AS BIGINT) AS factor_quantile, count(*) AS n, round(any_value(cut), 6) + 0.0 AS value_at_risk, round(avg(r) FILTER (rn <= k), 6) + 0.0 AS cvar,
  round(sqrt(avg(r * r) FILTER (r < 0)), 6) + 0.0 AS downside_deviation, round(abs(quantile_cont(r, 0.95) / quantile_cont(r, 0.05)), 6) + 0.0 AS tail_ratio FROM tc WHERE horizon = 1 GROUP BY q"""))
def tail_risk(spark: SparkSession, d: str) -> DataFrame:
    data = quantile.quantize(P.sample(spark, d)).where("factor_quantile is not null")
    return tidy(tail.tail_risk(data, "forward_return_1", ["factor_quantile"]))


_CRASH = QUANT_SQL + """,
tl AS (SELECT date, asset, factor_quantile q, h AS horizon, CASE h WHEN 1 THEN forward_return_1 ELSE forward_return_3 END r FROM lab, (VALUES (1), (3)) v(h) WHERE factor_quantile IS NOT NULL),
tr AS (SELECT *, row_number() OVER (PARTITION BY date, horizon ORDER BY r) rn, greatest(1, ceil(0.05 * count(*) OVER (PARTITION BY date, horizon))) k FROM tl),
tc AS (SELECT *, max(r) FILTER (rn = k) OVER (PARTITION BY date, horizon) cut FROM tr),
ts AS (SELECT date, horizon, count(*) FILTER (q = 5) t, count(*) FILTER (q = 1) b, avg(r) FILTER (q = 5) - avg(r) FILTER (q = 1) ms, avg(CASE WHEN r <= cut THEN 1.0 ELSE 0.0 END) FILTER (q = 5) - avg(CASE WHEN r <= cut THEN 1.0 ELSE 0.0 END) FILTER (q = 1) hs FROM tc GROUP BY ALL)"""


@query("crash_spread", sql(_CRASH, "SELECT CAST(horizon AS BIGINT) AS horizon, count(*) AS n_periods, round(avg(ms), 6) + 0.0 AS mean_spread, round(avg(hs), 6) + 0.0 AS hit_spread FROM ts WHERE t >= 2 AND b >= 2 GROUP BY horizon"))
def crash(spark: SparkSession, d: str) -> DataFrame:
    out = tail.crash_spread(quantile.quantize(P.sample(spark, d)))
    return tidy(out.select("horizon", "n_periods", "mean_spread", "hit_spread"))


@query("rank_entropy", sql(DATA_SQL, """, z AS (SELECT date, count(*) OVER w n, CASE WHEN stddev_samp(factor) OVER w > 0 THEN greatest(-3, least(3, (factor - avg(factor) OVER w) / stddev_samp(factor) OVER w)) ELSE 0 END z FROM data WINDOW w AS (PARTITION BY date)),
  b AS (SELECT date, least(floor((z + 3) / 6 * 10), 9) b, count(*) c, any_value(n) n FROM z WHERE n >= 10 GROUP BY ALL) SELECT date, round(-sum(c / n * ln(c / n)) / ln(10), 6) + 0.0 AS entropy FROM b GROUP BY date"""))
def entropy(spark: SparkSession, d: str) -> DataFrame:
    return tidy(inference.rank_entropy_series(P.sample(spark, d)))


_TWICE = RANKED_SQL + """,
again AS (SELECT *, rank() OVER (PARTITION BY date, horizon ORDER BY exp(factor)) + (count(*) OVER (PARTITION BY date, horizon, exp(factor)) - 1) / 2.0 AS re FROM ranked),
ic2 AS (SELECT date, horizon, CASE WHEN count(*) >= 3 AND min(re) < max(re) AND min(rr) < max(rr) THEN round(corr(re, rr), 12) + 0.0 END AS ic2 FROM again GROUP BY date, horizon),
icp AS (SELECT date, horizon, CASE WHEN count(*) >= 3 AND min(factor) < max(factor) AND min(r) < max(r) THEN round(corr(factor, r), 12) + 0.0 END AS icp FROM long WHERE horizon = 1 GROUP BY date, horizon),
pairs AS (SELECT 'ic' AS name, ic AS a, ic2 AS b, ic2.date IS NULL OR ic.date IS NULL AS lone FROM ic FULL JOIN ic2 USING (date, horizon)
  UNION ALL SELECT 'rank_and_pearson', ic, icp, icp.date IS NULL OR ic.date IS NULL FROM ic FULL JOIN icp USING (date, horizon))"""


@query("parity", sql(_TWICE, """SELECT name, count(abs(a - b)) AS n, count(*) FILTER (lone OR (a IS NULL) <> (b IS NULL)) AS unmatched, round(coalesce(max(abs(a - b)), 0), 6) + 0.0 AS max_diff,
  count(abs(a - b)) > 0 AND count(*) FILTER (lone OR (a IS NULL) <> (b IS NULL)) = 0 AND coalesce(max(abs(a - b)), 0) <= 1e-10 AS within FROM pairs GROUP BY name"""))
def parity_query(spark: SparkSession, d: str) -> DataFrame:
    """A rank correlation of a factor and of a monotone change of it, which agree to the last bit; and with Pearson's at one horizon, which does not."""
    data = P.sample(spark, d)
    left, right = ic.information_coefficient(data, complete=True), ic.information_coefficient(data.withColumn("factor", F.exp("factor")), complete=True)
    plain = ic.information_coefficient(data, [1], "pearson", complete=True)
    report = parity.check_parity({"ic": (left, right, ["date", "horizon"], "ic"), "rank_and_pearson": (left, plain, ["date", "horizon"], "ic")})
    rows = [(c.name, c.n, c.unmatched, c.max_diff, parity.ParityReport(report.tol, [c]).ok) for c in report.checks]
    return tidy(spark.createDataFrame(rows, "name string, n long, unmatched long, max_diff double, within boolean"))


@query("report_ic_summary", sql(RANKED_SQL, IC_SUMMARY_SQL))
def report(spark: SparkSession, d: str) -> DataFrame:
    px = P.prices(spark, d)
    flags = px.select("date", "asset", F.lit(False).alias("suspended"))
    px = px.withColumn("prev_close", F.col("raw_open"))
    found = build_report(P.factor(px), px, P.calendar(px), horizons=tuple(P.HORIZONS), tradability=flags, check_health=False)
    return tidy(found.tables["ic_summary"])


@query("crash_stats", sql(DATA_SQL, """, tr AS (SELECT forward_return_1 r, row_number() OVER (ORDER BY forward_return_1) rn, greatest(1, ceil(0.05 * count(*) OVER ())) k FROM data),
  tc AS (SELECT *, max(r) FILTER (rn = k) OVER () cut FROM tr) SELECT count(*) AS n, round(any_value(cut), 6) + 0.0 AS cut, count(*) FILTER (r <= cut) AS hits,
  round(avg(CASE WHEN r <= cut THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS hit_rate, round(avg(r) FILTER (r <= cut), 6) + 0.0 AS mean_crash, round(avg(r) FILTER (rn <= k), 6) + 0.0 AS cvar FROM tc"""))
def crash_pooled(spark: SparkSession, d: str) -> DataFrame:
    return tidy(tail.crash_stats(P.sample(spark, d), "forward_return_1"))


@query("crash_significance", sql(_CRASH, ", tz AS (SELECT * FROM ts WHERE t >= 2 AND b >= 2)" + _nw("tz", "horizon", "hs", "k") + " SELECT CAST(k AS BIGINT) AS horizon, round(t_nw, 6) + 0.0 AS t_nw FROM nw"))
def crash_significance(spark: SparkSession, d: str) -> DataFrame:
    return tidy(tail.crash_spread(quantile.quantize(P.sample(spark, d))).select("horizon", "t_nw"))


@query("event_significance", sql(_EV, ", dy AS (SELECT rel_day, rel_date AS date, avg(car) v FROM ew GROUP BY ALL)" + _nw("dy", "rel_day", "v", "1") + """, st AS (SELECT rel_day, avg(car) * sqrt(count(car)) / nullif(stddev_samp(car), 0) t FROM ew GROUP BY rel_day)
  SELECT CAST(rel_day AS BIGINT) AS rel_day, round(t, 6) + 0.0 AS t_naive, CASE WHEN rel_day <> 0 THEN round(t_nw, 6) + 0.0 END AS t_nw FROM st JOIN nw ON nw.k = rel_day"""))
def event_significance(spark: SparkSession, d: str) -> DataFrame:
    out = event.event_summary(_windows(spark, d).rows)
    # day 0 is the base of every path: all its values are 0, and their t is undefined
    return tidy(out.select("rel_day", "t_naive", F.when(F.col("rel_day") != 0, F.col("t_nw")).alias("t_nw")))


@query("event_paths", sql(_EV, "SELECT 'surge' AS \"group\", CAST(rel_day AS BIGINT) AS rel_day, round(avg(car), 6) + 0.0 AS mean, count(car) AS n FROM ew GROUP BY rel_day"))
def event_paths(spark: SparkSession, d: str) -> DataFrame:
    return tidy(event.event_path_by_group(_windows(spark, d).rows, "event_type"))


@query("rank_stability", sql(DATA_SQL, """, z AS (SELECT date, asset, count(*) OVER (PARTITION BY date) n, row_number() OVER (PARTITION BY date ORDER BY factor, asset) - 1 r FROM data),
  b AS (SELECT z.*, floor(r * 10 / n) bin, dense_rank() OVER (ORDER BY date) p FROM z WHERE n >= 10),
  s AS (SELECT a.p, avg(CASE WHEN a.bin = c.bin THEN 1.0 ELSE 0.0 END) s FROM b a JOIN b c ON a.asset = c.asset AND a.p = c.p + 1 GROUP BY a.p)
  SELECT round(least(1, greatest(0, (avg(s) - 0.1) / 0.9)), 6) + 0.0 AS stability FROM s"""))
def rank_stability(spark: SparkSession, d: str) -> DataFrame:
    return tidy(spark.createDataFrame([(inference.rank_stability(P.sample(spark, d)),)], "stability double"))


_IC1 = RANKED_SQL + ", i1 AS (SELECT date, ic v, row_number() OVER (ORDER BY date) - 1 i, count(*) OVER () m FROM ic WHERE horizon = 1 AND ic IS NOT NULL)"


def _ic_one(spark: SparkSession, d: str) -> list:
    rows = ic.information_coefficient(P.sample(spark, d), [1]).where("ic IS NOT NULL").select("date", "ic")
    return sorted(map(tuple, rows.collect()))  # one value a period


@query("split_is_oos", sql(_IC1, """, sp AS (SELECT date, i, i >= floor(m * 0.7) AS later, (SELECT pos FROM cal WHERE cal.date = i1.date) pos FROM i1), ed AS (SELECT min(pos) edge FROM sp WHERE later)
  SELECT date, CASE WHEN later THEN 'out_of_sample' WHEN pos + 4 < edge THEN 'in_sample' ELSE 'purged' END AS part FROM sp, ed"""))
def split(spark: SparkSession, d: str) -> DataFrame:
    days = [x for x, _ in _ic_one(spark, d)]
    months = [r.date for r in P.calendar(P.prices(spark, d)).collect()]
    parts = portfolio.split_is_oos(days, ratio=0.7, calendar=months, purge_horizons=P.HORIZONS)
    named = {"in_sample": parts.in_sample, "out_of_sample": parts.out_of_sample, "purged": parts.purged}
    return spark.createDataFrame([(x, part) for part, dates in named.items() for x in dates], "date date, part string")


_DECAY = _IC1 + """, ft AS (SELECT regr_slope(v, i) slope, avg(v) mean, avg(i) mi, var_pop(i) * count(*) spread FROM i1),
  lf AS (SELECT date, i - mi t, v - mean - slope * (i - mi) e, slope, spread, mean FROM i1, ft), wt AS (SELECT date, 1 AS one, t * e v FROM lf)""" + _nw("wt", "one", "v", "1") + """,
  er AS (SELECT sqrt(sum(e * e) / (count(*) - 2) / any_value(spread)) plain FROM lf)"""


@query("decay_test", sql(_DECAY, """ SELECT n, round(slope, 6) + 0.0 AS slope, round(slope / plain, 6) + 0.0 AS t_naive, round(slope * spread / (std * sqrt(n * vif)), 6) + 0.0 AS t_nw,
  slope < 0 AND abs(slope * spread / (std * sqrt(n * vif))) > 2 AS decaying, CASE WHEN slope < 0 THEN round(abs(ft.mean / slope), 6) + 0.0 END AS half_life FROM ft, nw, er"""))
def decay(spark: SparkSession, d: str) -> DataFrame:
    got = inference.decay_test([v for _, v in _ic_one(spark, d)])
    names = "n slope t_naive t_nw decaying half_life".split()
    return tidy(spark.createDataFrame([tuple(got[x] for x in names)], "n long, slope double, t_naive double, t_nw double, decaying boolean, half_life double"))
