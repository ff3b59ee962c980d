"""Queries on panels: sources, calendars, adjustment, tradability, returns, cleaning, preparation, health, joins in time."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crosspanel.operators import asof, calendars, clean, contracts, health, preprocess, returns, tradability
from crosspanel.operators.adjust import compute_adj_factor, fill_prev_close
from crosspanel.plans import panels as P
from crosspanel.plans.panels import DATA_SQL, PX_SQL, scratch_dir, sql, tidy
from crosspanel.plans.registry import query
from crosspanel.sources import monthly
from crosspanel.streaming import runs as streams
from crosspanel.streaming.bars import daily_bars

Q6 = lambda *names: ", ".join(f"round({n}, 6) + 0.0 AS {n}" for n in names)


@query("monthly_panel", sql(PX_SQL, "SELECT date, asset, raw_open, raw_high, raw_low, raw_close, volume, n FROM px"))
def monthly_panel(spark: SparkSession, d: str) -> DataFrame:
    return P.prices(spark, d).select("date", "asset", "raw_open", "raw_high", "raw_low", "raw_close", "volume", "n")


@query("daily_bars", f"""WITH b AS (SELECT CAST(ts AS DATE) AS date, CAST(user_id AS VARCHAR) AS asset, (min(struct_pack(t := ts, v := value))).v raw_open, max(value) raw_high,
  min(value) raw_low, (max(struct_pack(t := ts, v := value))).v raw_close, count(*) AS volume FROM events GROUP BY 1, 2)
  SELECT date, asset, {Q6('raw_open', 'raw_high', 'raw_low', 'raw_close')}, volume FROM b""")
def daily(spark: SparkSession, d: str) -> DataFrame:
    return tidy(daily_bars(P.read(spark, d, "events")))


@query("calendar", sql(PX_SQL, "SELECT date, CAST(pos AS BIGINT) AS pos FROM cal"))
def calendar(spark: SparkSession, d: str) -> DataFrame:
    return tidy(P.calendar(P.prices(spark, d)))


@query("calendar_shift", sql(PX_SQL, "SELECT a.date, b.date AS later FROM cal a LEFT JOIN cal b ON b.pos = a.pos + 3"))
def calendar_shift(spark: SparkSession, d: str) -> DataFrame:
    cal = P.calendar(P.prices(spark, d))
    return calendars.shift_dates(cal.select("date"), cal, 3, "date", "later").select("date", "later")


@query("prev_close", sql(PX_SQL, f"SELECT date, asset, {Q6('prev_close')} FROM (SELECT *, lag(raw_close) OVER (PARTITION BY asset ORDER BY date) prev_close FROM px)"))
def prev_close(spark: SparkSession, d: str) -> DataFrame:
    return tidy(fill_prev_close(P.prices(spark, d)).select("date", "asset", "prev_close"))


_ADJ = PX_SQL + """,
ev AS (SELECT px.date, asset, 0.1 * (CAST(asset AS INT) % 5) fenhong, 1.0 + CAST(asset AS INT) % 3 songzhuangu FROM px JOIN cal USING (date) WHERE pos % 12 = 6),
pc AS (SELECT px.date, px.asset, raw_close c, (lag(raw_close) OVER w * 10 - coalesce(fenhong, 0)) / (10 + coalesce(songzhuangu, 0)) pre
  FROM px LEFT JOIN ev USING (date, asset) WINDOW w AS (PARTITION BY asset ORDER BY date)),
st AS (SELECT *, c / nullif(lead(pre) OVER (PARTITION BY asset ORDER BY date), 0) up, lead(pre) OVER (PARTITION BY asset ORDER BY date) / nullif(c, 0) down FROM pc)"""


@query("adj_factor_hfq", sql(_ADJ, """SELECT date, asset, round(coalesce(product(coalesce(up, 1)) OVER (PARTITION BY asset ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1), 6) + 0.0
  AS adj_factor FROM st"""))
def adj_hfq(spark: SparkSession, d: str) -> DataFrame:
    px = P.prices(spark, d)
    return tidy(compute_adj_factor(px, P.xdxr(px, P.calendar(px)), "hfq"))


@query("adj_factor_qfq", sql(_ADJ, """SELECT date, asset, round(product(coalesce(down, 1)) OVER (PARTITION BY asset ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 6) + 0.0
  AS adj_factor FROM st"""))
def adj_qfq(spark: SparkSession, d: str) -> DataFrame:
    px = P.prices(spark, d)
    return tidy(compute_adj_factor(px, P.xdxr(px, P.calendar(px)), "qfq"))


_TRADE = PX_SQL + """,
tr0 AS (SELECT px.date, asset, pos, raw_open, lag(raw_close) OVER (PARTITION BY asset ORDER BY px.date) prev_close,
  pos - min(pos) OVER (PARTITION BY asset) + 1 AS listed_days FROM px JOIN cal USING (date)),
tr1 AS (SELECT *, round_even(prev_close * (1 + 0.1) * 100, 0) / 100 up, round_even(prev_close * (1 - 0.1) * 100, 0) / 100 dn FROM tr0),
tr AS (SELECT date, asset, pos, listed_days, coalesce(raw_open >= up - 1e-6, false) at_up, coalesce(raw_open <= dn + 1e-6, false) at_dn, listed_days <= 3 AS new FROM tr1)"""


def _tradability(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    px = P.prices(spark, d)
    lists = px.groupBy("asset").agg(F.min("date").alias("list_date"))
    return px, tradability.compute_tradability(px, P.calendar(px), list_dates=lists, new_stock_days=3)


@query("tradability", sql(_TRADE, """SELECT date, asset, CAST(listed_days AS BIGINT) listed_days, at_up AS open_at_limit_up, at_dn AS open_at_limit_down, NOT (at_up OR new) AS can_buy_open, NOT at_dn AS can_sell_open,
  CASE WHEN new THEN 'new_stock' WHEN at_up THEN 'limit_up' ELSE 'ok' END AS reason_buy, CASE WHEN at_dn THEN 'limit_down' ELSE 'ok' END AS reason_sell FROM tr"""))
def tradable(spark: SparkSession, d: str) -> DataFrame:
    _, t = _tradability(spark, d)
    return tidy(t.select("date", "asset", "listed_days", "open_at_limit_up", "open_at_limit_down", "can_buy_open", "can_sell_open", "reason_buy", "reason_sell"))


@query("tradability_rates", sql(_TRADE, f"""SELECT date, {Q6('can_buy_open', 'can_sell_open')} FROM
  (SELECT date, avg(CASE WHEN at_up OR new THEN 0.0 ELSE 1.0 END) can_buy_open, avg(CASE WHEN at_dn THEN 0.0 ELSE 1.0 END) can_sell_open FROM tr GROUP BY date)"""))
def trade_rates(spark: SparkSession, d: str) -> DataFrame:
    return tidy(health.tradability_rates(_tradability(spark, d)[1].select("date", "can_buy_open", "can_sell_open")))


@query("forward_returns", sql(DATA_SQL, f"SELECT date, asset, {Q6('forward_return_1', 'forward_return_3')} FROM ret"))
def forward(spark: SparkSession, d: str) -> DataFrame:
    px = P.prices(spark, d)
    out = returns.forward_returns(px, P.calendar(px), P.HORIZONS)
    return tidy(out.select("date", "asset", "forward_return_1", "forward_return_3"))


@query("forward_returns_close", sql(PX_SQL, """SELECT date, asset, round(x / raw_close - 1, 6) + 0.0 AS forward_return_2 FROM (SELECT px.date, asset, raw_close,
  first_value(raw_close) OVER (PARTITION BY asset ORDER BY pos RANGE BETWEEN 2 FOLLOWING AND 2 FOLLOWING) x FROM px JOIN cal USING (date))"""))
def forward_close(spark: SparkSession, d: str) -> DataFrame:
    px = P.prices(spark, d)
    out = returns.forward_returns(px, P.calendar(px), [2], model=returns.ReturnModel(entry="close", exit_price="close"))
    return tidy(out.select("date", "asset", "forward_return_2"))


@query("forward_returns_delist", sql(PX_SQL, """SELECT date, asset, e < n AND x IS NULL AND e > last AS delisted_3, round((CASE WHEN e < n AND x IS NULL AND e > last THEN last_px * 0.7 ELSE x END) / raw_open - 1, 6) + 0.0 AS forward_return_3
  FROM (SELECT px.date, asset, raw_open, pos + 3 AS e, max(pos) OVER (PARTITION BY asset) last, last_value(raw_open) OVER (PARTITION BY asset ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) last_px,
  first_value(raw_open) OVER (PARTITION BY asset ORDER BY pos RANGE BETWEEN 3 FOLLOWING AND 3 FOLLOWING) x, (SELECT count(*) FROM cal) n FROM px JOIN cal USING (date))"""))
def forward_delist(spark: SparkSession, d: str) -> DataFrame:
    px = P.prices(spark, d)
    model = returns.ReturnModel(entry="same_open", delist_policy="haircut", delist_return=-0.3)
    return tidy(returns.forward_returns(px, P.calendar(px), [3], model=model).select("date", "asset", "delisted_3", "forward_return_3"))


_DELAY = _TRADE + """,
j AS (SELECT tr.*, raw_open, NOT (at_up OR new) buy, NOT at_dn sell FROM tr JOIN px USING (date, asset)),
dl AS (SELECT date, asset, first_value(raw_open) OVER (w RANGE BETWEEN 1 FOLLOWING AND 1 FOLLOWING) e, coalesce(first_value(buy) OVER (w RANGE BETWEEN 1 FOLLOWING AND 1 FOLLOWING), false) b,
  first_value(raw_open) OVER (w RANGE BETWEEN 3 FOLLOWING AND 3 FOLLOWING) x, coalesce(first_value(sell) OVER (w RANGE BETWEEN 3 FOLLOWING AND 3 FOLLOWING), false) s,
  min(CASE WHEN sell THEN struct_pack(p := pos, v := raw_open) END) OVER (w RANGE BETWEEN 4 FOLLOWING AND 6 FOLLOWING) later,
  pos + 3 > max(pos) OVER (PARTITION BY asset) AND pos + 3 < (SELECT count(*) FROM cal) gone FROM j WINDOW w AS (PARTITION BY asset ORDER BY pos)),
ex AS (SELECT date, asset, e, b, NOT (s AND x IS NOT NULL) AND NOT (gone AND x IS NULL) blocked, x, later FROM dl)"""


@query("forward_returns_delay", sql(_DELAY, """SELECT date, asset, blocked AND later IS NOT NULL AS exit_delayed_2,
  CASE WHEN b AND e IS NOT NULL AND NOT (blocked AND later IS NULL) THEN round((CASE WHEN blocked THEN later.v ELSE x END) / e - 1, 6) + 0.0 END AS forward_return_2 FROM ex"""))
def forward_delay(spark: SparkSession, d: str) -> DataFrame:
    px, t = _tradability(spark, d)
    out = returns.forward_returns(px, P.calendar(px), [2], tradability=t, model=returns.ReturnModel(exit_policy="delay"))
    return tidy(out.select("date", "asset", "exit_delayed_2", "forward_return_2"))


@query("return_ledger", sql(_DELAY, """SELECT CAST(2 AS BIGINT) AS horizon, reason, n FROM (
  WITH c AS (SELECT dl.date, asset, e, b, x, gone, first_value(CASE WHEN new THEN 'new_stock' WHEN at_up THEN 'limit_up' ELSE 'ok' END)
  OVER (PARTITION BY asset ORDER BY pos RANGE BETWEEN 1 FOLLOWING AND 1 FOLLOWING) why FROM dl JOIN tr USING (date, asset))
  SELECT 'limit_up' AS reason, count(*) FILTER (e IS NOT NULL AND why = 'limit_up') n FROM c UNION ALL SELECT 'new_stock', count(*) FILTER (e IS NOT NULL AND why = 'new_stock') FROM c
  UNION ALL SELECT 'no_entry_price', count(*) FILTER (e IS NULL) FROM c UNION ALL SELECT 'no_exit_price', count(*) FILTER (e IS NOT NULL AND x IS NULL) FROM c
  UNION ALL SELECT 'tradable', count(*) FILTER (b AND e IS NOT NULL AND x IS NOT NULL) FROM c UNION ALL SELECT 'total', count(*) FROM c
  UNION ALL SELECT 'dropped', count(*) FILTER (NOT (b AND e IS NOT NULL AND x IS NOT NULL)) FROM c
  UNION ALL SELECT 'delisted_dropped', count(*) FILTER (gone AND x IS NULL) FROM c) WHERE n > 0 OR reason IN ('tradable', 'total', 'dropped')"""))
def ledger(spark: SparkSession, d: str) -> DataFrame:
    px, t = _tradability(spark, d)
    return tidy(returns.return_ledger(returns.forward_returns(px, P.calendar(px), [2], tradability=t), [2]))


@query("clean_sample", sql(DATA_SQL, f"SELECT date, asset, {Q6('factor', 'forward_return_1', 'forward_return_3')} FROM data"))
def clean_sample(spark: SparkSession, d: str) -> DataFrame:
    return tidy(P.sample(spark, d))


_CLEAN = DATA_SQL + """,
cl AS (SELECT ret.date, ret.asset, CASE WHEN forward_return_1 IS NULL OR forward_return_3 IS NULL THEN 'no_return' WHEN px.n < 3 THEN 'not_in_universe' ELSE 'retained' END AS reason
  FROM ret JOIN px USING (date, asset))"""


@query("clean_ledger", sql(_CLEAN, "SELECT reason, count(*) AS count, round(count(*) / sum(count(*)) OVER (), 6) + 0.0 AS pct FROM cl GROUP BY reason"))
def clean_ledger(spark: SparkSession, d: str) -> DataFrame:
    px = P.prices(spark, d)
    universe = px.select("date", "asset", (F.col("n") >= 3).alias("in_universe"))
    out = clean.clean(P.factor(px), returns.forward_returns(px, P.calendar(px), P.HORIZONS), universe=universe).ledger()
    return tidy(out.select("reason", "count", "pct"))


def _factor_query(name: str, body: str, ctes: str = DATA_SQL):
    return query(name, sql(ctes, body))


@_factor_query("winsorize_mad", """SELECT date, asset, round(CASE WHEN h > 0 THEN greatest(m - h, least(m + h, factor)) ELSE factor END, 6) + 0.0 AS factor FROM
  (SELECT *, median(abs(factor - m)) OVER (PARTITION BY date) * 1.4826 * 3.0 h FROM (SELECT *, median(factor) OVER (PARTITION BY date) m FROM data))""")
def winsorize_mad(spark: SparkSession, d: str) -> DataFrame:
    return tidy(preprocess.winsorize(P.sample(spark, d)).select("date", "asset", "factor"))


@_factor_query("winsorize_quantile", """SELECT date, asset, round(CASE WHEN n >= 2 THEN greatest(lo, least(hi, factor)) ELSE factor END, 6) + 0.0 AS factor FROM (SELECT *, count(*) OVER (PARTITION BY date) n,
  quantile_cont(factor, 0.05) OVER (PARTITION BY date) lo, quantile_cont(factor, 0.95) OVER (PARTITION BY date) hi FROM data)""")
def winsorize_quantile(spark: SparkSession, d: str) -> DataFrame:
    return tidy(preprocess.winsorize(P.sample(spark, d), method="quantile", limits=(0.05, 0.95)).select("date", "asset", "factor"))


@_factor_query("winsorize_sigma", """SELECT date, asset, round(CASE WHEN s > 0 THEN greatest(m - s, least(m + s, factor)) ELSE factor END, 6) + 0.0 AS factor FROM (SELECT *, avg(factor) OVER (PARTITION BY date) m,
  stddev_samp(factor) OVER (PARTITION BY date) * 2.0 s FROM data)""")
def winsorize_sigma(spark: SparkSession, d: str) -> DataFrame:
    return tidy(preprocess.winsorize(P.sample(spark, d), method="sigma", n=2.0).select("date", "asset", "factor"))


@_factor_query("standardize_zscore", """SELECT date, asset, round(CASE WHEN s > 0 THEN (factor - m) / s ELSE factor END, 6) + 0.0 AS factor FROM (SELECT *, avg(factor) OVER (PARTITION BY date) m,
  stddev_samp(factor) OVER (PARTITION BY date) s FROM data)""")
def zscore(spark: SparkSession, d: str) -> DataFrame:
    return tidy(preprocess.standardize(P.sample(spark, d)).select("date", "asset", "factor"))


@_factor_query("standardize_rank", """SELECT date, asset, round((rank() OVER (PARTITION BY date ORDER BY factor) + (count(*) OVER (PARTITION BY date, factor) - 1) / 2.0 - 0.5) / count(*) OVER (PARTITION BY date), 6) + 0.0
  AS factor FROM data""")
def rank_standard(spark: SparkSession, d: str) -> DataFrame:
    return tidy(preprocess.standardize(P.sample(spark, d), method="rank").select("date", "asset", "factor"))


@_factor_query("neutralize_group", "SELECT date, asset, round(CASE WHEN grp IS NOT NULL THEN factor - avg(factor) OVER (PARTITION BY date, grp) END, 6) + 0.0 AS factor FROM gdata")
def neutral_group(spark: SparkSession, d: str) -> DataFrame:
    return tidy(preprocess.neutralize(P.sample(spark, d, True), groups="grp").select("date", "asset", "factor"))


@_factor_query("neutralize_exposure", """SELECT date, asset, round(CASE WHEN count(*) OVER w >= 10 THEN factor - avg(factor) OVER w - regr_slope(factor, ln_volume) OVER w * (ln_volume - avg(ln_volume) OVER w) END, 6) + 0.0 AS factor
  FROM data WINDOW w AS (PARTITION BY date)""")
def neutral_exposure(spark: SparkSession, d: str) -> DataFrame:
    return tidy(preprocess.neutralize(P.sample(spark, d, True), exposures=["ln_volume"]).select("date", "asset", "factor"))


@_factor_query("combine_factors", """SELECT date, asset, round((v - avg(v) OVER w) / nullif(stddev_samp(v) OVER w, 0), 6) + 0.0 AS factor FROM (SELECT date, asset, 0.75 * (factor - avg(factor) OVER w) / nullif(stddev_samp(factor) OVER w, 0)
  + 0.25 * (ln_volume - avg(ln_volume) OVER w) / nullif(stddev_samp(ln_volume) OVER w, 0) v FROM ret WINDOW w AS (PARTITION BY date)) WINDOW w AS (PARTITION BY date)""")
def combined(spark: SparkSession, d: str) -> DataFrame:
    px = P.prices(spark, d)
    return tidy(preprocess.combine({"a": P.factor(px), "b": P.second_factor(px)}, {"a": 3.0, "b": 1.0}))


@query("contract_rules", sql(PX_SQL, """, own AS (SELECT date, asset, n, volume FROM px UNION ALL SELECT date, asset, n, volume FROM px WHERE n >= 3),
  r AS (SELECT 'not_finite' AS rule, 'prev_close' AS "column", count(*) FILTER (n = 1) AS n FROM own UNION ALL SELECT 'not_positive', 'raw_low', count(*) FILTER (volume <= 20) FROM own UNION ALL SELECT 'not_positive', 'adj_low', count(*) FILTER (volume <= 20) FROM own
  UNION ALL SELECT 'adjust_incomplete', 'high', count(*) FILTER (n = 2) FROM own UNION ALL SELECT 'duplicate_key', 'date, asset', count(*) FROM (SELECT 1 FROM own GROUP BY date, asset HAVING count(*) > 1))
  SELECT 'prices' AS panel, * FROM r WHERE n > 0 UNION ALL SELECT 'factor', 'lookahead', 'available_at', count(*) FROM px WHERE volume > 30 UNION ALL SELECT 'factor', 'not_in_prices', 'date, asset', count(*) FROM px WHERE n = 4"""))
def contract_rules(spark: SparkSession, d: str) -> DataFrame:
    """Every rule that a damaged panel breaks, and how often."""
    px = P.prices(spark, d)
    low = F.when(F.col("volume") <= 20, -F.col("raw_low")).otherwise(F.col("raw_low"))
    damaged = px.withColumns({"prev_close": F.when(F.col("n") == 1, F.lit(float("inf"))).otherwise(F.col("raw_close")), "raw_low": low, "adj_low": low, "adj_high": F.when(F.col("n") != 2, F.col("raw_high"))})
    damaged = damaged.unionByName(damaged.where("n >= 3"))
    late = F.when(F.col("volume") > 30, F.date_add("date", 1)).otherwise(F.col("date"))
    elsewhere = F.when(F.col("n") == 4, F.concat(F.lit("x"), F.col("asset"))).otherwise(F.col("asset"))
    own = px.select("date", elsewhere.alias("asset"), (F.col("raw_open") / F.col("raw_close")).alias("value"), late.alias("available_at"))
    between = contracts.cross_rules({"factor": own, "prices": damaged}, P.calendar(px), least_coverage=0.0)
    found = contracts.rule_counts(damaged, contracts.PRICES, "prices").unionByName(contracts.rule_counts(own, contracts.FACTOR, "factor")).unionByName(between)
    return found.where("n > 0").select("panel", "rule", "column", "n")


@query("health_ohlc", sql(PX_SQL, """SELECT rule, n FROM (SELECT 'high_below_low' AS rule, count(*) FILTER (raw_high * 1.000001 < raw_low) n FROM px UNION ALL SELECT 'high_below_body', count(*) FILTER (raw_high * 1.000001 < greatest(raw_open, raw_close)) FROM px
  UNION ALL SELECT 'low_above_body', count(*) FILTER (raw_low > least(raw_open, raw_close) * 1.000001) FROM px UNION ALL SELECT 'not_positive', count(*) FILTER (least(raw_open, raw_high, raw_low, raw_close) <= 0) FROM px)"""))
def ohlc(spark: SparkSession, d: str) -> DataFrame:
    return health.ohlc_violations(P.prices(spark, d)).select("rule", "n")


@query("health_extreme_moves", sql(PX_SQL, """SELECT date, asset, round(m, 6) + 0.0 AS move, 'still_large' AS kind FROM (SELECT date, asset, raw_close / lag(raw_close) OVER (PARTITION BY asset ORDER BY date) - 1 m FROM px) WHERE abs(m) > 0.5"""))
def moves(spark: SparkSession, d: str) -> DataFrame:
    return tidy(health.extreme_moves(P.prices(spark, d)).select("date", "asset", "move", "kind"))


@query("health_coverage", sql(PX_SQL, """SELECT count(*) AS n_dates, median(n) AS median, count(*) FILTER (n < 0.5 * m) AS low_dates FROM (SELECT n, median(n) OVER () m FROM (SELECT date, count(*) n FROM px GROUP BY date))"""))
def cover(spark: SparkSession, d: str) -> DataFrame:
    return tidy(health.coverage(P.prices(spark, d)))


@query("health_survivorship", sql(PX_SQL, """SELECT count(*) AS n_assets, count(*) FILTER (pos < (SELECT max(pos) FROM cal) - 2) AS n_gone FROM (SELECT asset, max(pos) pos FROM px JOIN cal USING (date) GROUP BY asset)"""))
def survivors(spark: SparkSession, d: str) -> DataFrame:
    px = P.prices(spark, d)
    return health.survivorship(px, P.calendar(px), gone=2)


@query("health_longest_runs", """WITH e AS (SELECT CAST(user_id AS VARCHAR) asset, event_id AS date, event_type v FROM events), f AS (SELECT *, coalesce(CAST(v <> lag(v) OVER (PARTITION BY asset ORDER BY date) AS INT), 1) nw FROM e),
  g AS (SELECT *, sum(nw) OVER (PARTITION BY asset ORDER BY date ROWS UNBOUNDED PRECEDING) run FROM f) SELECT asset, max(n) AS longest FROM (SELECT asset, run, count(*) n FROM g GROUP BY ALL) GROUP BY asset""")
def runs(spark: SparkSession, d: str) -> DataFrame:
    e = P.read(spark, d, "events").select(F.col("event_id").alias("date"), F.col("user_id").cast("string").alias("asset"), F.col("event_type").alias("v"))
    return health.longest_runs(e, "v")


@query("health_suspension", sql(PX_SQL, "SELECT date, round(avg(CASE WHEN coalesce(volume, 0) <= 50 THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS share FROM px GROUP BY date"))
def suspended(spark: SparkSession, d: str) -> DataFrame:
    px = P.prices(spark, d).withColumn("volume", F.greatest(F.col("volume") - 50, F.lit(0.0)))
    return tidy(health.suspension_by_date(px))


@query("asof_backward", """SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, e.value AS last_value FROM (SELECT *, o_custkey % 50 AS k FROM orders) o ASOF LEFT JOIN
  (SELECT user_id % 50 AS k, CAST(ts AS DATE) - INTERVAL 9000 DAY AS d, max(value) AS value FROM events GROUP BY 1, 2) e ON o.k = e.k AND CAST(o_orderdate AS DATE) >= e.d""")
def asof_query(spark: SparkSession, d: str) -> DataFrame:
    orders = P.read(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("day"), (F.col("o_custkey") % 50).alias("k"))
    seen = P.read(spark, d, "events").select((F.col("user_id") % 50).alias("k"), F.date_sub(F.col("ts").cast("date"), 9000).alias("d"), "value")
    seen = seen.groupBy("k", "d").agg(F.max("value").alias("last_value"))
    return asof.asof_backward(orders, seen, ["k"], "day", "d", ["last_value"]).select("o_orderkey", "day", "last_value")


@query("interval_join", """WITH spans AS (SELECT p_size AS k, p_partkey, DATE '1992-01-01' + CAST(p_partkey % 2000 AS INT) AS s, DATE '1992-01-01' + CAST(p_partkey % 2000 + 200 AS INT) AS e FROM part),
  o AS (SELECT o_orderkey, o_custkey % 50 + 1 AS k, CAST(o_orderdate AS DATE) AS day FROM orders),
  m AS (SELECT o.o_orderkey, s, max(p_partkey) AS p FROM o JOIN spans USING (k) WHERE day BETWEEN s AND e GROUP BY 1, 2), b AS (SELECT o_orderkey, arg_max(p, s) AS p FROM m GROUP BY 1)
  SELECT o_orderkey, b.p AS part FROM o LEFT JOIN b USING (o_orderkey)""")
def interval_query(spark: SparkSession, d: str) -> DataFrame:
    start = F.date_add(F.lit("1992-01-01").cast("date"), (F.col("p_partkey") % 2000).cast("int"))
    spans = P.read(spark, d, "part").select(F.col("p_size").cast("long").alias("k"), start.alias("s"), F.date_add(start, 200).alias("e"), F.col("p_partkey").alias("part"))
    spans = spans.groupBy("k", "s", "e").agg(F.max("part").alias("part"))
    orders = P.read(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 50 + 1).alias("k"), F.col("o_orderdate").cast("date").alias("day"))
    return asof.interval_join(orders, spans, ["k"], "day", "s", "e", ["part"]).select("o_orderkey", "part")


@query("interval_open", """WITH spans AS (SELECT p_size % 3 AS k, DATE '1992-01-01' + CAST(p_partkey * 7 % 2400 AS INT) AS s, CASE WHEN p_partkey % 3 > 0 THEN DATE '1992-01-01' + CAST(p_partkey * 7 % 2400 + p_partkey % 700 AS INT) END AS e, p_partkey FROM part),
  o AS (SELECT o_orderkey, o_custkey % 4 AS k, CAST(o_orderdate AS DATE) AS day FROM orders),
  m AS (SELECT k, day, arg_max(p_partkey, (s, p_partkey)) AS p FROM (SELECT DISTINCT k, day FROM o) d JOIN spans USING (k) WHERE day >= s AND day <= coalesce(e, DATE '9999-12-30') GROUP BY 1, 2)
  SELECT o_orderkey, m.p AS part FROM o LEFT JOIN m USING (k, day)""")
def interval_open_query(spark: SparkSession, d: str) -> DataFrame:
    """Few keys, many spans that overlap, a third of them open."""
    key = F.col("p_partkey")
    start = F.date_add(F.lit("1992-01-01").cast("date"), (key * 7 % 2400).cast("int"))
    spans = P.read(spark, d, "part").select((F.col("p_size") % 3).cast("long").alias("k"), start.alias("s"), F.when(key % 3 > 0, F.date_add(start, (key % 700).cast("int"))).alias("e"), key.alias("part"))
    orders = P.read(spark, d, "orders").select("o_orderkey", (F.col("o_custkey") % 4).alias("k"), F.col("o_orderdate").cast("date").alias("day"))
    return asof.interval_join(orders, spans, ["k"], "day", "s", "e", ["part"]).select("o_orderkey", "part")


@query("asof_one_key", """SELECT l_orderkey, l_linenumber, best AS best_order, o.day AS ordered FROM (SELECT l_orderkey, l_linenumber, CAST(l_shipdate AS DATE) AS day FROM lineitem) l
  ASOF LEFT JOIN (SELECT CAST(o_orderdate AS DATE) AS day, max(o_orderkey) AS best FROM orders WHERE o_orderkey % 5 = 1 GROUP BY 1) o ON l.day >= o.day""")
def asof_one_key(spark: SparkSession, d: str) -> DataFrame:
    """All order lines under one key."""
    lines = P.read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_shipdate").cast("date").alias("day"), F.lit(1).alias("k"))
    orders = P.read(spark, d, "orders").where(F.col("o_orderkey") % 5 == 1).select(F.lit(1).alias("k"), F.col("o_orderdate").cast("date").alias("ordered"), F.col("o_orderkey").alias("best_order"))
    return asof.asof_backward(lines, orders, ["k"], "day", "ordered", ["best_order"]).select("l_orderkey", "l_linenumber", "best_order", F.col("ordered_matched").alias("ordered"))


@query("month_end", """WITH d AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS date FROM lineitem) SELECT CAST(date_trunc('month', date) AS DATE) AS month, max(date) AS date FROM d GROUP BY 1""")
def month_end(spark: SparkSession, d: str) -> DataFrame:
    days = P.read(spark, d, "lineitem").select(F.col("l_shipdate").cast("date").alias("date")).distinct()
    return asof.month_end_sessions(days)


@query("health_sessions", """WITH own AS (SELECT DISTINCT CAST(l_shipdate AS DATE) date FROM lineitem), cal AS (SELECT DISTINCT CAST(o_orderdate AS DATE) date FROM orders),
  e AS (SELECT min(date) lo, max(date) hi, median(g) median_gap FROM (SELECT date, date - lag(date) OVER (ORDER BY date) g FROM own)), m AS (SELECT cal.date FROM cal, e WHERE cal.date BETWEEN lo AND hi AND cal.date NOT IN (SELECT date FROM own))
  SELECT (SELECT count(*) FROM own WHERE date NOT IN (SELECT date FROM cal)) AS n_off, CAST(median_gap AS DOUBLE) AS median_gap, (SELECT count(*) FROM m) AS n_missing, (SELECT min(date) FROM m) AS first_missing FROM e""")
def health_sessions(spark: SparkSession, d: str) -> DataFrame:
    shipped = P.read(spark, d, "lineitem").select(F.col("l_shipdate").cast("date").alias("date"))
    return tidy(health.session_gaps(shipped, P.read(spark, d, "orders").select(F.col("o_orderdate").cast("date").alias("date"))))


_REGIONS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]


@query("pivot_wide", sql(PX_SQL, f"""SELECT date, {', '.join(f"round(max(raw_close) FILTER (r_name = '{r}'), 6) + 0.0 AS \"{r}\"" for r in _REGIONS)} FROM px
  JOIN (SELECT lpad(CAST(s_suppkey AS VARCHAR), 6, '0') asset, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey) USING (asset) GROUP BY date"""))
def wide(spark: SparkSession, d: str) -> DataFrame:
    by_region = P.prices(spark, d).join(P.groups(spark, d), "asset").groupBy("date", F.col("grp").alias("asset")).agg(F.max("raw_close").alias("raw_close"))
    return tidy(asof.to_wide(by_region, "raw_close", _REGIONS))


@query("pivot_months", sql(PX_SQL, f"SELECT asset, year(date) AS year, {', '.join(f'''round(max(raw_close) FILTER (month(date) = {i}), 6) + 0.0 AS m{i:02d}''' for i in range(1, 13))} FROM px GROUP BY asset, year(date)"))
def months_wide(spark: SparkSession, d: str) -> DataFrame:
    px = P.prices(spark, d).select("asset", F.year("date").alias("year"), F.date_format("date", "'m'MM").alias("month"), "raw_close")
    return tidy(asof.spread(px, ["asset", "year"], "month", [f"m{i:02d}" for i in range(1, 13)], "raw_close"))


@query("latest_version", """SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) rn FROM orders) WHERE rn = 1""")
def newest(spark: SparkSession, d: str) -> DataFrame:
    orders = P.read(spark, d, "orders").withColumn("version", F.struct("o_orderdate", "o_orderkey"))
    return asof.latest_version(orders, ["o_custkey"], "version").select("o_custkey", "o_orderkey")


@query("first_session_after", sql(PX_SQL, "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, (SELECT min(date) FROM cal WHERE cal.date > CAST(o_orderdate AS DATE)) AS available FROM orders"))
def first_session_after(spark: SparkSession, d: str) -> DataFrame:
    orders = P.read(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("day"))
    return tidy(asof.first_session_after(orders, P.calendar(P.prices(spark, d)), "day", "available"))


@query("winsorize_pooled", sql(PX_SQL, f""", f AS (SELECT date, asset, ln(volume) v FROM px), md AS (SELECT median(v) m FROM f), h AS (SELECT 1.4826 * 3 * median(abs(v - m)) h FROM f, md)
  SELECT date, asset, round(greatest(m - h, least(m + h, v)), 6) + 0.0 AS factor FROM f, md, h"""))
def winsorize_pooled(spark: SparkSession, d: str) -> DataFrame:
    return tidy(preprocess.winsorize(P.second_factor(P.prices(spark, d)), by_date=False))


@query("rank_pooled", sql(PX_SQL, """, f AS (SELECT date, asset, volume v FROM px)
  SELECT date, asset, round((rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0 - 0.5) / count(*) OVER (), 6) + 0.0 AS factor FROM f"""))
def rank_pooled(spark: SparkSession, d: str) -> DataFrame:
    return tidy(preprocess.standardize(P.second_factor(P.prices(spark, d)), method="rank", by_date=False))


_ORTHOGONAL = DATA_SQL + """,
mm AS (SELECT date, count(*) n, covar_pop(factor, ln_volume) ya, covar_pop(factor, forward_return_1) yb, var_pop(ln_volume) aa, var_pop(forward_return_1) bb, covar_pop(ln_volume, forward_return_1) ab,
  avg(factor) my, avg(ln_volume) ma, avg(forward_return_1) mb FROM data GROUP BY date),
bt AS (SELECT *, (ya * bb - yb * ab) / (aa * bb - ab * ab) b1, (yb * aa - ya * ab) / (aa * bb - ab * ab) b2 FROM mm WHERE n >= 10)"""


@query("orthogonalize", sql(_ORTHOGONAL, """SELECT d.date, d.asset, round(factor - my - b1 * (ln_volume - ma) - b2 * (forward_return_1 - mb), 6) + 0.0 AS factor FROM data d LEFT JOIN bt USING (date)"""))
def orthogonal(spark: SparkSession, d: str) -> DataFrame:
    data = P.sample(spark, d, True).select("date", "asset", "factor", "ln_volume", "forward_return_1")
    return tidy(preprocess.orthogonalize(data, "factor", ["ln_volume", "forward_return_1"]).select("date", "asset", "factor"))


@query("monthly_source", sql(PX_SQL, "SELECT date, asset, round(raw_close, 6) + 0.0 AS raw_close, n FROM px WHERE date >= DATE '1993-03-01' AND date < DATE '1996-02-01'"))
def monthly_source(spark: SparkSession, d: str) -> DataFrame:
    """The panel written to month folders and read again between two dates: other months are not opened."""
    monthly.register(spark)
    path = f"{scratch_dir(spark)}/panel-{uuid.uuid4().hex}"
    P.prices(spark, d).select("date", "asset", "raw_close", "n").write.format(monthly.NAME).mode("append").save(path)
    return tidy(spark.read.format(monthly.NAME).load(path).where("date >= DATE '1993-03-01' AND date < DATE '1996-02-01'"))


@query("preprocess_log", sql(DATA_SQL, """, la AS (SELECT *, median(factor) OVER (PARTITION BY date) mid FROM data), lb AS (SELECT *, 1.4826 * 1.5 * median(abs(factor - mid)) OVER (PARTITION BY date) half, count(factor) OVER (PARTITION BY date) c FROM la),
  lw AS (SELECT *, CASE WHEN c >= 2 AND half > 0 THEN greatest(mid - half, least(mid + half, factor)) ELSE factor END v FROM lb), lz AS (SELECT *, stddev_samp(v) OVER (PARTITION BY date) sd, avg(v) OVER (PARTITION BY date) m FROM lw),
  ln3 AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY date) >= 12 THEN 0 END v3 FROM lz)
  SELECT 'winsorize' AS step, count(*) AS n_rows, count(*) FILTER (v <> factor) AS n_changed, count(DISTINCT CASE WHEN NOT (c >= 2 AND half > 0) THEN date END) AS n_skipped_sections FROM lw
  UNION ALL SELECT 'standardize', count(*), count(*) FILTER (sd > 0 AND (v - m) / sd <> v), count(DISTINCT CASE WHEN NOT coalesce(sd > 0, false) THEN date END) FROM lz
  UNION ALL SELECT 'neutralize_exposures', count(*), count(*), count(DISTINCT CASE WHEN v3 IS NULL THEN date END) FROM ln3"""))
def preprocess_log(spark: SparkSession, d: str) -> DataFrame:
    """What three steps did, counted in the pass that makes their result; that pass runs when the query is built."""
    log, data = preprocess.PreprocessLog(), P.sample(spark, d, True)
    data = preprocess.standardize(preprocess.winsorize(data, n=1.5, log=log), log=log)
    preprocess.neutralize(data, exposures=["ln_volume"], min_obs=12, log=log).write.format("noop").mode("overwrite").save()
    return log.frame(spark)


@query("activity_sessions", """WITH e AS (SELECT CAST(user_id AS VARCHAR) AS asset, CAST(ts AS TIMESTAMP) AS ts, value, CASE WHEN CAST(ts AS TIMESTAMP) - lag(CAST(ts AS TIMESTAMP)) OVER w <= INTERVAL 12 HOUR THEN 0 ELSE 1 END AS new
  FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY asset ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM e)
  SELECT asset, epoch_us(min(ts)) AS start_us, epoch_us(max(ts) + INTERVAL 12 HOUR) AS end_us, count(*) AS n, round(sum(value), 6) + 0.0 AS total FROM s GROUP BY asset, session""")
def activity_sessions(spark: SparkSession, d: str) -> DataFrame:
    events = P.read(spark, d, "events").select(F.col("user_id").cast("string").alias("asset"), F.col("ts").cast("timestamp").alias("ts"), "value")
    found = streams.activity_sessions(events, "asset", "ts", "value", "12 hours")
    return tidy(found.select("asset", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "n", "total"))


@query("suspension_runs", sql(PX_SQL, """, v AS (SELECT date, asset, volume <= 50 AS idle FROM px), r AS (SELECT *, sum(CASE WHEN idle THEN 0 ELSE 1 END) OVER (PARTITION BY asset ORDER BY date) AS run, max(CASE WHEN NOT idle THEN date END) OVER (PARTITION BY asset) AS last FROM v)
  SELECT asset, min(date) AS start, max(date) AS "end", count(*) AS n, 'ended' AS kind FROM r WHERE idle GROUP BY asset, run, last HAVING max(date) < last"""))
def suspension_runs(spark: SparkSession, d: str) -> DataFrame:
    px = P.prices(spark, d).select("date", "asset", F.greatest(F.col("volume") - 50, F.lit(0.0)).alias("volume"))
    return streams.suspension_runs(px)
