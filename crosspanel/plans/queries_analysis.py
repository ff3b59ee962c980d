"""Queries on the cleaned sample: information coefficients, quantiles, sorts, groups, turnover, correlation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crosspanel.operators import correlation, group, ic, quantile, redraws
from crosspanel.plans import panels as P
from crosspanel.plans.panels import DATA_SQL, PX_SQL, QUANT_SQL, RANKED_SQL, sql, tidy
from crosspanel.plans.registry import query


def _q(*names: str) -> str:
    return ", ".join(f"round({n}, 6) + 0.0 AS {n}" for n in names)


@query("ic", sql(RANKED_SQL, f"SELECT date, CAST(horizon AS BIGINT) AS horizon, {_q('ic')}, n FROM ic"))
def ic_query(spark: SparkSession, d: str) -> DataFrame:
    return tidy(ic.information_coefficient(P.sample(spark, d), complete=True))


@query("ic_pearson", sql(DATA_SQL, "SELECT date, CAST(horizon AS BIGINT) AS horizon, round(corr(factor, r), 6) + 0.0 AS ic, count(*) AS n FROM long GROUP BY date, horizon"))
def ic_pearson(spark: SparkSession, d: str) -> DataFrame:
    return tidy(ic.information_coefficient(P.sample(spark, d), method="pearson", complete=True))


IC_SUMMARY_SQL = """SELECT CAST(horizon AS BIGINT) AS horizon, n, round(mean, 6) + 0.0 AS mean, round(std, 6) + 0.0 AS std, round(mean / nullif(std, 0), 6) + 0.0 AS icir, round(mean / nullif(std, 0) * sqrt(n), 6) + 0.0 AS t_naive,
  round(positive_rate, 6) + 0.0 AS positive_rate, round(abs_mean, 6) + 0.0 AS abs_mean FROM (SELECT horizon, count(ic) n, avg(ic) mean, stddev_samp(ic) std, avg(CASE WHEN ic > 0 THEN 1.0 WHEN ic IS NOT NULL THEN 0.0 END) positive_rate,
  avg(abs(ic)) abs_mean FROM ic GROUP BY horizon)"""


@query("ic_decay", sql(RANKED_SQL, IC_SUMMARY_SQL))
def ic_decay(spark: SparkSession, d: str) -> DataFrame:
    return tidy(ic.ic_decay(P.sample(spark, d), complete=True))


@query("rolling_ic", sql(RANKED_SQL, """SELECT date, CAST(horizon AS BIGINT) AS horizon, round(CASE WHEN count(ic) OVER w >= 10 THEN avg(ic) OVER w END, 6) + 0.0 AS rolling_ic FROM ic
  WINDOW w AS (PARTITION BY horizon ORDER BY date ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)"""))
def rolling(spark: SparkSession, d: str) -> DataFrame:
    return tidy(ic.rolling_ic(ic.information_coefficient(P.sample(spark, d), complete=True), window=12))


@query("rank_autocorrelation", sql(DATA_SQL, """, pd AS (SELECT date, row_number() OVER (ORDER BY date) p FROM (SELECT DISTINCT date FROM data)), x AS (SELECT date, p, asset, factor FROM data JOIN pd USING (date)),
  pr AS (SELECT a.date, a.factor f, b.factor g FROM x a JOIN x b ON a.asset = b.asset AND a.p = b.p + 1),
  rk AS (SELECT date, rank() OVER (PARTITION BY date ORDER BY f) + (count(*) OVER (PARTITION BY date, f) - 1) / 2.0 rf, rank() OVER (PARTITION BY date ORDER BY g) + (count(*) OVER (PARTITION BY date, g) - 1) / 2.0 rg FROM pr)
  SELECT date, round(corr(rf, rg), 6) + 0.0 AS autocorrelation, count(*) AS n FROM rk GROUP BY date""").replace("data))\n", "data))\n"))
def autocorrelation(spark: SparkSession, d: str) -> DataFrame:
    return tidy(ic.rank_autocorrelation(P.sample(spark, d)))


@query("quantize", sql(QUANT_SQL, "SELECT date, asset, CAST(factor_quantile AS BIGINT) AS factor_quantile FROM lab"))
def quantize(spark: SparkSession, d: str) -> DataFrame:
    return tidy(quantile.quantize(P.sample(spark, d)).select("date", "asset", "factor_quantile"))


_TURN = QUANT_SQL + """,
pd AS (SELECT date, row_number() OVER (ORDER BY date) p FROM (SELECT DISTINCT date FROM lab)), m AS (SELECT p, asset, factor_quantile q FROM lab JOIN pd USING (date) WHERE factor_quantile IS NOT NULL),
b AS (SELECT p + 1 AS p, asset, q FROM m), u AS (SELECT coalesce(m.p, b.p) p, coalesce(m.q, b.q) q, m.asset IS NOT NULL isin, b.asset IS NOT NULL was FROM m FULL JOIN b ON m.p = b.p AND m.q = b.q AND m.asset = b.asset),
tn AS (SELECT p, q, count(*) FILTER (isin) size, count(*) FILTER (isin AND NOT was) new, count(*) either, count(*) FILTER (isin AND was) stay, count(*) FILTER (was) had FROM u WHERE p >= 2 AND p <= (SELECT max(p) FROM pd) GROUP BY p, q)"""


@query("turnover", sql(_TURN, "SELECT date, CAST(q AS BIGINT) AS factor_quantile, round(new / size, 6) + 0.0 AS turnover FROM tn JOIN pd USING (p) WHERE had > 0 AND size > 0"))
def turnover(spark: SparkSession, d: str) -> DataFrame:
    return tidy(ic.quantile_turnover(quantile.quantize(P.sample(spark, d))))


@query("turnover_symmetric", sql(_TURN, "SELECT date, CAST(q AS BIGINT) AS factor_quantile, round((either - stay) / either / 2, 6) + 0.0 AS turnover FROM tn JOIN pd USING (p) WHERE had > 0 AND size > 0"))
def turnover_symmetric(spark: SparkSession, d: str) -> DataFrame:
    return tidy(ic.quantile_turnover(quantile.quantize(P.sample(spark, d)), method="symmetric"))


@query("quantile_returns", sql(QUANT_SQL, f"SELECT date, CAST(factor_quantile AS BIGINT) AS factor_quantile, {_q('forward_return_1', 'forward_return_3')}, count FROM qr"))
def quantile_returns(spark: SparkSession, d: str) -> DataFrame:
    return tidy(quantile.quantile_returns(P.sample(spark, d)))


_STATS = QUANT_SQL + """,
ql AS (SELECT date, factor_quantile q, h AS horizon, CASE h WHEN 1 THEN forward_return_1 ELSE forward_return_3 END r, count c FROM qr, (VALUES (1), (3)) v(h)),
bn AS (SELECT horizon, q, avg(r) mean, avg(c) mean_count, count(DISTINCT date) n_periods FROM ql GROUP BY horizon, q),
mo AS (SELECT horizon, corr(q, rk) monotonicity FROM (SELECT *, rank() OVER (PARTITION BY horizon ORDER BY mean) rk FROM bn) GROUP BY horizon),
sp AS (SELECT horizon, avg(s) spread, avg(s) * sqrt(count(s)) / stddev_samp(s) t_naive FROM (SELECT date, horizon, avg(r) FILTER (q = 5) - avg(r) FILTER (q = 1) s FROM ql GROUP BY date, horizon) GROUP BY horizon)"""


@query("quantile_stats", sql(_STATS, f"SELECT CAST(horizon AS BIGINT) AS horizon, CAST(q AS BIGINT) AS factor_quantile, {_q('mean', 'mean_count')}, n_periods, {_q('spread', 't_naive', 'monotonicity')} FROM bn JOIN sp USING (horizon) JOIN mo USING (horizon)"))
def quantile_stats(spark: SparkSession, d: str) -> DataFrame:
    return tidy(quantile.quantile_stats(P.sample(spark, d)))


@query("monotonicity", sql(_STATS, "SELECT CAST(mo.horizon AS BIGINT) AS horizon, round(monotonicity, 6) + 0.0 AS spearman, max(n_periods) AS n_periods, abs(monotonicity) >= 0.9 AS monotonic FROM mo JOIN bn USING (horizon) GROUP BY ALL"))
def monotonicity(spark: SparkSession, d: str) -> DataFrame:
    return tidy(quantile.monotonicity_test(P.sample(spark, d)))


@query("factor_returns", sql(_STATS, """SELECT date, round(avg(r) FILTER (q = 5 AND horizon = 1) - avg(r) FILTER (q = 1 AND horizon = 1), 6) + 0.0 AS forward_return_1,
  round(avg(r) FILTER (q = 5 AND horizon = 3) - avg(r) FILTER (q = 1 AND horizon = 3), 6) + 0.0 AS forward_return_3 FROM ql GROUP BY date"""))
def factor_returns(spark: SparkSession, d: str) -> DataFrame:
    return tidy(quantile.factor_returns(P.sample(spark, d)))


_SORT = DATA_SQL + """,
e1 AS (SELECT *, list_distinct(quantile_cont(ln_volume, [0.0, 1/3.0, 2/3.0, 1.0]) OVER (PARTITION BY date)) es FROM data),
b1 AS (SELECT *, greatest(1, len(list_filter(es, lambda e: ln_volume > e))) bq FROM e1 WHERE len(es) > 1),
e2 AS (SELECT *, list_distinct(quantile_cont(factor, [0.0, 1/3.0, 2/3.0, 1.0]) OVER (PARTITION BY date, bq)) es2, count(*) OVER (PARTITION BY date, bq) sz FROM b1),
b2 AS (SELECT date, bq, greatest(1, len(list_filter(es2, lambda e: factor > e))) fq, forward_return_1 r FROM e2 WHERE sz >= 3 AND len(es2) > 1),
cl AS (SELECT date, bq, fq, avg(r) r, count(*) c FROM b2 GROUP BY ALL)"""


_SORT2 = _SORT.replace("forward_return_1 r FROM e2", "forward_return_1 r, forward_return_3 r3 FROM e2") + """,
cl2 AS (SELECT date, bq, fq, h, avg(CASE h WHEN 1 THEN r ELSE r3 END) r FROM b2, (VALUES (1), (3)) v(h) GROUP BY date, bq, fq, h)"""


@query("double_sort_monotonicity", sql(_SORT, """, mm AS (SELECT bq, fq, avg(r) m FROM cl GROUP BY bq, fq UNION ALL SELECT 0, fq, avg(r) FROM cl GROUP BY fq),
  rk AS (SELECT *, rank() OVER (PARTITION BY bq ORDER BY m) + (count(*) OVER (PARTITION BY bq, m) - 1) / 2.0 k FROM mm)
  SELECT CAST(bq AS BIGINT) AS by_quantile, CAST(1 AS BIGINT) AS horizon, CASE WHEN count(*) >= 3 AND min(k) < max(k) THEN round(corr(fq, k), 6) + 0.0 END AS spearman FROM rk GROUP BY bq"""))
def double_sort_monotonicity(spark: SparkSession, d: str) -> DataFrame:
    return tidy(quantile.double_sort_monotonicity(P.sample(spark, d, True), "ln_volume", 3, 3, "conditional", [1]))


@query("monotonicity_rollup", sql(_SORT2, """, mm AS (SELECT grouping(h) + grouping(bq) lv, h, bq, fq, avg(r) m, count(r) c FROM cl2 WHERE r IS NOT NULL GROUP BY GROUPING SETS ((h, bq, fq), (h, fq), (fq))),
  rk AS (SELECT *, rank() OVER (PARTITION BY lv, h, bq ORDER BY m) + (count(*) OVER (PARTITION BY lv, h, bq, m) - 1) / 2.0 k FROM mm)
  SELECT CAST(lv AS BIGINT) AS level, CAST(h AS BIGINT) AS horizon, CAST(bq AS BIGINT) AS by_quantile, count(*) AS n_bins, CAST(sum(c) AS BIGINT) AS n_periods, round(avg(m), 6) + 0.0 AS mean,
  CASE WHEN count(*) >= 3 AND min(k) < max(k) THEN round(corr(fq, k), 6) + 0.0 END AS spearman FROM rk GROUP BY lv, h, bq"""))
def monotonicity_rollup(spark: SparkSession, d: str) -> DataFrame:
    return tidy(quantile.monotonicity_rollup(P.sample(spark, d, True), "ln_volume", 3, 3, "conditional"))


@query("double_sort", sql(_SORT, """SELECT CAST(bq AS BIGINT) AS by_quantile, CAST(fq AS BIGINT) AS factor_quantile, round(avg(r), 6) + 0.0 AS mean, count(r) AS n_periods, CAST(sum(c) AS BIGINT) AS n_obs FROM cl GROUP BY bq, fq"""))
def double_sort(spark: SparkSession, d: str) -> DataFrame:
    out = quantile.double_sort(P.sample(spark, d, True), "ln_volume", 3, 3, "conditional", [1])
    return tidy(out.select("by_quantile", "factor_quantile", "mean", "n_periods", "n_obs"))


@query("weighted_returns", sql(DATA_SQL, f"""SELECT date, {_q('forward_return_1', 'forward_return_3')} FROM (SELECT date, sum(ln_volume * forward_return_1) / sum(ln_volume) forward_return_1,
  sum(ln_volume * forward_return_3) / sum(ln_volume) forward_return_3 FROM data GROUP BY date)"""))
def weighted(spark: SparkSession, d: str) -> DataFrame:
    return tidy(quantile.weighted_returns(P.sample(spark, d, True), "ln_volume"))


_GROUPED = DATA_SQL + """,
gl AS (SELECT date, grp, horizon, factor, r FROM (SELECT date, grp, factor, h AS horizon, CASE h WHEN 1 THEN forward_return_1 ELSE forward_return_3 END r FROM gdata, (VALUES (1), (3)) v(h)) WHERE grp IS NOT NULL),
gr AS (SELECT *, rank() OVER (PARTITION BY date, grp, horizon ORDER BY factor) + (count(*) OVER (PARTITION BY date, grp, horizon, factor) - 1) / 2.0 rf,
  rank() OVER (PARTITION BY date, grp, horizon ORDER BY r) + (count(*) OVER (PARTITION BY date, grp, horizon, r) - 1) / 2.0 rr FROM gl),
gi0 AS (SELECT date, grp, horizon, count(*) n, CASE WHEN count(*) >= 5 AND min(rf) < max(rf) AND min(rr) < max(rr) THEN round(corr(rf, rr), 12) + 0.0 END ic, min(rf) < max(rf) AND min(rr) < max(rr) varied FROM gr GROUP BY ALL),
gi AS (SELECT *, CASE WHEN n < 5 THEN 'too_small' WHEN ic IS NULL THEN 'constant' END reason FROM gi0)"""


@query("grouped_ic", sql(_GROUPED, f"SELECT date, grp AS \"group\", CAST(horizon AS BIGINT) AS horizon, {_q('ic')}, n, reason FROM gi"))
def grouped(spark: SparkSession, d: str) -> DataFrame:
    return tidy(group.grouped_ic(P.sample(spark, d, True), "grp"))


@query("weighted_group_ic", sql(_GROUPED, "SELECT date, CAST(horizon AS BIGINT) AS horizon, round(sum(ic * n) / nullif(sum(n) FILTER (ic IS NOT NULL), 0), 6) + 0.0 AS ic FROM gi GROUP BY date, horizon"))
def weighted_group(spark: SparkSession, d: str) -> DataFrame:
    return tidy(group.weighted_ic(group.grouped_ic(P.sample(spark, d, True), "grp")))


@query("within_group_rank_ic", sql(_GROUPED, "SELECT date, CAST(horizon AS BIGINT) AS horizon, round(corr(rf, rr), 6) + 0.0 AS ic FROM gr GROUP BY date, horizon"))
def within_group(spark: SparkSession, d: str) -> DataFrame:
    return tidy(group.within_group_rank_ic(P.sample(spark, d, True), "grp"))


@query("group_summary", sql(_GROUPED, """SELECT grp AS "group", CAST(horizon AS BIGINT) AS horizon, count(ic) AS n_periods, round(avg(ic), 6) + 0.0 AS mean, round(median(ic), 6) + 0.0 AS median, round(stddev_samp(ic), 6) + 0.0 AS std,
  round(avg(ic) / nullif(stddev_samp(ic), 0), 6) + 0.0 AS icir, round(avg(CASE WHEN ic > 0 THEN 1.0 WHEN ic IS NOT NULL THEN 0.0 END), 6) + 0.0 AS positive_rate FROM gi GROUP BY grp, horizon"""))
def group_summary(spark: SparkSession, d: str) -> DataFrame:
    return tidy(group.grouped_summary(group.grouped_ic(P.sample(spark, d, True), "grp")))


@query("group_consistency", sql(RANKED_SQL.replace("ic AS (SELECT", "allic AS (SELECT") + _GROUPED.removeprefix(DATA_SQL), """, jn AS (SELECT gi.*, allic.ic AS aic FROM gi JOIN allic USING (date, horizon) WHERE gi.ic IS NOT NULL),
  mn AS (SELECT grp, horizon, avg(ic) m FROM jn GROUP BY ALL) SELECT grp AS "group", CAST(horizon AS BIGINT) AS horizon, round(any_value(m), 6) + 0.0 AS mean, CAST(sign(any_value(m)) AS DOUBLE) AS sign,
  round(avg(CASE WHEN sign(ic) = sign(m) THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS same_sign_rate, round(avg(CASE WHEN sign(ic) = sign(aic) THEN 1.0 ELSE 0.0 END), 6) + 0.0 AS sign_vs_global_rate FROM jn JOIN mn USING (grp, horizon) GROUP BY grp, horizon"""))
def consistency(spark: SparkSession, d: str) -> DataFrame:
    data = P.sample(spark, d, True)
    return tidy(group.group_consistency(group.grouped_ic(data, "grp"), ic.information_coefficient(data)))


_PAIRS = PX_SQL + """,
ff AS (SELECT date, asset, raw_open / raw_close a, ln(volume) b, raw_close c FROM px), pl AS (SELECT date, 'a' fa, 'b' fb, a x, b y FROM ff UNION ALL SELECT date, 'a', 'c', a, c FROM ff UNION ALL SELECT date, 'b', 'c', b, c FROM ff),
prk AS (SELECT *, rank() OVER (PARTITION BY date, fa, fb ORDER BY x) + (count(*) OVER (PARTITION BY date, fa, fb, x) - 1) / 2.0 rx, rank() OVER (PARTITION BY date, fa, fb ORDER BY y) + (count(*) OVER (PARTITION BY date, fa, fb, y) - 1) / 2.0 ry FROM pl),
pc AS (SELECT date, fa, fb, CASE WHEN count(*) >= 3 THEN corr(rx, ry) END rho, count(*) n FROM prk GROUP BY ALL)"""


def _factors(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    px = P.prices(spark, d)
    return {"a": P.factor(px), "b": P.second_factor(px), "c": px.select("date", "asset", F.col("raw_close").alias("factor"))}


@query("factor_correlation", sql(_PAIRS, """SELECT fa AS factor_a, fb AS factor_b, count(rho) AS n_periods, round(avg(rho), 6) + 0.0 AS mean, round(median(rho), 6) + 0.0 AS median, round(stddev_samp(rho), 6) + 0.0 AS std,
  round(avg(CASE WHEN rho > 0 THEN 1.0 WHEN rho IS NOT NULL THEN 0.0 END), 6) + 0.0 AS positive_rate, round(avg(rho) / stddev_samp(rho), 6) + 0.0 AS icir, count_if(n >= 3)::BIGINT AS n_overlap, count(rho) >= 20 AS comparable FROM pc GROUP BY fa, fb"""))
def factor_correlation(spark: SparkSession, d: str) -> DataFrame:
    return tidy(correlation.factor_correlation(_factors(spark, d)).drop("reason"))


@query("redundancy", sql(_PAIRS, "SELECT fb AS factor, round(avg(rho), 6) + 0.0 AS mean, count(rho) AS n_periods, abs(avg(rho)) >= 0.3 AS redundant FROM pc WHERE fa = 'a' GROUP BY fb HAVING count(rho) >= 20"))
def redundancy(spark: SparkSession, d: str) -> DataFrame:
    f = _factors(spark, d)
    out = correlation.redundancy_check(f["a"], {"b": f["b"], "c": f["c"]}, threshold=0.3)
    return tidy(out.select("factor", "mean", "n_periods", "redundant"))


@query("correlation_matrix", sql(_PAIRS, """, m AS (SELECT fa, fb, CASE WHEN count(rho) >= 20 THEN avg(rho) END r FROM pc GROUP BY fa, fb), s AS (SELECT fa, fb, r FROM m UNION ALL SELECT fb, fa, r FROM m
  UNION ALL SELECT x, x, 1.0 FROM (VALUES ('a'), ('b'), ('c')) v(x)) SELECT fa AS factor, round(max(r) FILTER (fb = 'a'), 6) + 0.0 AS a, round(max(r) FILTER (fb = 'b'), 6) + 0.0 AS b, round(max(r) FILTER (fb = 'c'), 6) + 0.0 AS c FROM s GROUP BY fa"""))
def correlation_square(spark: SparkSession, d: str) -> DataFrame:
    return tidy(correlation.correlation_matrix(correlation.factor_correlation(_factors(spark, d)), ["a", "b", "c"]))


@query("ic_rollup", sql(_GROUPED, """SELECT CAST(grouping(horizon) + grouping(grp) AS BIGINT) AS level, CAST(horizon AS BIGINT) AS horizon, grp AS "group", count(ic) AS n_cells, round(avg(ic), 6) + 0.0 AS mean, round(stddev_samp(ic), 6) + 0.0 AS std,
  round(avg(CASE WHEN ic > 0 THEN 1.0 WHEN ic IS NOT NULL THEN 0.0 END), 6) + 0.0 AS positive_rate, count(*) - count(ic) AS n_skipped, round(avg(ic) / nullif(stddev_samp(ic), 0), 6) + 0.0 AS icir FROM gi GROUP BY ROLLUP (horizon, grp)"""))
def ic_rollup(spark: SparkSession, d: str) -> DataFrame:
    return tidy(group.ic_rollup(group.grouped_ic(P.sample(spark, d, True), "grp")))


_WEIGHT = " + ".join(f"CAST(u >= {c!r} AS INT)" for c in redraws.POISSON)


@query("redraws", sql(RANKED_SQL, f""", u AS (SELECT horizon, ic, k, CAST('0x' || substr(md5('0|' || k || '|' || date), 1, 12) AS BIGINT) / CAST(281474976710656 AS DOUBLE) u FROM ic, range(50) t(k) WHERE ic IS NOT NULL),
  v AS (SELECT horizon, k, sum(ic * w) / sum(w) v FROM (SELECT *, {_WEIGHT} w FROM u) WHERE w > 0 GROUP BY horizon, k), b AS (SELECT horizon, count(ic) n, avg(ic) base FROM ic WHERE ic IS NOT NULL GROUP BY horizon)
  SELECT CAST(horizon AS BIGINT) AS horizon, n, round(base, 6) + 0.0 AS base, round(avg(v), 6) + 0.0 AS mean, round(quantile_cont(v, 0.05), 6) + 0.0 AS p5, round(quantile_cont(v, 0.95), 6) + 0.0 AS p95,
  round(avg(CAST(sign(v) = sign(base) AND base <> 0 AS INT)), 6) + 0.0 AS same_sign, round(avg(CAST(sign(v) = sign(base) AND base <> 0 AND abs(v - base) <= 0.5 * abs(base) AS INT)), 6) + 0.0 AS within_tol FROM v JOIN b USING (horizon) GROUP BY horizon, n, base"""))
def redraws_query(spark: SparkSession, d: str) -> DataFrame:
    """The mean IC over fifty redraws of the periods."""
    return tidy(redraws.perturb_panel(ic.information_coefficient(P.sample(spark, d), complete=True), "ic", ["date"], ["horizon"], n_draws=50))
