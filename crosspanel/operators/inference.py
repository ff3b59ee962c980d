"""Significance, kept apart from computation: dependent series, many trials, deflation, stability, robustness.

Statistics by group run in Spark; what is left after them is one series of a few thousand periods or a few scalars,
which the driver handles.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crosspanel.functions.order_statistics import ranged_ranks, running
from crosspanel.functions.xsec import clean_number
from crosspanel.operators.contracts import fail

NORMAL = NormalDist()
METHODS = ("bonferroni", "holm", "bh", "bhy")

# Euler's constant, and where a conclusion turns.
EULER = 0.5772156649015329
#: Probability of a Sharpe ratio beyond luck; |t| of a slope that counts as decay; sessions a year.
DSR_LEVEL, DECAY_T, YEAR = 0.95, 2.0, 252
#: Least p that counts, periods and independent periods, inflation of the naive t.
ALPHA, FEW_PERIODS, FEW_INDEPENDENT, INFLATED = 0.05, 20, 10, 1.5
#: Costs to gross return, dropped to all rows, and parts that agree, that a verdict warns of.
COSTLY, MOSTLY_DROPPED, UNSTABLE = 0.3, 0.5, 0.5


# dependent series ---------------------------------------------------------------------------------------------------


def auto_lags(n: int, horizon: int = 1) -> int:
    """Lags for a series of n periods with overlapping holdings."""
    if n < 3:
        return 0
    return min(max(math.floor(4 * (n / 100) ** (2 / 9)), horizon - 1), max(1, n // 4))


def nw_variance(x, lags: int | None = None, horizon: int = 1) -> float:
    """Long-run variance with Bartlett weights, all autocovariances over T - 1, never below the plain variance; NaN below three values."""
    x = np.asarray(x, float)
    x = x[np.isfinite(x)]
    n = len(x)
    if n < 3:
        return float("nan")
    d = x - x.mean()
    lags = min(auto_lags(n, horizon) if lags is None else lags, max(0, n - 2))
    plain = float(d @ d) / (n - 1)
    total = plain + sum(2 * (1 - j / (lags + 1)) * float(d[j:] @ d[:-j]) / (n - 1) for j in range(1, lags + 1))
    return max(total, plain)


def variance_inflation(x, lags: int | None = None, horizon: int = 1) -> float:
    """Long-run over plain variance."""
    x = np.asarray(x, float)
    plain = np.var(x[np.isfinite(x)], ddof=1) if np.isfinite(x).sum() > 1 else 0.0
    return nw_variance(x, lags, horizon) / plain if plain > 0 else float("nan")


def effective_n(x, lags: int | None = None, horizon: int = 1) -> float:
    """Periods that as many independent ones are worth."""
    return np.isfinite(np.asarray(x, float)).sum() / variance_inflation(x, lags, horizon)


def nw_tstat(x, lags: int | None = None, horizon: int = 1) -> dict[str, float]:
    """mean, t_naive, t_nw, n, n_eff, lags, vif of a series; NaN below three periods."""
    x = np.asarray(x, float)
    x = x[np.isfinite(x)]
    n = len(x)
    if n < 3:
        return {"mean": float(x.mean()) if n else float("nan"), "t_naive": float("nan"), "t_nw": float("nan"), "n": n, "n_eff": float("nan"), "lags": 0, "vif": float("nan")}
    used = min(auto_lags(n, horizon) if lags is None else lags, n - 2)
    plain, long_run = float(np.var(x, ddof=1)), nw_variance(x, used)
    t = lambda v: float(x.mean() / math.sqrt(v / n)) if v > 0 else float("nan")
    vif = long_run / plain if plain > 0 else float("nan")
    return {"mean": float(x.mean()), "t_naive": t(plain), "t_nw": t(long_run), "n": n, "n_eff": n / vif, "lags": used, "vif": vif}


def nw_summary(series: DataFrame, keys: list[str], value: str, lags: int | None = None, horizon: int = 1, horizon_column: str | None = None) -> DataFrame:
    """keys, n, mean, std, t_naive, t_nw, n_eff, lags, vif of per-period values (date, keys, value), by group.

    A group is one series, a value a period, which is gathered in order and worked on by array functions.
    """
    x = clean_number(F.col(value).cast("double"))
    own = series.select("date", *keys, x.alias("_v")).where("_v is not null")
    df = own.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("date", "_v"))), lambda s: s["_v"]).alias("_x"))
    h = F.col(horizon_column).cast("int") if horizon_column else F.lit(horizon)
    df = df.withColumn("n", F.size("_x"))
    auto = F.when(F.col("n") < 3, 0).otherwise(
        F.least(F.greatest(F.floor(4 * F.pow(F.col("n") / 100, F.lit(2 / 9))), h - 1), F.greatest(F.lit(1), F.floor(F.col("n") / 4)))
    )
    chosen = auto if lags is None else F.lit(lags)
    df = df.withColumn("lags", F.least(chosen, F.greatest(F.lit(0), F.col("n") - 2)).cast("int"))
    df = df.withColumn("mean", F.expr("aggregate(_x, 0D, (s, v) -> s + v) / n"))
    df = df.withColumn("_d", F.expr("transform(_x, v -> v - mean)"))
    df = df.withColumn("_g", F.expr("CASE WHEN n > 1 THEN aggregate(_d, 0D, (s, v) -> s + v * v) / (n - 1) END"))
    tail = """CASE WHEN lags < 1 THEN 0D ELSE aggregate(sequence(1, lags), 0D, (s, j) -> s + 2 * (1 - j / (lags + 1D))
        * aggregate(zip_with(slice(_d, 1, n - j), slice(_d, j + 1, n - j), (a, b) -> a * b), 0D, (t, p) -> t + p) / (n - 1)) END"""
    df = df.withColumn("_s", F.when(F.col("n") > 1, F.greatest(F.col("_g") + F.expr(tail), F.col("_g"))))
    t = lambda v: F.when((F.col("n") >= 3) & (F.col(v) > 0), F.col("mean") / F.sqrt(F.col(v) / F.col("n")))
    vif = F.when(F.col("n") >= 3, F.try_divide("_s", "_g"))
    return df.select(*keys, "n", "mean", F.sqrt("_g").alias("std"), t("_g").alias("t_naive"), t("_s").alias("t_nw"), F.try_divide(F.col("n"), vif).alias("n_eff"), "lags", vif.alias("vif"))


def newey_west_summary(ic: DataFrame, lags: int | None = None) -> DataFrame:
    """horizon and the statistics of its IC series, lags by the horizon, with how far the naive t is inflated."""
    out = nw_summary(ic, ["horizon"], "ic", lags=lags, horizon_column="horizon")
    return out.withColumn("t_inflation", F.try_divide("t_naive", "t_nw"))


# many trials --------------------------------------------------------------------------------------------------------


def dependency_factor(n: int) -> float:
    """Harmonic number of n."""
    return sum(1 / i for i in range(1, n + 1))


def p_from_t(t: float, df: float | None = None) -> float:
    """Two-sided p of a t value: normal, or of Student's distribution with `df` degrees of freedom."""
    if not math.isfinite(t) or (df is not None and not df > 0):
        return float("nan")
    if df is None or math.isinf(df):
        return math.erfc(abs(t) / math.sqrt(2))
    return _incomplete_beta(df / 2, 0.5, df / (df + t * t))


def _incomplete_beta(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function: its continued fraction, worked out from the back."""
    if x in (0.0, 1.0):
        return x
    if x > (a + 1) / (a + b + 2):
        return 1 - _incomplete_beta(b, a, 1 - x)
    tail = 1.0
    for m in range(200, 0, -1):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        tail = 1 + even / (1 + odd / tail)
    first = -(a + b) * x / (a + 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    return front / (1 + first / tail)


def t_threshold(n_trials: int, alpha: float = 0.05) -> float:
    """The |t| that one of n trials must exceed."""
    if n_trials < 1:
        fail("multiplicity", "bad_n_trials", f"{n_trials} trials")
    return NORMAL.inv_cdf(1 - alpha / n_trials / 2)


hlz_threshold = t_threshold


def adjust_columns(df: DataFrame, p: str, columns: dict[str, str], n_trials: int | None = None) -> DataFrame:
    """Add a column of adjusted p-values for each method named. More trials than rows count as rows with p = 1, which come
    last and change only n.

    Equal p-values have equal results, so it is the distinct values that are ranked, range by range, and the running
    maximum of the step-down and minimum of the step-up methods are scans over ranges: no task sees all hypotheses.
    """
    for method in columns.values():
        if method not in METHODS:
            fail("multiplicity", "bad_method", f"{method!r} is none of {METHODS}")
    ranked = ranged_ranks(df, p, [])
    n = F.col("_n") if n_trials is None else F.greatest(F.col("_n"), F.lit(n_trials))
    ranked = ranked.withColumns({"_m": F.col("_n"), "_n": n})
    # of equal p-values the first has the greatest step-down value, the last the least step-up value
    down = {"_down": (F.col("_n") - F.col("_lo")) * F.col(p)}
    up = {"_up": F.col("_n") / (F.col("_lo") + F.col("_c")) * F.col(p)}
    if "holm" in columns.values():
        ranked = running(ranked, p, down, True)
    if {"bh", "bhy"} & set(columns.values()):
        ranked = running(ranked, p, up, False)

    def value(method: str) -> Column:
        if method == "bonferroni":
            return F.col("_n") * F.col(p)
        if method == "holm":
            return F.col("_down")
        c = F.lit(1.0) if method == "bh" else harmonic(F.col("_n"))
        return F.least(F.col("_up") * c, F.when(F.col("_n") > F.col("_m"), c))

    found = ranked.select(F.col(p).alias("_p"), *(F.least(F.lit(1.0), value(m)).alias(c) for c, m in columns.items()))
    return df.drop(*columns).join(found, F.col(p) == F.col("_p"), "left").drop("_p")


def adjust_column(df: DataFrame, p: str, out: str, method: str = "bhy", n_trials: int | None = None) -> DataFrame:
    """Add adjusted p-values by one method."""
    return adjust_columns(df, p, {out: method}, n_trials)


def harmonic(n: Column) -> Column:
    """The harmonic number of n: summed up to 100, beyond that by its expansion, which is exact to 16 digits there."""
    x = n.cast("double")
    far = F.log(x) + EULER + 1 / (2 * x) - 1 / (12 * x * x) + 1 / (120 * x * x * x * x)
    near = F.get(F.array(*(F.lit(dependency_factor(i)) for i in range(101))), n.cast("int"))
    return F.when(n <= 100, near).otherwise(far)


def adjust(p, method: str = "bhy", n_trials: int | None = None) -> np.ndarray:
    """Adjusted p-values of a short list."""
    p = np.asarray(p, float)
    n = max(len(p), n_trials or 0)
    order = np.argsort(p, kind="stable")
    k = np.arange(1, len(p) + 1)
    if method == "bonferroni":
        q = n * p[order]
    elif method == "holm":
        q = np.maximum.accumulate((n - k + 1) * p[order])
    elif method in ("bh", "bhy"):
        c = dependency_factor(n) if method == "bhy" else 1.0
        q = n * c / k * p[order]
        last = c if n > len(p) else np.inf
        q = np.minimum(np.minimum.accumulate(q[::-1])[::-1], last)
    else:
        fail("multiplicity", "bad_method", f"{method!r} is none of {METHODS}")
    out = np.empty(len(p))
    out[order] = np.minimum(1.0, q)
    return out


def adjusted_table(p, labels: list[str] | None = None, t=None, method: str = "bhy", n_trials: int | None = None) -> pd.DataFrame:
    """label, t if given, p_raw, p_adj and whether either is significant, by p. attrs: method, n_trials and the |t| they ask for."""
    p, n = np.asarray(p, float), max(n_trials or 0, len(p))
    fixed = adjust(p, method, n_trials)
    columns = {"label": labels if labels is not None else [f"h{i}" for i in range(len(p))]} | ({} if t is None else {"t": np.asarray(t, float)})
    out = pd.DataFrame(columns | {"p_raw": p, "p_adj": fixed, "significant_raw": p < ALPHA, "significant_adj": fixed < ALPHA})
    out = out.sort_values("p_raw", kind="stable", ignore_index=True)
    out.attrs = {"method": method, "n_trials": n, "t_threshold": t_threshold(n) if n else float("nan")}
    return out


def bonferroni(p) -> np.ndarray:
    """min(1, n p)."""
    return adjust(p, "bonferroni")


def holm(p) -> np.ndarray:
    """Step-down."""
    return adjust(p, "holm")


def benjamini_hochberg(p) -> np.ndarray:
    """Step-up for independent tests."""
    return adjust(p, "bh")


def benjamini_yekutieli(p) -> np.ndarray:
    """Step-up for any dependence."""
    return adjust(p, "bhy")


# deflation ----------------------------------------------------------------------------------------------------------


def _moments(returns) -> tuple[float, int, float, float]:
    x = np.asarray(returns, float)
    x = x[np.isfinite(x)]
    sd = x.std(ddof=1) if len(x) > 1 else 0.0
    if len(x) < 4 or not sd > 0:
        fail("deflated", "too_short", "four returns that differ are needed")
    z = (x - x.mean()) / sd
    return float(x.mean() / sd), len(x), float((z**3).mean()), float((z**4).mean())


def psr(returns, benchmark: float = 0.0) -> float:
    """Probability that the true Sharpe ratio (per period) exceeds the benchmark."""
    sr, n, skew, kurt = _moments(returns)
    return NORMAL.cdf((sr - benchmark) * math.sqrt(n - 1) / math.sqrt(max(1 - skew * sr + (kurt - 1) / 4 * sr * sr, 1e-12)))


def expected_max_sharpe(n_trials: int, variance: float) -> float:
    """The best Sharpe ratio that n trials without skill would show."""
    if n_trials <= 1:
        return 0.0
    q = NORMAL.inv_cdf
    return math.sqrt(variance) * ((1 - EULER) * q(1 - 1 / n_trials) + EULER * q(1 - 1 / (n_trials * math.e)))


def sharpe_variance(sr: float, n: int) -> float:
    """Sampling variance of a Sharpe ratio."""
    return (1 + sr * sr / 2) / max(n, 2)


@dataclass(frozen=True)
class DSRResult:
    """Deflated Sharpe ratio and what it rests on."""

    sharpe: float
    psr: float
    dsr: float
    expected_max: float
    n_trials: int
    n: int
    skew: float = float("nan")
    kurt: float = float("nan")
    #: Variance of the Sharpe ratio over the trials, per period.
    variance: float = float("nan")

    @property
    def significant(self) -> bool:
        """Beyond what luck among the trials explains."""
        return self.dsr > DSR_LEVEL


def dsr(returns, n_trials: int, variance: float | None = None, per_year: float = 252.0, benchmark: float = 0.0) -> DSRResult:
    """Deflated Sharpe ratio: the probability against the best of n trials without skill."""
    sr, n, skew, kurt = _moments(returns)
    variance = sharpe_variance(sr, n) if variance is None else variance
    best = expected_max_sharpe(n_trials, variance)
    return DSRResult(sr * math.sqrt(per_year), psr(returns, benchmark), psr(returns, benchmark + best), best * math.sqrt(per_year), n_trials, n, skew, kurt, variance)


def min_track_record_length(returns, n_trials: int, target: float = 0.95, variance: float | None = None) -> float:
    """Periods needed to reach the target probability; infinite if the ratio isn't above what luck gives."""
    sr, n, skew, kurt = _moments(returns)
    best = expected_max_sharpe(n_trials, sharpe_variance(sr, n) if variance is None else variance)
    if sr <= best:
        return math.inf
    return 1 + (1 - skew * sr + (kurt - 1) / 4 * sr * sr) * (NORMAL.inv_cdf(target) / (sr - best)) ** 2


# stability and robustness -------------------------------------------------------------------------------------------


def subsample_stability(series, n_splits: int = 2, min_obs: int = 5) -> dict:
    """Share of contiguous parts whose mean has the sign of the whole; None where the series is too short."""
    x = np.asarray(series, float)
    x = x[np.isfinite(x)]
    if len(x) < n_splits * min_obs:
        return {"same_sign": None, "chunk_means": [], "n": len(x)}
    means = [float(c.mean()) for c in np.array_split(x, n_splits)]
    same = float(np.mean(np.sign(means) == np.sign(x.mean()))) if x.mean() else float("nan")
    return {"same_sign": same, "chunk_means": means, "n": len(x)}


def decay_test(series, lags: int | None = None, horizon: int = 1) -> dict:
    """Slope over time, its t with and without allowance for dependence, and the half life of a falling level.

    `decaying` is None where nothing was tested (fewer than eight periods).
    """
    x = np.asarray(series, float)
    x = x[np.isfinite(x)]
    n, nan = len(x), float("nan")
    out = {"slope": nan, "t_nw": nan, "t_naive": nan, "annual_slope": nan, "decaying": None, "half_life": None, "n": n, "lags": 0, "vif": nan}
    if n < 8:
        return out
    time = np.arange(n) - (n - 1) / 2
    spread = float(time @ time)
    slope = float(time @ x) / spread
    left = x - x.mean() - slope * time
    used = auto_lags(n, horizon) if lags is None else lags
    robust = math.sqrt(n * nw_variance(time * left, used)) / spread
    plain = math.sqrt(float(left @ left) / (n - 2) / spread)
    t_nw, t_naive = (slope / se if se > 0 else nan for se in (robust, plain))
    falls = slope < 0
    return out | {
        "slope": slope, "t_nw": t_nw, "t_naive": t_naive, "annual_slope": YEAR * slope, "decaying": bool(falls and abs(t_nw) > DECAY_T),
        "half_life": abs(float(x.mean()) / slope) if falls and x.mean() else None, "lags": int(used), "vif": variance_inflation(x, used),
    }


def _redraws(x: np.ndarray, mode: str, n_draws: int, size: int, seed: int) -> np.ndarray:
    """A row of values for each redraw."""
    rng = np.random.default_rng(seed)
    if mode == "bootstrap":
        return x[rng.integers(len(x), size=(n_draws, size))]
    return rng.permuted(np.tile(x, (n_draws, 1)), axis=1)[:, :size]


def perturb_series(series, *, mode: str = "subsample", n_draws: int = 200, frac: float = 0.8, seed: int = 0, tol: float = 0.5, agg=np.mean) -> dict:
    """Seeded redraws of a series, each put through `agg`: how often the sign holds, how often that and within `tol` of it, 5-95 % range."""
    x = np.asarray(series, float)
    x = x[np.isfinite(x)]
    if mode not in ("subsample", "bootstrap"):
        fail("robustness", "bad_mode", f"{mode!r} is neither subsample nor bootstrap")
    if not 0 < frac <= 1:
        fail("robustness", "bad_frac", f"{frac} is not in (0, 1]")
    if len(x) < 5:
        fail("robustness", "too_short", f"{len(x)} periods, 5 needed")
    base = float(agg(x))
    found = np.apply_along_axis(agg, 1, _redraws(x, mode, n_draws, max(2, round(len(x) * frac)), seed)).astype(float)
    same = (np.sign(found) == np.sign(base)) & (base != 0)
    near = same & (np.abs(found - base) <= tol * abs(base))
    low, high = np.quantile(found, [0.05, 0.95])
    return {"mode": mode, "frac": frac, "n": len(x), "base": base, "mean": float(found.mean()), "p5": float(low), "p95": float(high),
            "same_sign": float(same.mean()), "within_tol": float(near.mean()), "draws": found}


def pfs(series, **settings) -> float:
    """Share of redraws that keep the sign and stay near."""
    return perturb_series(series, **settings)["within_tol"]


def robustness_report(series, *, modes=("subsample", "bootstrap"), n_draws: int = 200, fracs=(0.5, 0.7, 0.9), seed: int = 0, tol: float = 0.5) -> list[dict]:
    """A row for each way of redrawing; one that can't be done has a note."""
    rows = []
    for mode in modes:
        for frac in fracs:
            try:
                rows.append(perturb_series(series, mode=mode, n_draws=n_draws, frac=frac, seed=seed, tol=tol) | {"note": ""})
            except ValueError as why:
                rows.append({"mode": mode, "frac": frac, "note": str(why)})
    return rows


# rank entropy -------------------------------------------------------------------------------------------------------


def rank_entropy_series(panel: DataFrame, column: str = "factor", bins: int = 10) -> DataFrame:
    """date, entropy: of the section's z-scores, clipped to +-3 and put in equal bins, over its maximum."""
    w = Window.partitionBy("date")
    x = F.col(column)
    df = panel.where(x.isNotNull()).withColumns({"_n": F.count(x).over(w), "_m": F.avg(x).over(w), "_s": F.stddev_samp(x).over(w)})
    z = F.when(F.col("_s") > 0, F.greatest(F.lit(-3.0), F.least(F.lit(3.0), (x - F.col("_m")) / F.col("_s")))).otherwise(0.0)
    spot = F.least(F.floor((z + 3) / 6 * bins), F.lit(bins - 1))
    cells = df.where(F.col("_n") >= bins).groupBy("date", spot.alias("_b")).agg(F.count("*").alias("_c"), F.first("_n").alias("_n"))
    share = F.col("_c") / F.col("_n")
    return cells.groupBy("date").agg((-F.sum(share * F.log(share)) / math.log(bins)).alias("entropy"))


def rank_stability(panel: DataFrame, column: str = "factor", bins: int = 10) -> float | None:
    """Share of assets that stay in their rank bin from one usable period to the next, scaled so that chance is 0."""
    by = Window.partitionBy("date").orderBy(column, "asset")
    rows = panel.where(F.col(column).isNotNull()).withColumns({"_n": F.count("*").over(Window.partitionBy("date")), "_r": F.row_number().over(by) - 1})
    rows = rows.where(F.col("_n") >= bins).withColumn("bin", F.floor(F.col("_r") * bins / F.col("_n")))
    numbers = rows.select("date").distinct().withColumn("p", F.row_number().over(Window.orderBy("date")))
    rows = rows.select("date", "asset", "bin").join(F.broadcast(numbers), "date")
    before = rows.select("asset", (F.col("p") + 1).alias("p"), F.col("bin").alias("was"))
    stay = rows.join(before, ["asset", "p"]).groupBy("p").agg(F.avg((F.col("bin") == F.col("was")).cast("double")).alias("s")).agg(F.avg("s").alias("s")).first().s
    return None if stay is None else float(min(1.0, max(0.0, (stay - 1 / bins) / (1 - 1 / bins))))


def rank_entropy_summary(panel: DataFrame, column: str = "factor", bins: int = 10) -> dict:
    """Mean entropy, stability, and a note where either is extreme."""
    entropy = rank_entropy_series(panel, column, bins).agg(F.avg("entropy").alias("e")).first().e
    stability = rank_stability(panel, column, bins)
    note = ""
    if stability is not None:
        note = "ranks are redrawn every period" if stability < 0.05 else "ranks change fast" if stability < 0.3 else "ranks hardly change" if stability > 0.99 else ""
    return {"entropy": entropy, "stability": stability, "note": note}


# verdict ------------------------------------------------------------------------------------------------------------


@dataclass
class Estimate:
    """One estimated mean with its dependence and its multiplicity."""

    name: str
    mean: float
    t_naive: float
    t_nw: float
    n: int
    n_eff: float
    p_raw: float
    p_adj: float
    n_trials: int | None = None
    warnings: list[str] = field(default_factory=list)
    horizon: int = 1
    lags: int = 0
    method: str = "none"

    @property
    def significant(self) -> bool:
        """After adjustment only."""
        return self.p_adj < ALPHA

    @property
    def inflation(self) -> float:
        """How many times too large the naive t is."""
        return abs(self.t_naive / self.t_nw) if self.t_nw else float("nan")


def estimate_from_series(series, name: str = "RankIC", horizon: int = 1, lags: int | None = None, n_trials: int | None = None, method: str = "bhy", all_p: list[float] | None = None) -> Estimate:
    """Estimate of a series; its p is adjusted among `all_p` and for the trials made."""
    s = nw_tstat(series, lags, horizon)
    p = p_from_t(s["t_nw"])
    ps = list(all_p or []) + [p]
    p_adj = float(adjust(ps, method, n_trials)[-1]) if math.isfinite(p) else float("nan")
    out = Estimate(name, s["mean"], s["t_naive"], s["t_nw"], s["n"], s["n_eff"], p, p_adj, n_trials, horizon=horizon, lags=s["lags"], method=method)
    for bad, text in (
        (s["n"] < FEW_PERIODS, f"only {s['n']} periods"), (s["n_eff"] < FEW_INDEPENDENT, f"worth {s['n_eff']:.1f} independent periods"),
        (out.inflation >= INFLATED, f"the naive t is {out.inflation:.1f} times too large"), (p < ALPHA <= p_adj, "not significant once the trials are counted"),
        (bool(n_trials) and n_trials > s["n"], "more trials than periods"),
    ):
        if bad:
            out.warnings.append(text)
    return out


def estimates_table(estimates: list[Estimate]) -> pd.DataFrame:
    """A row an estimate: what it is, what it rests on, and whether it holds before and after adjustment."""
    names = ("name", "horizon", "mean", "t_naive", "t_nw", "inflation", "n", "n_eff", "lags", "p_raw", "p_adj", "n_trials", "method", "significant")
    rows = [{x: getattr(e, x) for x in names} | {"significant_naive": p_from_t(e.t_naive) < ALPHA, "warnings": "; ".join(e.warnings)} for e in estimates]
    return pd.DataFrame(rows, columns=[*names, "significant_naive", "warnings"])


@dataclass
class Verdict:
    """What may be concluded, and what speaks against it."""

    main: Estimate | None
    gross: float | None
    net: float | None
    warnings: list[str]
    estimates: list[Estimate] = field(default_factory=list)
    #: Summed cost of all periods.
    cost: float | None = None
    n_trials: int | None = None
    method: str = "none"
    #: The |t| that the trials ask for.
    threshold_used: float | None = None
    #: Rows kept over all rows.
    tradable_ratio: float | None = None
    stability: float | None = None
    #: Tail statistics that go with the verdict, as they were given.
    crash: object = None


def _estimates_of(ic: DataFrame, horizon: int | None, n_trials: int | None, method: str) -> list[Estimate]:
    """An estimate for each horizon of (date, horizon, ic), adjusted among each other; the horizon asked for comes first."""
    series: dict[int, list[float]] = {}
    for r in ic.where(F.col("ic").isNotNull()).orderBy("horizon", "date").select("horizon", "ic").collect():
        series.setdefault(r.horizon, []).append(r.ic)
    if not any(math.isfinite(v) for values in series.values() for v in values):
        fail("verdict", "empty_ic", "there is no period with an IC to judge by")
    p = {h: p_from_t(nw_tstat(x, horizon=h)["t_nw"]) for h, x in series.items()}
    others = lambda h: [v for k, v in p.items() if k != h and math.isfinite(v)]
    return [
        estimate_from_series(series[h], f"RankIC {h}", h, n_trials=n_trials, method=method, all_p=others(h)) for h in sorted(series, key=lambda h: (h != horizon, h))
    ]


def assess(
    estimates: list[Estimate] | None = None, returns=None, turnover=None, cost_bps: float = 15.0, dropped_share: float | None = None, stability: float | None = None,
    n_trials: int | None = None, *, ic: DataFrame | None = None, ledger=None, method: str = "bhy", horizon: int | None = None, crash=None,
) -> Verdict:
    """The first estimate is the main one; gross and net compound the returns, net less the cost of turnover both ways.

    Without estimates they come from `ic` (date, horizon, ic). `ledger` is a cleaned sample with its account.
    """
    if estimates is None:
        estimates = _estimates_of(ic, horizon, n_trials, method) if ic is not None else []
    if ledger is not None and dropped_share is None:
        n, dropped = ledger.rows.agg(F.count("*"), F.count("drop_reason")).first()
        dropped_share = dropped / n if n else None
    out = Verdict(
        estimates[0] if estimates else None, None, None, [w for e in estimates[:1] for w in e.warnings], list(estimates), n_trials=n_trials,
        method=method if n_trials else "none", threshold_used=t_threshold(n_trials) if n_trials else None,
        tradable_ratio=None if dropped_share is None else 1 - dropped_share, stability=stability, crash=crash,
    )
    if returns is not None:
        r = np.nan_to_num(np.asarray(returns, float))
        cost = np.nan_to_num(np.asarray(turnover, float)) * 2 * cost_bps / 1e4 if turnover is not None else np.zeros(len(r))
        out.gross, out.net, out.cost = float(np.prod(1 + r) - 1), float(np.prod(1 + r - cost) - 1), float(cost.sum())
    told = (
        (out.cost is not None and out.cost > 0 and out.cost > COSTLY * abs(out.gross), "costs take more than 30 % of the gross return"),
        (dropped_share is not None and dropped_share > MOSTLY_DROPPED, "more than half of the rows were dropped"),
        (stability is not None and stability < UNSTABLE, "most parts of the sample disagree in sign"),
        (n_trials is None, "the number of trials is unknown"),
    )
    out.warnings += [text for bad, text in told if bad and text not in out.warnings]
    return out
