"""Health of the data itself: each check is one pass, and what can't be checked is skipped, never passed."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crosspanel.operators.calendars import with_pos
from crosspanel.operators.contracts import fail

#: Limits of the checks.
THRESHOLDS = {
    "extreme_move": 0.5, "factor_jump": 2.0, "factor_drop": 1e-8, "suspended_share": 0.5, "low_coverage": 0.5, "low_coverage_dates": 0.05,
    "gone_sessions": 20, "delisted_share": 0.01, "freeze_run": 20, "stale_days": 400, "buyable_mean": 0.9, "ohlc_tolerance": 1e-6, "covered_share": 0.8, "daily_gap": 4,
}
ORDER = ("fail", "warn", "info", "pass", "skip")


@dataclass(frozen=True)
class Finding:
    """What one check found."""

    check: str
    severity: str
    detail: str
    #: The rows behind it, if any; they are only read when they are shown.
    rows: DataFrame | None = None


@dataclass
class HealthReport:
    """All findings of a data set."""

    findings: list[Finding] = field(default_factory=list)
    name: str = "data"

    @property
    def ok(self) -> bool:
        """No failure, and at least one check that ran."""
        return any(f.severity != "skip" for f in self.findings) and not any(f.severity == "fail" for f in self.findings)

    def to_markdown(self, max_detail: int = 10) -> str:
        """How many findings of each kind, the findings, worst first, and up to `max_detail` of the rows behind each."""
        ranked = sorted(self.findings, key=lambda f: ORDER.index(f.severity))
        counts = ", ".join(f"{n} {s}" for s in ORDER if (n := sum(f.severity == s for f in ranked)))
        lines = [f"# Health of {self.name}", "", f"{'Passed' if self.ok else 'Not passed'}: {counts or 'nothing checked'}.", ""]
        lines += [f"- **{f.severity}** {f.check}: {f.detail}" for f in ranked]
        for f in ranked:
            found = f.rows.limit(max_detail + 1).collect() if f.rows is not None and max_detail and f.severity in ("fail", "warn") else []
            if found:
                lines += ["", f"### {f.check}", "", "| " + " | ".join(f.rows.columns) + " |", "|" + "---|" * len(f.rows.columns)]
                lines += ["| " + " | ".join("" if v is None else f"{v:.4g}" if isinstance(v, float) else str(v) for v in r) + " |" for r in found[:max_detail]]
                lines += ["", f"The first {max_detail}; there are more."] if len(found) > max_detail else []
        return "\n".join(lines)


def _ohlc_rules(tolerance: float) -> dict[str, Column]:
    o, h, l, c = (F.col(f"raw_{k}") for k in ("open", "high", "low", "close"))
    slack = 1 + tolerance
    return {"high_below_low": h * slack < l, "high_below_body": h * slack < F.greatest(o, c), "low_above_body": l > F.least(o, c) * slack, "not_positive": F.least(o, h, l, c) <= 0}


def _ohlc_broken(tolerance: float) -> Column:
    return reduce(lambda a, b: a | b, (F.coalesce(r, F.lit(False)) for r in _ohlc_rules(tolerance).values()))


def ohlc_violations(prices: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """rule, n, first: rows whose high, low, open and close contradict each other."""
    rules = _ohlc_rules(tolerance)
    key = F.concat_ws(" ", F.col("date").cast("string"), "asset")
    cells = [F.struct(F.lit(r).alias("rule"), F.col(f"_n{i}").alias("n"), F.col(f"_k{i}").alias("first")) for i, r in enumerate(rules)]
    asked = [a for i, t in enumerate(rules.values()) for a in (F.count_if(t).alias(f"_n{i}"), F.min(F.when(t, key)).alias(f"_k{i}"))]
    return prices.agg(*asked).select(F.explode(F.array(*cells)).alias("r")).select("r.*")


def extreme_moves(prices: DataFrame, limit: float = 0.5) -> DataFrame:
    """date, asset, move, adj_move, kind: raw moves beyond the limit, and whether adjusted prices explain them."""
    w = Window.partitionBy("asset").orderBy("date")
    before = lambda c: F.last(c, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    df = prices.withColumns({"move": F.try_divide(F.col("raw_close"), before("raw_close")) - 1, "adj_move": F.try_divide(F.col("adj_close"), before("adj_close")) - 1})
    kind = F.when(F.col("adj_move").isNull(), "missing").when(F.abs("adj_move") > limit, "still_large").otherwise("covered")
    return df.where(F.abs("move") > limit).select("date", "asset", "move", "adj_move", kind.alias("kind"))


def adjust_continuity(prices: DataFrame, drop: float = 1e-8, jump: float = 2.0) -> DataFrame:
    """not_positive, decreases, jumps: how often the adjustment factor does what it shouldn't."""
    w = Window.partitionBy("asset").orderBy("date")
    df = prices.withColumn("_b", F.lag("adj_factor").over(w))
    step = F.try_divide(F.col("adj_factor"), F.col("_b"))
    return df.agg(F.count_if(F.col("adj_factor") <= 0).alias("not_positive"), F.count_if(step < 1 - drop).alias("decreases"), F.count_if(step > jump).alias("jumps"))


def suspension_by_date(prices: DataFrame) -> DataFrame:
    """date, share of rows without volume."""
    return prices.groupBy("date").agg(F.avg((F.coalesce("volume", F.lit(0)) <= 0).cast("double")).alias("share"))


def coverage_by_date(prices: DataFrame) -> DataFrame:
    """date, n rows."""
    return prices.groupBy("date").agg(F.count("*").alias("n"))


def coverage(prices: DataFrame, low: float = 0.5) -> DataFrame:
    """n_dates, median, low_dates: dates with fewer rows than `low` of the median."""
    by_date = coverage_by_date(prices)
    mid = by_date.agg(F.median("n").alias("median"))
    return by_date.join(F.broadcast(mid)).agg(F.count("*").alias("n_dates"), F.first("median").alias("median"), F.count_if(F.col("n") < low * F.col("median")).alias("low_dates"))


def survivorship(prices: DataFrame, calendar: DataFrame, gone: int = 20) -> DataFrame:
    """n_assets, n_gone: assets whose last row is more than `gone` sessions before the calendar's end."""
    last = with_pos(prices.groupBy("asset").agg(F.max("date").alias("date")), calendar)
    end = calendar.agg(F.max("pos").alias("end"))
    return last.join(F.broadcast(end)).agg(F.count("*").alias("n_assets"), F.count_if(F.col("pos") < F.col("end") - gone).alias("n_gone"))


def session_gaps(panel: DataFrame, calendar: DataFrame, daily: float = 4) -> DataFrame:
    """n_off, median_gap, n_missing, first_missing: dates off the calendar, and sessions between a daily panel's ends without a row.

    A panel is daily if the median days between its dates are at most `daily`; else, or below three dates, n_missing is NULL.
    """
    own = panel.select("date").distinct()
    gap = F.datediff("date", F.lag("date").over(Window.orderBy("date")))  # one row a session
    ends = own.withColumn("_gap", gap).agg(F.min("date").alias("_lo"), F.max("date").alias("_hi"), F.median("_gap").alias("median_gap"), F.count("*").alias("_n"))
    met = own.withColumn("_own", F.lit(True)).join(calendar.select("date").distinct().withColumn("_cal", F.lit(True)), "date", "full_outer").join(F.broadcast(ends))
    missing = F.col("_own").isNull() & F.col("date").between(F.col("_lo"), F.col("_hi"))
    is_daily = (F.first("_n") >= 3) & (F.first("median_gap") <= daily)
    return met.agg(
        F.count_if(F.col("_cal").isNull()).alias("n_off"), F.first("median_gap").alias("median_gap"), F.when(is_daily, F.count_if(missing)).alias("n_missing"),
        F.when(is_daily, F.min(F.when(missing, F.col("date")))).alias("first_missing"),
    )


def longest_runs(panel: DataFrame, column: str) -> DataFrame:
    """asset, longest: most consecutive rows with one value."""
    w = Window.partitionBy("asset").orderBy("date")
    own = panel.where(F.col(column).isNotNull())
    new = F.coalesce((F.col(column) != F.lag(column).over(w)).cast("int"), F.lit(1))
    runs = own.withColumn("_new", new).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("asset", "_run").agg(F.count("*").alias("n")).groupBy("asset").agg(F.max("n").alias("longest"))


def factor_health(factor: DataFrame, freeze: int = 20) -> DataFrame:
    """constant_dates, frozen_assets, median_stale_days of a factor panel (date, asset, value, available_at)."""
    flat = factor.groupBy("date").agg(F.count_distinct("value").alias("k")).agg(F.count_if(F.col("k") < 2).alias("constant_dates"))
    frozen = longest_runs(factor, "value").agg(F.count_if(F.col("longest") >= freeze).alias("frozen_assets"))
    stale = factor.agg(F.median(F.datediff("date", "available_at")).alias("median_stale_days"))
    return flat.join(frozen).join(stale)


def tradability_rates(tradability: DataFrame) -> DataFrame:
    """date and the share of each flag."""
    flags = [c for c, t in tradability.dtypes if t == "boolean"]
    return tradability.groupBy("date").agg(*(F.avg(F.col(c).cast("double")).alias(c) for c in flags))


def check(prices: DataFrame | None = None, factor: DataFrame | None = None, tradability: DataFrame | None = None, calendar: DataFrame | None = None, *, thresholds: dict | None = None, name: str = "data") -> HealthReport:
    """All checks that the inputs allow."""
    th = THRESHOLDS | (thresholds or {})
    if set(th) - set(THRESHOLDS):
        fail("health", "unknown_threshold", str(sorted(set(th) - set(THRESHOLDS))))
    report = HealthReport(name=name)
    add = lambda check, bad, detail, severity="fail", rows=None: report.findings.append(Finding(check, severity if bad else "pass", detail, rows if bad else None))
    skip = lambda check, why: report.findings.append(Finding(check, "skip", why))
    has = set(prices.columns) if prices is not None else set()
    if {"raw_open", "raw_high", "raw_low", "raw_close"} <= has:
        found = [r for r in ohlc_violations(prices, th["ohlc_tolerance"]).collect() if r.n]
        rows = prices.where(_ohlc_broken(th["ohlc_tolerance"])).select("date", "asset", "raw_open", "raw_high", "raw_low", "raw_close").orderBy("date", "asset")
        add("ohlc", found, "; ".join(f"{r.rule}: {r.n}, first {r['first']}" for r in found) or "consistent", rows=rows)
    else:
        skip("ohlc", "no OHLC prices")
    if {"raw_close", "adj_close"} <= has:
        moves = extreme_moves(prices, th["extreme_move"])
        kinds = {r.kind: r["count"] for r in moves.groupBy("kind").count().collect()}
        n = sum(kinds.values())
        good = not kinds.get("missing") and kinds.get("covered", 0) > th["covered_share"] * n
        add("extreme_moves", n and not good, f"{n} beyond {th['extreme_move']:.0%}: {kinds}", "warn", moves.orderBy(F.desc(F.abs("move")), "date", "asset"))
    else:
        skip("extreme_moves", "no adjusted prices")
    if "adj_factor" in has:
        r = adjust_continuity(prices, th["factor_drop"], th["factor_jump"]).first()
        add("adjust_factor", r.not_positive or r.decreases, f"{r.not_positive} not positive, {r.decreases} decreases")
        add("adjust_jumps", r.jumps, f"{r.jumps} beyond {th['factor_jump']} times", "warn")
    else:
        skip("adjust_factor", "no adj_factor")
    if "volume" in has:
        halted = suspension_by_date(prices).where(F.col("share") > th["suspended_share"])
        n = halted.count()
        whole = prices.agg(F.avg((F.coalesce("volume", F.lit(0)) <= 0).cast("double"))).first()[0] or 0.0
        add("suspension", n, f"{whole:.2%} of all rows suspended, {n} dates with most rows suspended", "warn", halted.orderBy("date"))
    else:
        skip("suspension", "no volume")
    if prices is not None and calendar is not None:
        r = coverage(prices, th["low_coverage"]).first()
        thin = coverage_by_date(prices).where(F.col("n") < th["low_coverage"] * F.lit(r["median"])).orderBy("date")
        add("coverage", r.low_dates > th["low_coverage_dates"] * r.n_dates, f"{r.low_dates} of {r.n_dates} dates thin", rows=thin)
        r = survivorship(prices, calendar, th["gone_sessions"]).first()
        add("survivorship", r.n_gone < th["delisted_share"] * r.n_assets, f"{r.n_gone} of {r.n_assets} assets end early", "warn")
        r = session_gaps(prices, calendar, th["daily_gap"]).first()
        off = prices.select("date").distinct().join(calendar.select("date"), "date", "left_anti").orderBy("date")
        add("calendar", r.n_off, f"{r.n_off} dates off the calendar", rows=off)
        if r.n_missing is None:
            report.findings.append(Finding("sessions", "info", f"not a daily panel (median gap {r.median_gap} days), sessions not checked"))
        else:
            add("sessions", r.n_missing, f"{r.n_missing} sessions without a row" + (f", first {r.first_missing}" if r.n_missing else ""), "warn")
    else:
        skip("coverage", "needs prices and calendar")
    if factor is not None:
        r = factor_health(factor, th["freeze_run"]).first()
        add("factor_constant", r.constant_dates, f"{r.constant_dates} constant sections")
        frozen = longest_runs(factor, "value").where(F.col("longest") >= th["freeze_run"]).orderBy(F.desc("longest"), "asset")
        add("factor_frozen", r.frozen_assets, f"{r.frozen_assets} assets frozen", "warn", frozen)
        add("factor_stale", (r.median_stale_days or 0) > th["stale_days"], f"median age {r.median_stale_days} days", "warn")
    else:
        skip("factor", "no factor")
    if tradability is not None and "can_buy_open" in tradability.columns:
        r = tradability_rates(tradability).agg(F.avg("can_buy_open").alias("mean"), F.min("can_buy_open").alias("least")).first()
        add("buyable_days", r["least"] == 0, f"least share on a day {r['least']:.3f}")
        add("buyable", r["mean"] < th["buyable_mean"], f"mean share {r['mean']:.3f}", "warn")
        if "is_new_stock" in tradability.columns:
            share = tradability.agg(F.avg(F.col("is_new_stock").cast("double"))).first()[0] or 0.0
            add("new_stock", not share, f"{share:.2%} of all rows kept out as newly listed" if share else "no row is newly listed: the filter has no effect", "warn")
        else:
            skip("new_stock", "no is_new_stock")
    else:
        skip("tradability", "no tradability")
    return report
