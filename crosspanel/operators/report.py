"""The whole evaluation of a factor in one call: contracts to verdict, as tidy tables and Markdown."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crosspanel.operators import clean as cleaning
from crosspanel.operators import health, inference, portfolio, tail
from crosspanel.operators.contracts import Receipt, ensure_contract, fail
from crosspanel.operators.ic import ic_summary, information_coefficient, quantile_turnover, rank_autocorrelation
from crosspanel.operators.preprocess import neutralize, standardize, winsorize
from crosspanel.operators.quantile import double_sort, factor_returns, quantile_stats, quantize
from crosspanel.operators.returns import ReturnModel, forward_returns, return_ledger
from crosspanel.operators.tradability import compute_tradability


#: Title of each section and what to bear in mind when reading it; the Markdown has them in this order.
SECTIONS = {
    "verdict": ("Conclusion", ""),
    "health": ("Data health", ""),
    "ledger": ("Sample ledger", "Every dropped row has one reason: rows in are rows kept plus the rows of all reasons."),
    "ic_summary": ("Information coefficient", "`t_naive` takes periods as independent; where holding periods overlap it is inflated, and `newey_west` is the one to read."),
    "newey_west": ("Newey-West", "Overlapping periods depend on each other; `t_inflation` is how far that lifts the naive t."),
    "ic": ("Information coefficient by period", ""),
    "rank_autocorrelation": ("Rank autocorrelation", ""),
    "quantiles": ("Quantiles", "`monotonicity` is the rank correlation of bin and mean return; clear ends with a mixed middle call the factor's definition in question."),
    "double_sort": ("Double sort", ""),
    "portfolio": ("Portfolio statistics (not a tradable equity curve)", "Statistics of the top bin's return less the bottom bin's, equal weights, before costs; years by the median gap of the dates. An empty cell: too few periods, or an equity that is not positive."),
    "factor_returns": ("Returns of top less bottom", ""),
    "stability": ("Decay and stability", "Halves of the sample, and the slope of the IC over time; a slope counts beyond |t| of 2."),
    "in_sample": ("In sample", "Periods whose holding reaches the cut are left out of both."),
    "out_of_sample": ("Out of sample", ""),
    "tail": ("Tail risk", "The threshold is a quantile of all returns: it shows where the worst returns gather. Whether a bin crashes more often than others needs an absolute threshold, `crash_threshold`."),
    "crash_spread": ("Crash spread", ""),
    "turnover": ("Turnover and cost", "`cost` is turnover times two sides at the stated basis points."),
    "returns_ledger": ("Returns that are missing", ""),
}
UNCORRECTED = "No number of trials was given (`n_trials`): p-values are NOT corrected for multiple testing."
HOW_TO_READ = (
    "Read the conclusion with its warnings first; it rests on the Newey-West t and on `p_adj`, the p-value corrected for `n_trials` hypotheses.",
    "A factor that holds out of sample, in most parts of the sample and after costs is more than a small p.",
    "Statistics describe the cleaned sample: see the sample ledger for what was left out, and data health for what may be wrong with it.",
)


@dataclass
class Report:
    """Tables by section, findings, verdict, and what was assumed."""

    name: str
    tables: dict[str, DataFrame]
    health: health.HealthReport | None
    verdict: inference.Verdict
    receipt: Receipt | None
    scalars: dict = field(default_factory=dict)

    def frames(self) -> dict[str, DataFrame]:
        """All tables."""
        return dict(self.tables)

    def sections(self) -> list[str]:
        """Names of the sections, in order."""
        return [*self.tables, *(["health"] if self.health else []), "verdict"]

    def equity_curves(self) -> DataFrame:
        """date, horizon, ret, equity of the top bin against the bottom one."""
        return portfolio.cumulative_returns(self.tables["factor_returns"], "ret", ["horizon"])

    def to_markdown(self, title: str | None = None, rows: int = 20, max_detail: int = 10) -> str:
        """All sections in a fixed order under `## key: title`, tables up to `rows` rows; sections that are not there are left out.

        Titles may change; a section is found by its key, as `sections` gives them.
        """
        out = [f"# {title or self.name}", "", "Numbers carry their uncertainty; an uncorrected p-value is no conclusion.", ""]
        if self.receipt is not None:
            out += [f"Contracts kept by {', '.join(self.receipt.panels)}; between them: {', '.join(self.receipt.cross)}.", *(f"Assumed: {n}." for n in self.receipt.notices), ""]
        for name, (heading, note) in (SECTIONS | {n: (n, "") for n in self.tables if n not in SECTIONS}).items():
            body = self._section(name, rows, max_detail)
            if body is not None:
                out += [f"## {name}: {heading}", "", *body, ""] + ([f"> {self._note(name, note)}", ""] if note else [])
        return "\n".join([*out, "## reading: How to read this report", "", *(f"- {x}" for x in HOW_TO_READ)])

    def _note(self, name: str, note: str) -> str:
        threshold = self.scalars.get("crash_threshold")
        if name == "tail" and threshold is not None:
            return f"The threshold is the return {threshold:.1%} (`crash_threshold`): this is the one to ask whether a bin crashes more often than others."
        return note

    def _section(self, name: str, rows: int, max_detail: int) -> list[str] | None:
        """Lines of a section, None if the report has none of that name."""
        if name == "verdict":
            return self._conclusion()
        if name == "health":
            return None if self.health is None else self.health.to_markdown(max_detail=max_detail).split("\n")[2:]
        if name == "stability":
            found = {h: v for h, v in self.scalars.items() if isinstance(v, dict)}
            flat = {h: {f"{part}.{k}": x for part, own in v.items() for k, x in own.items() if isinstance(x, (int, float, str, bool)) or x is None} for h, v in found.items()}
            keys = list(dict.fromkeys(k for v in flat.values() for k in v))
            if not keys:
                return None
            lines = ["| | " + " | ".join(f"horizon {h}" for h in flat) + " |", "|---|" + "---|" * len(flat)]
            return lines + ["| " + " | ".join([k, *(shown(v.get(k)) for v in flat.values())]) + " |" for k in keys]
        return [markdown_table(self.tables[name], rows)] if name in self.tables else None

    def _conclusion(self) -> list[str]:
        out, e = [], self.verdict.main
        if e:
            out.append(f"{e.name}: mean {e.mean:.4f}, t {e.t_nw:.2f} (naive {e.t_naive:.2f}), p_adj {e.p_adj:.4f}, worth {e.n_eff:.1f} periods of {e.n}")
        n_trials = self.scalars.get("n_trials")
        out.append(UNCORRECTED if n_trials is None else f"p_adj is corrected for n_trials = {n_trials}.")
        if self.verdict.gross is not None:
            out.append(f"gross {self.verdict.gross:.4f}, net {self.verdict.net:.4f}")
        return out + [f"- {w}" for w in self.verdict.warnings]

    def save(self, path: str, kind: str = "parquet", title: str | None = None) -> dict[str, str]:
        """Write one folder for each table (parquet or csv), or the Markdown as one text file; gives what went where."""
        if kind == "markdown":
            spark = next(iter(self.tables.values())).sparkSession
            spark.createDataFrame([(self.to_markdown(title),)], "value string").coalesce(1).write.mode("overwrite").text(path)
            return {"markdown": path}
        if kind not in ("parquet", "csv"):
            fail("report", "bad_kind", f"{kind!r} is none of markdown, parquet, csv")
        where = {}
        for name, df in self.tables.items():
            where[name] = f"{path.rstrip('/')}/{name}"
            writer = df.coalesce(1).write.mode("overwrite")
            writer.parquet(where[name]) if kind == "parquet" else writer.option("header", True).csv(where[name])
        return where


def shown(value) -> str:
    """A cell as text: nothing for what is missing, four digits for doubles, whole numbers whole."""
    return "" if value is None else f"{value:.4f}" if isinstance(value, float) else str(value)


def markdown_table(df: DataFrame, rows: int = 20) -> str:
    """A small table as Markdown."""
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(map(shown, r)) + " |" for r in df.limit(rows).collect()])


def apply_preprocess(data: DataFrame, steps: list[str | tuple], exposures: list[str] | None = None, groups: str | None = None) -> DataFrame:
    """Steps by name, or (name, settings), on the cleaned factor."""
    for step in steps:
        name, settings = (step, {}) if isinstance(step, str) else (step[0], dict(step[1]))
        if name == "winsorize":
            data = winsorize(data, **settings)
        elif name == "standardize":
            data = standardize(data, **settings)
        elif name == "neutralize":
            data = neutralize(data, exposures=settings.get("exposures", exposures), groups=settings.get("groups", groups))
        else:
            fail("report", "bad_step", f"{name!r} is none of winsorize, standardize, neutralize")
    return data


def build_report(
    factor: DataFrame, prices: DataFrame, calendar: DataFrame, *, horizons: tuple[int, ...] = (1, 5, 21), quantiles: int = 5, universe: DataFrame | None = None,
    tradability: DataFrame | None = None, names: DataFrame | None = None, list_dates: DataFrame | None = None, limit_status: DataFrame | None = None,
    exposures: DataFrame | None = None, groupby: DataFrame | None = None, by: str | None = None, model: ReturnModel | None = None, n_trials: int | None = None,
    method: str = "bhy", cost_bps: float = 15.0, name: str = "factor", check_health: bool = True, preprocess: list | None = None, validate: bool = True,
    strict: bool = True, is_oos: float | None = None, crash_threshold: float | None = None,
) -> Report:
    """Evaluate a factor. The cleaned sample is cached; what reaches the driver is series of one value a period."""
    hs = list(horizons)
    receipt = ensure_contract(factor, prices, calendar, universe=universe, tradability=tradability, exposures=exposures, grouping=groupby, strict=strict) if validate else None
    value = next((c for c in ("factor", "value") if c in factor.columns), None) or fail("report", "ambiguous_factor", f"no factor among {factor.columns}")
    if tradability is None and "can_buy_open" not in prices.columns:
        tradability = compute_tradability(prices, calendar, names=names, limit_status=limit_status, list_dates=list_dates)
    elif tradability is None:
        tradability = prices
    returns = forward_returns(prices, calendar, hs, tradability=tradability, model=model)
    cleaned = cleaning.clean(factor.select("date", "asset", F.col(value).alias("factor")), returns, universe=universe, exposures=exposures, groupby=groupby, horizons=hs)
    data = cleaned.data
    if preprocess:
        extra = [c for t in (exposures,) if t is not None for c in t.columns if c not in ("date", "asset")]
        group = next((c for c in groupby.columns if c not in ("date", "asset")), None) if groupby is not None else None
        data = apply_preprocess(data, preprocess, extra, group)
    data = data.cache()
    ic = information_coefficient(data, hs).cache()
    labels = quantize(data, quantiles)
    turnover = quantile_turnover(labels)
    fr = factor_returns(labels, quantiles, hs)
    flat = fr.select("date", F.explode(F.array(*(F.struct(F.lit(h).alias("horizon"), F.col(f"forward_return_{h}").alias("ret")) for h in hs))).alias("r")).select("date", "r.*")
    tables = {
        "ledger": cleaned.ledger(), "returns_ledger": return_ledger(returns, hs), "ic": ic.orderBy("date", "horizon"), "ic_summary": ic_summary(ic).orderBy("horizon"),
        "newey_west": inference.newey_west_summary(ic).orderBy("horizon"), "rank_autocorrelation": rank_autocorrelation(data).orderBy("date"),
        "quantiles": quantile_stats(labels, quantiles, horizons=hs).orderBy("horizon", "factor_quantile"), "turnover": portfolio.turnover_summary(turnover, cost_bps).orderBy("factor_quantile"),
        "tail": tail.tail_by_quantile(labels, hs, threshold=crash_threshold).orderBy("horizon", "factor_quantile"), "crash_spread": tail.crash_spread(labels, quantiles, hs, threshold=crash_threshold).orderBy("horizon"),
        "factor_returns": flat.orderBy("date", "horizon"), "portfolio": portfolio.portfolio_summary(flat, "ret", ["horizon"]).orderBy("horizon"),
    }
    if by:
        tables["double_sort"] = double_sort(data, by, quantiles, quantiles, horizons=hs).orderBy("horizon", "by_quantile", "factor_quantile")
    series = {h: [] for h in hs}
    for r in ic.where("ic is not null").orderBy("date").collect():
        series[r.horizon].append((r.date, r.ic))
    if not any(series.values()):
        fail("report", "no_period", "no section has an IC")
    values = {h: [v for _, v in s] for h, s in series.items()}
    all_p = [inference.p_from_t(inference.nw_tstat(values[h], horizon=h)["t_nw"]) for h in hs]
    estimates = [
        inference.estimate_from_series(values[h], f"RankIC {h}", h, n_trials=n_trials, method=method, all_p=[p for i, p in enumerate(all_p) if i != k and p == p]) for k, h in enumerate(hs)
    ]
    scalars = {h: {"stability": inference.subsample_stability(values[h]), "decay": inference.decay_test(values[h], horizon=h)} for h in hs}
    scalars |= {"n_trials": n_trials, "crash_threshold": crash_threshold}
    ret = [r.ret for r in flat.where(F.col("horizon") == hs[0]).orderBy("date").collect() if r.ret is not None]
    if len(ret) >= 20:
        scalars["dsr"] = inference.dsr(ret, n_trials or 1)
    if is_oos:
        split = portfolio.split_is_oos([d for d, _ in series[hs[0]]], ratio=is_oos, calendar=[r.date for r in calendar.select("date").collect()], purge_horizons=hs)
        for part, days in (("in_sample", split.in_sample), ("out_of_sample", split.out_of_sample)):
            own = data.sparkSession.createDataFrame([(d,) for d in days], "date date")
            tables[part] = ic_summary(ic.join(own, "date", "left_semi"))
    counts = cleaned.rows.agg(F.count("*").alias("n"), F.count("drop_reason").alias("dropped")).first()
    to = {r.date: r.t for r in turnover.where(F.col("factor_quantile").isin(1, quantiles)).groupBy("date").agg(F.avg("turnover").alias("t")).collect()}
    days = [r.date for r in flat.where((F.col("horizon") == hs[0]) & F.col("ret").isNotNull()).orderBy("date").collect()]
    verdict = inference.assess(
        estimates, ret, [to.get(d, 0.0) for d in days], cost_bps, counts.dropped / counts.n if counts.n else None, scalars[hs[0]]["stability"]["same_sign"], n_trials
    )
    found = health.check(prices, None if receipt is None else receipt.panels["factor"], tradability, calendar, name=name) if check_health else None
    return Report(name, tables, found, verdict, receipt, scalars)
