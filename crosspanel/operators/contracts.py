"""Input contracts: what a panel must be before anything is computed from it.

A violation raises ContractError; nothing is repaired silently. All rules of all panels, and those between panels, are
branches of one job (`ensure_contract`); `watched` counts row rules in the pass that reads a panel anyway.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEYS = ["date", "asset"]
PRICE_KINDS = ("open", "high", "low", "close")


class ContractError(ValueError):
    """A contract, the rule of it that was broken, and where."""

    def __init__(self, contract: str, rule: str, detail: str) -> None:
        super().__init__(f"[{contract}] breaks rule `{rule}`: {detail}")
        self.contract, self.rule, self.detail = contract, rule, detail


def fail(contract: str, rule: str, detail: str) -> None:
    """Refuse."""
    raise ContractError(contract, rule, detail)


def describe_rows(df: DataFrame, n: int = 3) -> str:
    """The first keys of a table, for messages."""
    return "; ".join(str(tuple(r)) for r in df.select(*[k for k in KEYS if k in df.columns]).limit(n).collect())


@dataclass(frozen=True)
class PanelSpec:
    """What a kind of panel requires of its columns."""

    name: str
    required: tuple[str, ...] = ()
    numeric: tuple[str, ...] = ()
    positive: tuple[str, ...] = ()
    unique: bool = True


FACTOR = PanelSpec("FactorPanel", ("value", "available_at"), ("value",))
PRICES = PanelSpec(
    "PricePanel",
    tuple(f"raw_{k}" for k in PRICE_KINDS) + ("prev_close", "adj_factor") + tuple(f"adj_{k}" for k in PRICE_KINDS),
    tuple(f"raw_{k}" for k in PRICE_KINDS) + ("prev_close", "adj_factor") + tuple(f"adj_{k}" for k in PRICE_KINDS),
    tuple(f"raw_{k}" for k in PRICE_KINDS) + ("adj_factor",) + tuple(f"adj_{k}" for k in PRICE_KINDS),
)
TRADABILITY = PanelSpec("Tradability")
UNIVERSE = PanelSpec("Universe", ("in_universe",))
GROUPING = PanelSpec("Grouping")
EXPOSURES = PanelSpec("Exposures")
EVENTS = PanelSpec("Events", ("event_type",), unique=False)
SIGNALS = ("can_buy_open", "can_sell_open", "suspended", "is_st", "listed_days")


def _is_bad(c: str) -> Column:
    return F.abs(F.col(c)) == float("inf")


def group_col(grouping: DataFrame) -> str:
    """The column that a grouping's labels are in: `group`, or its only one beside the keys."""
    extra = [c for c in grouping.columns if c not in KEYS]
    if not extra:
        fail("Grouping", "empty", "no column beside the keys")
    if len(extra) > 1 and "group" not in extra:
        fail("Grouping", "ambiguous_group", f"several columns and none named `group`: {extra}")
    return "group" if "group" in extra else extra[0]


def check_schema(df: DataFrame, spec: PanelSpec) -> None:
    """Refuse what the schema alone shows to be wrong; no job is run."""
    missing = [c for c in (*KEYS, *spec.required) if c not in df.columns]
    if missing:
        fail(spec.name, "missing_column", f"no column {missing}; there are {df.columns}")
    kinds = {f.name: f.dataType for f in df.schema}
    if not isinstance(kinds["date"], (T.DateType, T.TimestampNTZType)):
        fail(spec.name, "date_dtype", f"`date` is {kinds['date'].simpleString()}, not a date without time zone")
    if not isinstance(kinds["asset"], T.StringType):
        fail(spec.name, "asset_dtype", f"`asset` is {kinds['asset'].simpleString()}, not a string")
    for c in spec.numeric:
        if not isinstance(kinds[c], T.NumericType):
            fail(spec.name, "not_numeric", f"`{c}` is {kinds[c].simpleString()}")
    extra = [c for c in df.columns if c not in KEYS]
    if spec is EXPOSURES and not extra:
        fail(spec.name, "empty", "no column beside the keys")
    if spec is GROUPING:
        group_col(df)
    if spec is TRADABILITY and not any(c in SIGNALS for c in extra):
        fail(spec.name, "missing_signal", f"none of {SIGNALS}")


def row_rules(df: DataFrame, spec: PanelSpec) -> dict[tuple[str, str], Column]:
    """(rule, column) and the condition of a row that breaks it."""
    rules: dict[tuple[str, str], Column] = {}
    for f in df.schema:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            rules["not_finite", f.name] = _is_bad(f.name)
    for c in spec.positive:
        rules["not_positive", c] = F.col(c) <= 0
    if spec is FACTOR:
        rules["lookahead", "available_at"] = F.col("available_at") > F.col("date")
    if spec is PRICES:
        for k in PRICE_KINDS:
            rules["adjust_incomplete", k] = F.col(f"raw_{k}").isNotNull() & (F.col(f"adj_{k}").isNull() | F.col("adj_factor").isNull())
    return rules


def _metrics(df: DataFrame, spec: PanelSpec) -> list[Column]:
    """What all row rules of a panel come down to, as aggregates of one row."""
    key = F.concat_ws(" ", F.col("date").cast("string"), "asset")
    asked = [F.count(F.lit(1)).alias("n")]
    for i, rule in enumerate(row_rules(df, spec).values()):
        asked += [F.count_if(rule).alias(f"n{i}"), F.min(F.when(rule, key)).alias(f"k{i}")]
    if spec is FACTOR:
        asked.append(F.count("value").alias("values"))
    if spec is PRICES:
        asked += [F.max(F.abs(F.col(f"raw_{k}") * F.col("adj_factor"))).alias(f"scale_{k}") for k in PRICE_KINDS]
        asked += [F.max(F.abs(F.col(f"adj_{k}") - F.col(f"raw_{k}") * F.col("adj_factor"))).alias(f"gap_{k}") for k in PRICE_KINDS]
    return asked


def _verdicts(df: DataFrame, spec: PanelSpec) -> list[tuple[str, str, Column, Column]]:
    """(rule, column, rows that break it, where) over the metrics of a panel, in the order in which they are reported."""
    out = [(rule, c, F.col(f"n{i}"), F.col(f"k{i}")) for i, (rule, c) in enumerate(row_rules(df, spec))]
    if spec is FACTOR:
        out.append(("all_missing", "value", F.when(F.col("values") == 0, F.col("n")).otherwise(0), F.lit("no value at all")))
    if spec is PRICES:
        for k in PRICE_KINDS:
            apart = F.col(f"gap_{k}") > 1e-8 * F.col(f"scale_{k}")
            text = F.concat(F.lit(f"adj_{k} differs from raw_{k} * adj_factor by "), F.col(f"gap_{k}").cast("string"))
            out.append(("adjust_inconsistent", f"adj_{k}", F.coalesce(apart, F.lit(False)).cast("long"), text))
    return out


RULE_SCHEMA = "panel string, rule string, column string, n bigint, note string"


def _rule_row(panel: str, rule: str, column: str, n: Column, note: Column) -> Column:
    return F.struct(F.lit(panel).alias("panel"), F.lit(rule).alias("rule"), F.lit(column).alias("column"), n.cast("long").alias("n"), note.cast("string").alias("note"))


def rule_counts(df: DataFrame, spec: PanelSpec, panel: str | None = None, keys: bool = True) -> DataFrame:
    """panel, rule, column, n, note: every rule of a panel, how many rows (keys, for `duplicate_key`) break it, and the first.

    All row rules are one aggregate over one pass; uniqueness of the keys, unless left out, is a second branch of the same job.
    """
    check_schema(df, spec)
    name = panel or spec.name
    cells = F.explode(F.array(*(_rule_row(name, rule, c, n, note) for rule, c, n, note in _verdicts(df, spec))))
    out = df.agg(*_metrics(df, spec)).select(cells.alias("r")).select("r.*") if _verdicts(df, spec) else None
    if spec.unique and keys:
        key = F.concat_ws(" ", F.col("date").cast("string"), "asset")
        twice = df.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("c")).where("c > 1").agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("k"))
        twice = twice.select(_rule_row(name, "duplicate_key", "date, asset", F.col("n"), F.col("k")).alias("r")).select("r.*")
        out = twice if out is None else out.unionByName(twice)
    return df.sparkSession.createDataFrame([], RULE_SCHEMA) if out is None else out


def _refuse(specs: dict[str, str], rows: list) -> None:
    """Raise for the first broken rule, panels in the order given."""
    order = list(specs)
    for r in sorted((r for r in rows if r.n), key=lambda r: order.index(r.panel)):
        fail(specs[r.panel], r.rule, f"`{r.column}`: {r.n} rows, the first {r.note}" if r.rule not in WHOLE_NOTE else r.note)


#: Rules between panels; and those whose note is the whole message.
BETWEEN = ("off_calendar", "asset_type", "coverage", "not_in_prices", "outside", "unknown")
WHOLE_NOTE = (*BETWEEN, "all_missing", "adjust_inconsistent")


def validate(df: DataFrame, spec: PanelSpec) -> DataFrame:
    """The panel itself, if it keeps its contract: one job for all its rules."""
    _refuse({spec.name: spec.name}, rule_counts(df, spec).collect())
    return df


@dataclass(frozen=True)
class Watched:
    """A panel whose row rules are counted by whatever job first reads it, and the verdict afterwards."""

    rows: DataFrame
    spec: PanelSpec
    observation: Observation
    rules: tuple[tuple[str, str], ...]

    def counts(self) -> dict[tuple[str, str], int]:
        """(rule, column) and the rows that broke it; waits for the first job over `rows`."""
        found = self.observation.get
        return {rule: found[f"n{i}"] for i, rule in enumerate(self.rules)}

    def verify(self) -> DataFrame:
        """The rows, or ContractError."""
        found = self.observation.get
        for (rule, c), n in self.counts().items():
            if n:
                fail(self.spec.name, rule, f"`{c}`: {n} rows, the first {found[f'k{self.rules.index((rule, c))}']}")
        if self.spec is FACTOR and found["n"] and not found["values"]:
            fail(self.spec.name, "all_missing", "no value at all")
        if self.spec is PRICES:
            for k in PRICE_KINDS:
                if found[f"gap_{k}"] is not None and found[f"gap_{k}"] > 1e-8 * found[f"scale_{k}"]:
                    fail(self.spec.name, "adjust_inconsistent", f"adj_{k} differs from raw_{k} * adj_factor by {found[f'gap_{k}']}")
        return self.rows


def watched(df: DataFrame, spec: PanelSpec) -> Watched:
    """The panel with its row rules as metrics of the pass that reads it: no job of its own.

    Uniqueness of the keys needs a shuffle and is left to `validate`.
    """
    check_schema(df, spec)
    observation = Observation()
    return Watched(df.observe(observation, *_metrics(df, spec)), spec, observation, tuple(row_rules(df, spec)))


def factor_frame(df: DataFrame, assume_available_at: bool = True, notices: list[str] | None = None) -> DataFrame:
    """date, asset, value, available_at from a table that holds its factor as `factor`, `value` or its only other column."""
    others = [c for c in df.columns if c not in (*KEYS, "available_at")]
    name = next((c for c in ("factor", "value") if c in others), others[0] if len(others) == 1 else None)
    if name is None:
        fail("FactorPanel", "ambiguous_factor", f"which of {others} is the factor?")
    out = df.withColumnRenamed(name, "value") if name != "value" else df
    if "available_at" not in df.columns:
        if not assume_available_at:
            fail("FactorPanel", "missing_column", "no `available_at`")
        if notices is not None:
            notices.append("available_at is taken to be the date itself")
        out = out.withColumn("available_at", F.col("date"))
    return out.select(*KEYS, "value", "available_at")


@dataclass
class Receipt:
    """The panels that were checked, what was checked across them, and what was assumed."""

    panels: dict[str, DataFrame]
    cross: list[str] = field(default_factory=list)
    notices: list[str] = field(default_factory=list)


def _control_frame(df: DataFrame, notices: list[str]) -> PanelSpec:
    """The contract of a grouping; one of several columns without `group` is only checked as exposures are, and says so."""
    extra = [c for c in df.columns if c not in KEYS]
    if len(extra) < 2 or "group" in extra:
        return GROUPING
    notices.append(f"the grouping has {len(extra)} columns and none named `group`: checked for its shape only, neutralizing needs one column")
    return EXPOSURES


def cross_rules(
    panels: dict[str, DataFrame], calendar: DataFrame, strict: bool = True, most_unknown: float = 0.2, least_coverage: float = 0.5, unique: tuple[str, ...] = (),
) -> DataFrame:
    """panel, rule, column, n, note of the rules between panels, and of the keys of those in `unique`. Nothing is run.

    All panels' keys meet in one grouping, from which come copies, strangers, dates and assets.
    """
    names = list(panels)
    known = lambda name: (F.col("in_universe") if name == "universe" else F.lit(None).cast("boolean")).alias("known")
    rows = reduce(DataFrame.unionByName, [panels[n].select(*KEYS, F.lit(n).alias("panel"), known(n)) for n in names])
    keys = rows.groupBy(*KEYS).agg(*(F.count_if(F.col("panel") == n).alias(n) for n in names), F.min("known").alias("known"))
    key = F.concat_ws(" ", F.col("date").cast("string"), "asset")

    def table(df: DataFrame, cells: list[Column]) -> DataFrame:
        return df.select(F.explode(F.array(*cells)).alias("r")).select("r.*")

    text = lambda *parts: F.concat(*(p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts))
    of, cells = [F.lit(1).alias("one")], []
    for n in unique:
        of += [F.count_if(F.col(n) > 1).alias(f"twice_{n}"), F.min(F.when(F.col(n) > 1, key)).alias(f"first_{n}")]
        cells.append(_rule_row(n, "duplicate_key", "date, asset", F.col(f"twice_{n}"), F.col(f"first_{n}")))
    if strict:
        lost = (F.col("factor") > 0) & (F.col("prices") == 0)
        of += [F.coalesce(F.sum(F.when(lost, F.col("factor"))), F.lit(0)).alias("lost"), F.min(F.when(lost, key)).alias("first_lost")]
        cells.append(_rule_row("factor", "not_in_prices", "date, asset", F.col("lost"), text(F.col("lost"), " rows, such as ", F.col("first_lost"))))
    if "universe" in panels:
        own, inside = F.col("factor"), F.col("known")
        of += [F.coalesce(F.sum(own), F.lit(0)).alias("n_own")]
        of += [F.coalesce(F.sum(F.when(w, own)), F.lit(0)).alias(c) for c, w in (("outside", ~inside), ("unknown", inside.isNull()))]
        cells.append(_rule_row("universe", "outside", "in_universe", F.col("outside"), text(F.col("outside"), " factor rows lie outside the universe")))
        many = F.when(F.col("unknown") > most_unknown * F.col("n_own"), F.col("unknown")).otherwise(0)
        cells.append(_rule_row("universe", "unknown", "in_universe", many, text(F.col("unknown"), " factor rows are not in the universe table")))
    out = [table(keys.agg(*of), cells)] if cells else []
    if strict:
        there = F.array_compact(F.array(*(F.when(F.max(n) > 0, F.lit(n)) for n in names)))
        dates = keys.groupBy("date").agg(there.alias("panels"))
        off = dates.join(F.broadcast(calendar.select("date")), "date", "left_anti")  # a row a session
        off = off.agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("date", "panels")).alias("first"))
        out.append(table(off, [_rule_row("calendar", "off_calendar", "date", F.col("n"), F.concat_ws(" ", F.array_join("first.panels", ", "), F.col("first.date").cast("string")))]))
    assets = keys.groupBy("asset").agg((F.max("factor") > 0).alias("asked"), (F.max("prices") > 0).alias("there")).where("asked")
    assets = assets.agg(F.count(F.lit(1)).alias("n"), F.count_if("there").alias("there"))
    none = F.when((F.col("n") > 0) & (F.col("there") == 0), F.col("n")).otherwise(0)
    few = F.when(F.col("there") < least_coverage * F.col("n"), F.col("n") - F.col("there")).otherwise(0)
    out.append(table(assets, [
        _rule_row("factor", "asset_type", "asset", none, F.lit("no asset of the factor is in the prices: are codes written alike?")),
        _rule_row("prices", "coverage", "asset", few, text("prices hold ", F.col("there"), " of ", F.col("n"), " assets of the factor")),
    ]))
    return reduce(DataFrame.unionByName, out)


def ensure_contract(
    factor: DataFrame, prices: DataFrame, calendar: DataFrame, *, universe: DataFrame | None = None, tradability: DataFrame | None = None,
    grouping: DataFrame | None = None, exposures: DataFrame | None = None, events: DataFrame | None = None, strict: bool = True,
    assume_available_at: bool = True, most_unknown: float = 0.2, least_coverage: float = 0.5,
) -> Receipt:
    """Check every input and the relations between them, all in one job; `calendar` is (date, pos)."""
    notices: list[str] = []
    panels, specs = {"factor": factor_frame(factor, assume_available_at, notices), "prices": prices}, {"factor": FACTOR, "prices": PRICES}
    given = {"universe": (universe, UNIVERSE), "tradability": (tradability, TRADABILITY), "exposures": (exposures, EXPOSURES), "events": (events, EVENTS)}
    if grouping is not None:
        given["grouping"] = (grouping, _control_frame(grouping, notices))
    for name, (df, spec) in given.items():
        if df is not None:
            panels[name], specs[name] = df, spec
    own = [rule_counts(df, specs[name], name, keys=False) for name, df in panels.items()]
    between = cross_rules(panels, calendar, strict, most_unknown, least_coverage, tuple(n for n, s in specs.items() if s.unique))
    rows = reduce(DataFrame.unionByName, [*own, between]).where("n > 0").collect()
    names = {n: s.name for n, s in specs.items()} | {"calendar": "calendar"}
    # what is wrong within a panel comes before what is wrong between panels
    _refuse(names, [r for r in rows if r.rule not in BETWEEN])
    _refuse({"calendar": "calendar"} | names, [r for r in rows if r.rule in BETWEEN])
    cross = [*(["dates_on_calendar"] if strict else []), "asset_type", "price_coverage", *(["factor_in_prices"] if strict else []), *(["universe_covers_factor"] if universe is not None else [])]
    return Receipt(panels, cross=cross, notices=notices)


def validate_inputs(factor: DataFrame, prices: DataFrame, calendar: DataFrame, **others) -> bool:
    """True, or ContractError."""
    ensure_contract(factor, prices, calendar, **others)
    return True


def check_adjust_agreement(
    adj_a: DataFrame, adj_b: DataFrame, tol: float = 1e-6, price: str = "adj_close", calendar: DataFrame | None = None, name_a: str = "computed", name_b: str = "stored",
) -> dict[str, float]:
    """Two adjusted price series (date, asset, price) must give the same filled returns within `tol`.

    With a calendar (date, pos), only returns from one session to the next count; a gap of several is left out of both.
    """
    both = adj_a.select(*KEYS, F.col(price).alias("a")).join(adj_b.select(*KEYS, F.col(price).alias("b")), KEYS)
    if calendar is not None:
        both = both.join(F.broadcast(calendar.select("date", "pos")), "date")  # a row a session
    w = Window.partitionBy("asset").orderBy("date")
    for c in "ab":
        both = both.withColumn(c, F.last(c, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    next_to = F.lit(True) if calendar is None else F.col("pos") - F.lag("pos").over(w) == 1
    for c in "ab":
        both = both.withColumn(f"r{c}", F.when(next_to, F.try_divide(F.col(c), F.lag(c).over(w)) - 1))
    gap = F.abs(F.col("ra") - F.col("rb"))
    row = both.agg(F.count(gap).alias("n"), F.max(gap).alias("gap"), F.count_if(gap > tol).alias("bad")).first()
    if row.bad:
        fail("adjust", "disagreement", f"{row.bad} of {row.n} returns of {name_a} and {name_b} differ by more than {tol}, at most by {row.gap}")
    return {"n": row.n, "max_diff": row.gap or 0.0}
