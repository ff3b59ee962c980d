"""Where panels come from: named sources, folders of Parquet, and tables at hand; and the loaders on top of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crosspanel.operators import calendars, contracts
from crosspanel.operators.adjust import compute_adj_factor, fill_prev_close, with_adjusted
from crosspanel.operators.contracts import fail


class InputAdapter:
    """A source of panels. Prices and factors are what a source must have; None says that it lacks the rest."""

    def prices(self, start=None, end=None) -> DataFrame:
        """date, asset and prices."""
        raise NotImplementedError

    def factor(self, name: str, start=None, end=None) -> DataFrame:
        """date, asset and one factor."""
        raise NotImplementedError

    def calendar(self, start=None, end=None) -> DataFrame | None:
        """Sessions."""
        return None

    def xdxr(self) -> DataFrame | None:
        """Ex-rights events."""
        return None

    def panel(self, kind: str, start=None, end=None) -> DataFrame | None:
        """universe, tradability, exposures, events or a grouping."""
        return None


_SOURCES: dict[str, Callable[..., InputAdapter]] = {}


def register(name: str, factory: Callable[..., InputAdapter]) -> None:
    """Name a source."""
    _SOURCES[name] = factory


def list_sources() -> list[str]:
    """Names of sources."""
    return sorted(_SOURCES)


def get_source(name: str, **settings) -> InputAdapter:
    """A source by name."""
    if name not in _SOURCES:
        fail("loader", "unknown_source", f"{name!r} is none of {list_sources()}")
    return _SOURCES[name](**settings)


def resolve(source, **settings) -> InputAdapter:
    """A source from a name, a class or itself."""
    if isinstance(source, str):
        return get_source(source, **settings)
    return source(**settings) if isinstance(source, type) else source


def keyed(df: DataFrame, date: str = "date", asset: str = "asset") -> DataFrame:
    """A table with its keys as `date` (a date) and `asset` (text); NaN becomes NULL."""
    for c in (date, asset):
        if c not in df.columns:
            fail("loader", "missing_column", f"no column {c!r} among {df.columns}")
    rest = [c for c in df.columns if c not in (date, asset)]
    kinds = dict(df.dtypes)
    number = lambda c: F.when(~F.isnan(c), F.col(c)).alias(c) if kinds[c] in ("double", "float") else F.col(c)
    return df.select(F.col(date).cast("date").alias("date"), F.col(asset).cast("string").alias("asset"), *map(number, rest))


def sliced(df: DataFrame, start, end, what: str) -> DataFrame:
    """Rows of a closed range of dates; the filter reaches the Parquet scan."""
    if start is None and end is None:
        return df
    if start is not None:
        df = df.where(F.col("date") >= F.lit(start).cast("date"))
    if end is not None:
        df = df.where(F.col("date") <= F.lit(end).cast("date"))
    if not df.limit(1).count():
        fail("loader", "empty_range", f"{what} has no rows from {start} to {end}")
    return df


class ParquetAdapter(InputAdapter):
    """A folder: prices, xdxr, universe, tradability, exposures, events and calendar.parquet, factors/<name>.parquet."""

    def __init__(self, spark: SparkSession, root: str, strict: bool = True) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        if strict and self._read("prices") is None:
            fail("loader", "no_prices", f"no prices.parquet in {root}")

    def _read(self, name: str) -> DataFrame | None:
        try:
            return self.spark.read.parquet(f"{self.root}/{name}.parquet")
        except AnalysisException as why:
            if "PATH_NOT_FOUND" in str(why):
                return None
            raise

    def prices(self, start=None, end=None) -> DataFrame:
        found = self._read("prices")
        return fail("loader", "no_prices", self.root) if found is None else sliced(keyed(found), start, end, "prices")

    def factor(self, name: str, start=None, end=None) -> DataFrame:
        found = self._read(f"factors/{name}")
        return fail("loader", "no_factor", f"no factors/{name}.parquet in {self.root}") if found is None else sliced(keyed(found), start, end, name)

    def calendar(self, start=None, end=None) -> DataFrame | None:
        found = self._read("calendar")
        return None if found is None else calendars.from_dates(sliced(found, start, end, "calendar"))

    def xdxr(self) -> DataFrame | None:
        found = self._read("xdxr")
        return None if found is None else keyed(found)

    def panel(self, kind: str, start=None, end=None) -> DataFrame | None:
        found = self._read(kind)
        return None if found is None else sliced(keyed(found), start, end, kind)


class DataFrameAdapter(InputAdapter):
    """Tables at hand: prices, factors by name, and any other panel by its kind."""

    def __init__(self, prices: DataFrame | None = None, factors: dict[str, DataFrame] | None = None, **panels: DataFrame) -> None:
        if prices is None and not factors:
            fail("loader", "nothing_given", "prices or factors are needed")
        self._prices, self._factors, self._panels = prices, factors or {}, panels

    def prices(self, start=None, end=None) -> DataFrame:
        return fail("loader", "no_prices", "none were given") if self._prices is None else sliced(keyed(self._prices), start, end, "prices")

    def factor(self, name: str, start=None, end=None) -> DataFrame:
        if name not in self._factors:
            fail("loader", "no_factor", f"{name!r} is none of {sorted(self._factors)}")
        return sliced(keyed(self._factors[name]), start, end, name)

    def calendar(self, start=None, end=None) -> DataFrame | None:
        found = self._panels.get("calendar")
        return None if found is None else calendars.from_dates(sliced(found, start, end, "calendar"))

    def xdxr(self) -> DataFrame | None:
        found = self._panels.get("xdxr")
        return None if found is None else keyed(found)

    def panel(self, kind: str, start=None, end=None) -> DataFrame | None:
        found = self._panels.get(kind)
        return None if found is None else sliced(keyed(found), start, end, kind)


register("parquet", ParquetAdapter)
register("dataframe", DataFrameAdapter)
register("df", DataFrameAdapter)


def load_prices(source, start=None, end=None, adjust_source: str = "computed", validate: bool = True, xdxr: DataFrame | None = None, **settings) -> DataFrame:
    """Prices with previous close, adjustment factor (computed from ex-rights events, or stored) and adjusted prices.

    Events at hand, `xdxr`, come before the source's own.
    """
    adapter = resolve(source, **settings)
    raw = fill_prev_close(adapter.prices())
    if adjust_source == "computed":
        raw = raw.drop("adj_factor").join(compute_adj_factor(raw, adapter.xdxr() if xdxr is None else keyed(xdxr)), contracts.KEYS)
    elif adjust_source != "stored":
        fail("loader", "bad_adjust_source", f"{adjust_source!r} is neither computed nor stored")
    elif "adj_factor" not in raw.columns:
        fail("loader", "missing_column", "no stored adj_factor")
    out = sliced(with_adjusted(raw), start, end, "prices")
    return contracts.validate(out, contracts.PRICES) if validate else out


def load_factor(name: str, source, start=None, end=None, validate: bool = True, **settings) -> DataFrame:
    """A factor as date, asset, value, available_at."""
    out = contracts.factor_frame(resolve(source, **settings).factor(name, start, end))
    return contracts.validate(out, contracts.FACTOR) if validate else out


def load_calendar(source, start=None, end=None, **settings) -> DataFrame:
    """The source's calendar, or the dates of its prices."""
    adapter = resolve(source, **settings)
    found = adapter.calendar(start, end)
    return calendars.from_dates(adapter.prices(start, end)) if found is None else found


def _load_panel(kind: str, spec: contracts.PanelSpec):
    def load(source, start=None, end=None, validate: bool = True, **settings) -> DataFrame | None:
        found = resolve(source, **settings).panel(kind, start, end)
        return contracts.validate(found, spec) if found is not None and validate else found

    load.__doc__ = f"The source's {kind}, or None."
    return load


load_universe = _load_panel("universe", contracts.UNIVERSE)
load_tradability = _load_panel("tradability", contracts.TRADABILITY)
load_exposures = _load_panel("exposures", contracts.EXPOSURES)
load_events = _load_panel("events", contracts.EVENTS)


def load_grouping(source, name: str = "grouping", start=None, end=None, validate: bool = True, **settings) -> DataFrame | None:
    """One of the source's groupings, or None."""
    return _load_panel(name, contracts.GROUPING)(source, start, end, validate, **settings)
