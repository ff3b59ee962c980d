"""Whether an order at the open could have been filled: suspensions, price limits, new stocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crosspanel.functions.xsec import numpy_round
from crosspanel.operators.calendars import days_of, position, position_after, validate_dates

# Rules of the exchanges.
BOARD_RATIO = {"main": 0.10, "star": 0.20, "gem": 0.20, "bse": 0.30}
ST_RATIO = 0.05
ST_PREFIXES = ("ST", "*ST", "SST", "S*ST")
EPS = 1e-6
#: Codes of the optional limit status: suspended, locked at the upper limit, locked at the lower limit.
SUSPENDED, LOCKED_UP, LOCKED_DOWN = 0, 3, 6


def board_of(asset: Column) -> Column:
    """main, star, gem or bse, by the code's first digits."""
    code = F.lpad(asset, 6, "0")
    return (
        F.when(code.startswith("688") | code.startswith("689"), "star").when(code.startswith("30"), "gem")
        .when(code.startswith("4") | code.startswith("8") | code.startswith("92"), "bse").otherwise("main")
    )


def board_ratio(asset: Column) -> Column:
    """Daily price limit of the asset's board."""
    board = board_of(asset)
    out = F.lit(BOARD_RATIO["main"])
    for name, ratio in BOARD_RATIO.items():
        out = F.when(board == name, ratio).otherwise(out)
    return out


def is_st_name(name: Column) -> Column:
    """Whether a name carries the special-treatment mark."""
    flat = F.upper(F.replace(name, F.lit(" "), F.lit("")))
    out = F.lit(False)
    for prefix in ST_PREFIXES:
        out = out | flat.startswith(prefix)
    return F.coalesce(out, F.lit(False))


def limit_ratio(asset: Column, name: Column | None = None) -> Column:
    """Daily price limit of an asset; the mark narrows it on the main board only."""
    ratio = board_ratio(asset)
    return ratio if name is None else F.when(is_st_name(name) & (board_of(asset) == "main"), ST_RATIO).otherwise(ratio)


def limit_prices(prev_close: float, code: str, name: str | None = None, unlimited: bool = False) -> tuple[float, float]:
    """(upper, lower) limit of one asset on one day."""
    if unlimited:
        return float("inf"), 0.0
    code = code.zfill(6)
    board = "star" if code[:3] in ("688", "689") else "gem" if code[:2] == "30" else "bse" if code[0] in "48" or code[:2] == "92" else "main"
    marked = bool(name) and name.upper().replace(" ", "").startswith(ST_PREFIXES)
    ratio = ST_RATIO if marked and board == "main" else BOARD_RATIO[board]
    return round(prev_close * (1 + ratio), 2), round(prev_close * (1 - ratio), 2)


def listed_days(df: DataFrame, calendar: DataFrame | None) -> DataFrame:
    """Add listed_days and listed_days_known from `list_date`: sessions since listing, the first day being 1.

    A listing before the calendar begins is counted in calendar days, 250 sessions to 365; an unknown one by the
    asset's rows.
    """
    days = (F.rint(F.datediff("date", "list_date") * 250 / 365) + 1).cast("int")
    by_row = F.row_number().over(Window.partitionBy("asset").orderBy("date"))
    if calendar is None:
        known = F.when(F.col("list_date").isNotNull(), days)
    else:
        sessions = days_of(calendar)
        # the session a listing falls on, or the next one
        inside = position(sessions, F.col("date")) - position_after(sessions, F.date_sub("list_date", 1)) + 1
        known = F.when(F.col("list_date") >= F.lit(sessions[0]), inside) if sessions else F.when(F.lit(False), F.lit(0))
        known = known.when(F.col("list_date").isNotNull(), days)
    return df.withColumns({"listed_days": F.coalesce(known, by_row).cast("int"), "listed_days_known": F.col("list_date").isNotNull()})


def compute_tradability(
    prices: DataFrame, calendar: DataFrame | None = None, *, names: DataFrame | None = None, limit_status: DataFrame | None = None,
    list_dates: DataFrame | None = None, new_stock_days: int = 60, use_limit_status: bool = False,
) -> DataFrame:
    """Flags and reasons for each price row (date, asset, raw_open, raw_close and perhaps prev_close).

    names (date, asset, name), limit_status (date, asset, limit_status) and list_dates (asset, list_date) are optional.
    New stocks are left out only where the listing date of every row is known, lest a truncated panel lose everything.
    """
    if calendar is not None:
        validate_dates(prices, calendar, "tradability")
    w = Window.partitionBy("asset").orderBy("date")
    df = prices.select("date", "asset", F.col("raw_open").cast("double").alias("open"), F.col("raw_close").cast("double").alias("raw_close"),
                       *([F.col("prev_close").cast("double").alias("prev_close")] if "prev_close" in prices.columns else []))
    if "prev_close" not in prices.columns:
        df = df.withColumn("prev_close", F.lag("raw_close").over(w))
    df = df.join(names.select("date", "asset", "name"), ["date", "asset"], "left") if names is not None else df.withColumn("name", F.lit(None).cast("string"))
    if limit_status is not None:
        df = df.join(limit_status.select("date", "asset", F.col("limit_status").cast("int").alias("status")), ["date", "asset"], "left")
    else:
        df = df.withColumn("status", F.lit(None).cast("int"))
    if list_dates is not None:
        df = df.join(list_dates.select("asset", "list_date"), "asset", "left")
    else:
        df = df.withColumn("list_date", F.lit(None).cast("date"))
    df = listed_days(df, calendar)
    suspended = F.col("open").isNull() | (F.col("open") <= 0) | F.coalesce(F.col("status") == SUSPENDED, F.lit(False))
    ratio = limit_ratio(F.col("asset"), F.col("name"))
    df = df.withColumns({"suspended": suspended, "is_st": is_st_name(F.col("name")), "limit_ratio": ratio})
    df = df.withColumns({
        "limit_up_price": numpy_round(F.col("prev_close") * (1 + F.col("limit_ratio"))), "limit_down_price": numpy_round(F.col("prev_close") * (1 - F.col("limit_ratio"))),
    })
    up, down = F.col("open") >= F.col("limit_up_price") - EPS, F.col("open") <= F.col("limit_down_price") + EPS
    fallback = F.lit(use_limit_status or names is None) | F.col("prev_close").isNull()
    by_status = F.coalesce(F.col("status").isin(LOCKED_UP, LOCKED_DOWN), F.lit(False)) & fallback
    df = df.withColumns({
        "open_at_limit_up": F.coalesce(F.when(by_status, F.col("status") == LOCKED_UP).otherwise(up), F.lit(False)),
        "open_at_limit_down": F.coalesce(F.when(by_status, F.col("status") == LOCKED_DOWN).otherwise(down), F.lit(False)),
        "calc_source": F.when(by_status, "limit_status").otherwise("price"),
    })
    new = F.lit(False)
    if list_dates is not None and new_stock_days:
        unknown = df.where(~F.col("listed_days_known")).limit(1).count()
        new = F.lit(False) if unknown else F.col("listed_days") <= new_stock_days
    df = df.withColumn("is_new_stock", new)
    return df.select(
        "date", "asset", "prev_close", "suspended", "is_st", "listed_days", "listed_days_known", "limit_ratio", "limit_up_price", "limit_down_price",
        "open_at_limit_up", "open_at_limit_down", "calc_source", "is_new_stock",
        (~(F.col("suspended") | F.col("open_at_limit_up") | F.col("is_new_stock"))).alias("can_buy_open"),
        (~(F.col("suspended") | F.col("open_at_limit_down"))).alias("can_sell_open"),
        F.when(F.col("suspended"), "suspended").when(F.col("is_new_stock"), "new_stock").when(F.col("open_at_limit_up"), "limit_up").otherwise("ok").alias("reason_buy"),
        F.when(F.col("suspended"), "suspended").when(F.col("open_at_limit_down"), "limit_down").otherwise("ok").alias("reason_sell"),
    )
