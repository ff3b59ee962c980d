"""Calendar-exact forward returns: all horizons from windows over session numbers, in one shuffle by asset."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crosspanel.operators.calendars import days_of, position, session
from crosspanel.operators.contracts import fail

DROP_REASONS = ("limit_up", "limit_down", "suspended", "new_stock", "not_tradable")


@dataclass(frozen=True)
class ReturnModel:
    """When a position is entered and left, and what happens where it can't be."""

    entry: str = "next_open"
    exit_price: str = "open"
    policy: str = "skip"
    max_delay: int = 3
    delist_policy: str = "nan"
    delist_return: float = 0.0
    exit_policy: str = "assume"

    def __post_init__(self) -> None:
        allowed = {
            "entry": ("next_open", "close", "same_open"), "exit_price": ("open", "close"), "policy": ("skip", "mark_only"),
            "delist_policy": ("nan", "last_price", "haircut"), "exit_policy": ("assume", "drop", "delay"),
        }
        for name, values in allowed.items():
            if getattr(self, name) not in values:
                fail("ReturnModel", f"bad_{name}", f"{getattr(self, name)!r} is none of {values}")
        if self.delist_policy == "haircut" and not -1 < self.delist_return <= 0:
            fail("ReturnModel", "bad_delist_return", f"{self.delist_return} is not in (-1, 0]")


def forward_returns(prices: DataFrame, calendar: DataFrame, horizons: list[int], *, tradability: DataFrame | None = None, model: ReturnModel | None = None) -> DataFrame:
    """One row for each price row: entry, and forward, overnight and total return, exit and fate for each horizon.

    A look-up h sessions ahead is a RANGE frame of exactly h over the asset's session numbers: NULL where that session
    has no row. An asset whose last price lies before an exit without a price counts as delisted.
    """
    model = model or ReturnModel()
    if model.exit_policy != "assume" and tradability is None:
        fail("returns", "no_tradability", f"exit_policy={model.exit_policy!r} needs a tradability table")
    enter = "adj_close" if model.entry == "close" else "adj_open"
    leave = f"adj_{model.exit_price}"
    lag = 1 if model.entry == "next_open" else 0
    days = days_of(calendar)
    df = prices.select("date", "asset", *dict.fromkeys((enter, leave, "adj_close")), position(days, F.col("date")).alias("pos"))
    if tradability is not None:
        has = set(tradability.columns)
        if not has & {"can_buy_open", "suspended"}:
            fail("returns", "bad_tradability", f"neither can_buy_open nor suspended among {sorted(has)}")
        free = ~F.coalesce(F.col("suspended"), F.lit(True)) if "suspended" in has else F.lit(None).cast("boolean")
        flags = tradability.select(
            "date", "asset", (F.col("can_buy_open") if "can_buy_open" in has else free).alias("_buy"),
            (F.col("can_sell_open") if "can_sell_open" in has else free).alias("_sell"),
            (F.col("reason_buy") if "reason_buy" in has else F.lit(None).cast("string")).alias("_why"),
        )
        df = df.join(flags, ["date", "asset"], "left")
    w, asset = Window.partitionBy("asset").orderBy("pos"), Window.partitionBy("asset")
    at = lambda c, n: F.first(c).over(w.rangeBetween(n, n)) if n else F.col(c)
    # all look-ups first, in one projection: they share the partitioning and the order of one window
    there = F.when(F.col(leave).isNotNull(), F.col("pos"))
    seen = {"entry_px": at(enter, lag), "_last_pos": F.max(there).over(asset), "_last_px": F.max_by(leave, there).over(asset)}
    seen |= {f"_raw_{h}": at(leave, lag + h) for h in horizons}
    if tradability is not None:
        seen |= {"_can": F.coalesce(at("_buy", lag), F.lit(False)), "_because": at("_why", lag)}
    if model.exit_policy != "assume":
        seen |= {f"_can_{h}": F.coalesce(at("_sell", lag + h), F.lit(False)) for h in horizons}
    if model.exit_policy == "delay":
        open_ = F.when(F.coalesce(F.col("_sell"), F.lit(False)) & F.col(leave).isNotNull(), F.struct(F.col("pos").alias("p"), F.col(leave).alias("x")))
        seen |= {f"_later_{h}": F.min(open_).over(w.rangeBetween(lag + h + 1, lag + h + model.max_delay)) for h in horizons}
    df = df.withColumns(seen)
    if tradability is None:
        buy = F.col("entry_px").isNotNull()
        reason = F.when(buy, "ok").otherwise("no_price")
    else:
        buy = F.col("_can") & F.col("entry_px").isNotNull()
        told = F.coalesce(F.col("_because"), F.lit("not_tradable")) if "reason_buy" in tradability.columns else F.when(buy, "ok").otherwise("not_tradable")
        reason = F.when(F.col("entry_px").isNull(), "no_price").otherwise(told)
    gap = F.try_divide(F.col("entry_px"), F.col("adj_close")) - 1 if lag else F.lit(0.0)
    df = df.withColumns({
        "entry_date": session(days, F.col("pos") + lag), "overnight_gap": gap, "entry_reason": reason,
        "entry_tradable": F.lit(True) if model.policy == "mark_only" and tradability is not None else buy,
    })
    first, second, third = {}, {}, {}
    for h in horizons:
        k = lag + h
        raw, pos = F.col(f"_raw_{h}"), F.when(F.col("pos") + k < len(days), F.col("pos") + k)
        gone = F.coalesce(pos > F.col("_last_pos"), F.lit(False)) & raw.isNull()
        px, blocked, moved = raw, F.lit(False), F.lit(False)
        if model.delist_policy != "nan":
            px = F.when(gone, F.col("_last_px") * (1.0 if model.delist_policy == "last_price" else 1.0 + model.delist_return)).otherwise(px)
        if model.exit_policy != "assume":
            blocked = ~(F.col(f"_can_{h}") & px.isNotNull()) & ~gone
        if model.exit_policy == "delay":
            later = F.col(f"_later_{h}")
            moved = blocked & later.isNotNull()
            px, pos = F.when(moved, later["x"]).otherwise(px), F.when(moved, later["p"]).otherwise(pos)
            blocked = blocked & ~moved
        first |= {f"delisted_{h}": gone, f"_px_{h}": px, f"_blocked_{h}": blocked, f"exit_delayed_{h}": moved, f"exit_date_{h}": session(days, pos)}
        fwd = F.try_divide(F.col(f"_px_{h}"), F.col("entry_px")) - 1
        second |= {f"_fwd_{h}": fwd, f"tradable_{h}": F.col("entry_tradable") & fwd.isNotNull() & ~F.col(f"_blocked_{h}")}
        keep, fwd = F.col(f"tradable_{h}"), F.col(f"_fwd_{h}")
        third |= {
            f"forward_return_{h}": F.when(keep, fwd), f"overnight_gap_{h}": F.when(keep, F.col("overnight_gap")),
            f"total_return_{h}": F.when(keep, (1 + fwd) * (1 + F.col("overnight_gap")) - 1),
            f"exit_missing_{h}": F.col("entry_px").isNotNull() & raw.isNull(),
            f"exit_blocked_{h}": F.col(f"_blocked_{h}") & F.col("entry_tradable") & fwd.isNotNull(),
            f"delist_dropped_{h}": F.col(f"delisted_{h}") & F.col(f"_px_{h}").isNull(),
        }
    out = ["date", "asset", "entry_date", "entry_px", "overnight_gap", "entry_tradable", "entry_reason"]
    for h in horizons:
        out += [f"{x}_{h}" for x in ("forward_return", "overnight_gap", "total_return", "exit_date", "tradable", "delisted", "exit_missing", "exit_blocked", "exit_delayed", "delist_dropped")]
    return df.withColumns(first).withColumns(second).withColumns(third).select(*out)


def return_ledger(returns: DataFrame, horizons: list[int]) -> DataFrame:
    """horizon, reason, n: how many rows each reason concerns. Reasons overlap; dropped = total - tradable always holds."""
    asked, names = [], []
    for h in horizons:
        counts = {r: F.count_if(F.col("entry_reason") == r) for r in DROP_REASONS}
        counts |= {
            "no_entry_price": F.count_if(F.col("entry_px").isNull()), "no_exit_price": F.count_if(F.col(f"exit_missing_{h}")),
            "exit_delayed": F.count_if(F.col(f"exit_delayed_{h}")), "exit_not_sellable": F.count_if(F.col(f"exit_blocked_{h}")),
            "delist_filled": F.count_if(F.col(f"delisted_{h}") & F.col(f"tradable_{h}")), "delisted_dropped": F.count_if(F.col(f"delist_dropped_{h}")),
            "tradable": F.count_if(F.col(f"tradable_{h}")), "total": F.count("*"), "dropped": F.count_if(~F.col(f"tradable_{h}")),
        }
        for reason, n in counts.items():
            names.append((h, reason))
            asked.append(n.alias(f"_{len(names)}"))
    row = returns.agg(*asked)
    cells = F.array(*(F.struct(F.lit(h).alias("horizon"), F.lit(r).alias("reason"), F.col(f"_{i + 1}").alias("n")) for i, (h, r) in enumerate(names)))
    return row.select(F.explode(cells).alias("r")).select("r.*").where("n > 0 or reason in ('tradable', 'total', 'dropped')")
