"""Price adjustment factors from ex-rights events, as one window pipeline per asset."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crosspanel.operators.contracts import fail

EVENT_FIELDS = ("fenhong", "peigu", "peigujia", "songzhuangu")


def compute_adj_factor(prices: DataFrame, xdxr: DataFrame | None, method: str = "hfq", close: str = "raw_close") -> DataFrame:
    """date, asset, adj_factor for every price row.

    Events of category 1 between an asset's first and last session count. Of several on a day one counts whole: the last
    by the column `seq` where there is one, then the one with the greatest fields in the order of EVENT_FIELDS. A day with an
    event and no session carries the close before it. `hfq` keeps the first session at 1, `qfq` the last.
    """
    if method not in ("hfq", "qfq"):
        fail("adjust", "bad_method", f"{method!r} is neither hfq nor qfq")
    px = prices.select("date", "asset", F.col(close).cast("double").alias("close"), F.lit(True).alias("real"))
    if xdxr is None:
        return px.select("date", "asset", F.lit(1.0).alias("adj_factor"))
    event = F.struct(*(F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in EVENT_FIELDS))
    order = F.struct(F.col("seq"), event) if "seq" in xdxr.columns else event
    own = xdxr.where(F.col("category") == 1).groupBy("date", "asset").agg(F.max_by(event, order).alias("event_of_day")).select("date", "asset", "event_of_day.*")
    span = px.groupBy("asset").agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
    own = own.join(span, "asset").where(F.col("date").between(F.col("lo"), F.col("hi"))).drop("lo", "hi").withColumn("event", F.lit(1))
    w = Window.partitionBy("asset").orderBy("date")
    asset = Window.partitionBy("asset")
    rows = px.join(own, ["date", "asset"], "full_outer").withColumn("any_event", F.count("event").over(asset) > 0)
    filled = F.last("close", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("close", F.when(F.col("any_event"), filled).otherwise(F.col("close")))
    for c in EVENT_FIELDS:
        rows = rows.withColumn(c, F.coalesce(c, F.lit(0.0)))
    before = (F.lag("close").over(w) * 10 - F.col("fenhong") + F.col("peigu") * F.col("peigujia")) / (10 + F.col("peigu") + F.col("songzhuangu"))
    rows = rows.withColumn("preclose", before).withColumn("next_preclose", F.lead("preclose").over(w))
    if method == "hfq":
        step = F.try_divide(F.col("close"), F.col("next_preclose"))
        grown = F.product(F.coalesce(F.col("step"), F.lit(1.0))).over(w.rowsBetween(Window.unboundedPreceding, -1))
    else:
        step = F.coalesce(F.try_divide(F.col("next_preclose"), F.col("close")), F.lit(1.0))
        grown = F.product("step").over(asset.orderBy(F.desc("date")).rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("step", step).withColumn("adj_factor", F.coalesce(grown, F.lit(1.0)))
    return rows.where("real").select("date", "asset", "adj_factor")


def fill_prev_close(prices: DataFrame) -> DataFrame:
    """Add prev_close: the raw close of the asset's row before, unless the column is there."""
    if "prev_close" in prices.columns:
        return prices
    return prices.withColumn("prev_close", F.lag("raw_close").over(Window.partitionBy("asset").orderBy("date")))


def with_adjusted(prices: DataFrame) -> DataFrame:
    """Add adj_open, adj_high, adj_low and adj_close, raw times adj_factor."""
    kinds = [k for k in ("open", "high", "low", "close") if f"raw_{k}" in prices.columns]
    return prices.withColumns({f"adj_{k}": F.col(f"raw_{k}") * F.col("adj_factor") for k in kinds})
