"""The sample that analysis works on, with every dropped row accounted for by its first reason."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crosspanel.functions.xsec import horizons_of
from crosspanel.operators.contracts import KEYS, fail
from crosspanel.operators.returns import DROP_REASONS

#: Reasons in the order in which they apply, and what they mean.
MEANING = {
    "duplicate": "a key that occurred before", "no_factor": "no factor value", "limit_up": "opened at the upper limit",
    "limit_down": "opened at the lower limit", "suspended": "suspended at entry", "new_stock": "listed too recently",
    "not_tradable": "entry not possible", "no_return": "no forward return for some horizon", "not_in_universe": "outside the universe",
    "no_group": "no group", "no_exposure": "no exposure", "retained": "in the sample",
}


@dataclass
class CleanResult:
    """The sample, and all input rows with their drop_reason (NULL: kept)."""

    data: DataFrame
    rows: DataFrame
    horizons: list[int]

    def ledger(self) -> DataFrame:
        """reason, count, pct, meaning, sample (the first three keys) for each reason that occurred, and what remains."""
        key = F.concat_ws(" ", F.col("date").cast("string"), "asset")
        reason = F.coalesce("drop_reason", F.lit("retained"))
        n = self.rows.groupBy(reason.alias("reason")).agg(F.count("*").alias("count"))
        rank = F.row_number().over(Window.partitionBy(reason).orderBy("date", "asset"))
        first = self.rows.withColumn("_n", rank).where("_n <= 3").groupBy(reason.alias("reason")).agg(F.concat_ws("; ", F.sort_array(F.collect_list(key))).alias("sample"))
        total = F.sum("count").over(Window.partitionBy(F.lit(0)))  # a dozen rows
        meaning = F.create_map(*(F.lit(x) for pair in MEANING.items() for x in pair))
        order = F.create_map(*(F.lit(x) for i, r in enumerate(MEANING) for x in (r, i)))
        out = n.join(F.broadcast(first), "reason").withColumn("pct", F.col("count") / total).withColumn("meaning", meaning[F.col("reason")])
        return out.orderBy(order[F.col("reason")]).select("reason", "count", "pct", "meaning", "sample")

    def check(self) -> None:
        """Refuse unless what came in equals what is kept plus what was dropped."""
        kept, (n, dropped) = self.data.count(), self.rows.agg(F.count("*"), F.count("drop_reason")).first()
        if n != kept + dropped:
            fail("clean", "ledger_unbalanced", f"{n} rows came in, {kept} are kept and {dropped} dropped")


def clean(
    factor: DataFrame, returns: DataFrame, *, universe: DataFrame | None = None, exposures: DataFrame | None = None,
    groupby: DataFrame | None = None, horizons: list[int] | None = None,
) -> CleanResult:
    """Join the factor (date, asset, factor) with returns and give each row its first reason to be dropped.

    Of rows that repeat a key the one with the least factor stays.
    """
    horizons = horizons_of(returns, horizons)
    if not horizons:
        fail("clean", "no_horizons", "no forward_return_ column among the returns")
    name = next((c for c in ("factor", "value") if c in factor.columns), None)
    if name is None:
        fail("clean", "ambiguous_factor", f"no factor among {factor.columns}")
    f = factor.select(*KEYS, F.col(name).alias("factor")).withColumn("_again", F.row_number().over(Window.partitionBy(*KEYS).orderBy(F.col(name).asc_nulls_last())) > 1)
    carried = [f"{k}_{h}" for k in ("forward_return", "overnight_gap", "total_return") for h in horizons if f"{k}_{h}" in returns.columns]
    has_reason = "entry_reason" in returns.columns
    base = f.join(returns.select(*KEYS, *carried, *(["entry_reason"] if has_reason else [])), KEYS, "left")
    out = ["factor", *carried]
    tests = [("duplicate", F.col("_again")), ("no_factor", F.col("factor").isNull() | F.isnan("factor"))]
    if has_reason:
        tests += [(r, F.col("entry_reason") == r) for r in DROP_REASONS]
    missing = F.lit(False)
    for h in horizons:
        missing = missing | F.col(f"forward_return_{h}").isNull()
    tests.append(("no_return", missing))
    if universe is not None:
        base = base.join(universe.select(*KEYS, F.col("in_universe").alias("_in")), KEYS, "left")
        tests.append(("not_in_universe", ~F.coalesce("_in", F.lit(False))))
    for table, reason, mark in ((groupby, "no_group", "_g"), (exposures, "no_exposure", "_e")):
        if table is None:
            continue
        cols = [c for c in table.columns if c not in KEYS]
        base = base.join(table.select(*KEYS, *cols, F.lit(True).alias(mark)), KEYS, "left")
        gap = F.col(mark).isNull()
        for c in cols if mark == "_e" else cols[:1]:
            gap = gap | F.col(c).isNull()
        tests.append((reason, gap))
        out += [c for c in cols if c not in out]
    chain = F.when(tests[0][1], tests[0][0])
    for reason, test in tests[1:]:
        chain = chain.when(F.coalesce(test, F.lit(False)), reason)
    rows = base.withColumn("drop_reason", chain)
    return CleanResult(rows.where("drop_reason is null").select(*KEYS, *out), rows.select(*KEYS, *out, "drop_reason"), horizons)
