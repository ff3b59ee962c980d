"""Redraws of a panel's rows: how a statistic holds when the sample is drawn anew.

Each row's weight in each draw comes from a hash of the row's key and the number of the draw, so a draw is the same from
run to run, however rows are partitioned, and any engine can repeat it. All draws are one aggregation: rows are multiplied
where they lie and added up by draw before anything is shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crosspanel.operators.contracts import fail

#: Chances of at most 0, 1, 2, ... copies of a row, one expected; beyond these a row is drawn no more often.
POISSON = [sum(math.exp(-1) / math.factorial(i) for i in range(k + 1)) for k in range(9)]


def uniform(keys: list[str], draw: Column, seed: int = 0) -> Column:
    """A number in [0, 1) for a row and a draw: 48 bits of the MD5 of the key's text."""
    parts = F.concat_ws("|", F.lit(str(seed)), draw.cast("string"), *(F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys))
    return F.conv(F.substring(F.md5(parts.cast("binary")), 1, 12), 16, 10).cast("double") / float(2**48)


def drawn(df: DataFrame, keys: list[str], n_draws: int, mode: str = "bootstrap", frac: float = 0.8, seed: int = 0) -> DataFrame:
    """Rows with `draw` 0 .. n_draws - 1 and `weight`, how often the row is in it (rows that are not are left out).

    bootstrap: Poisson with mean 1, which is a bootstrap whose size varies by its square root. subsample: each row with
    chance `frac`.
    """
    if mode not in ("subsample", "bootstrap"):
        fail("robustness", "bad_mode", f"{mode!r} is neither subsample nor bootstrap")
    if not 0 < frac <= 1:
        fail("robustness", "bad_frac", f"{frac} is not in (0, 1]")
    rows = df.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(n_draws - 1)))).withColumn("_u", uniform(keys, F.col("draw"), seed))
    weight = (F.col("_u") < frac).cast("int") if mode == "subsample" else sum((F.col("_u") >= c).cast("int") for c in POISSON)
    return rows.withColumn("weight", weight).where("weight > 0").drop("_u")


def perturb_panel(
    df: DataFrame, value: str, keys: list[str], by: list[str] | None = None, *, n_draws: int = 200, mode: str = "bootstrap", frac: float = 0.8, seed: int = 0,
    tol: float = 0.5, agg: Callable[[pd.Series], float] | None = None,
) -> DataFrame:
    """by, n, base, mean, p5, p95, same_sign, within_tol of a statistic of `value` over redraws; `keys` tell rows apart.

    The statistic is the mean, or what `agg` makes of a series. A mean is added up in parts; `agg` sees a draw of a
    group whole, so it is for series of a row a period. Missing values don't count; a group without any has no row.
    """
    by = by or []
    rows = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(*dict.fromkeys([*by, *keys]), F.col(value).cast("double").alias("_x"))
    redrawn = drawn(rows, keys, n_draws, mode, frac, seed)
    if agg is None:
        base = rows.groupBy(*by).agg(F.count("_x").alias("n"), F.avg("_x").alias("base"))
        found = redrawn.groupBy(*by, "draw").agg((F.sum(F.col("_x") * F.col("weight")) / F.sum("weight")).alias("_v"))
    else:

        @F.pandas_udf("double")
        def of_series(x: pd.Series) -> float:
            return float(agg(x))

        base = _met(rows.groupBy(*by).agg(F.count("_x").alias("n")), rows.groupBy(*by).agg(of_series("_x").alias("base")), by)
        repeated = redrawn.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("weight"))))
        found = repeated.groupBy(*by, "draw").agg(of_series("_x").alias("_v"))
    met = _met(found, base, by)
    same = (F.signum("_v") == F.signum("base")) & (F.col("base") != 0)
    near = same & (F.abs(F.col("_v") - F.col("base")) <= tol * F.abs("base"))
    return met.groupBy(*by, "n", "base").agg(
        F.avg("_v").alias("mean"), F.percentile("_v", F.lit(0.05)).alias("p5"), F.percentile("_v", F.lit(0.95)).alias("p95"),
        F.avg(same.cast("double")).alias("same_sign"), F.avg(near.cast("double")).alias("within_tol"),
    )


def _met(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    """Join on the groups; without groups the right side is one row."""
    return left.join(right, by) if by else left.join(F.broadcast(right))
