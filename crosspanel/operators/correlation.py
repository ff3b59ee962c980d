"""Correlation between factors, section by section and never pooled, and redundancy of a candidate."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crosspanel.functions.xsec import average_rank, both, correlation
from crosspanel.operators.contracts import KEYS, fail
from crosspanel.operators.group import series_stats


#: Fixed value: common assets below which a section has no correlation.
LEAST_ASSETS = 3


def join_factors(factors: dict[str, DataFrame]) -> DataFrame:
    """date, asset and a column for each factor (date, asset, factor)."""
    return reduce(lambda a, b: a.join(b, KEYS, "full_outer"), [f.select(*KEYS, F.col("factor").alias(n)) for n, f in factors.items()])


def correlation_by_date(panel: DataFrame, names: list[str], method: str = "spearman", pairs: list[tuple[str, str]] | None = None) -> DataFrame:
    """date, factor_a, factor_b, rho, n over the assets that have both; all pairs from one shuffle by date."""
    pairs = pairs or list(combinations(names, 2))
    df, asked = panel, []
    for i, (a, b) in enumerate(pairs):
        x, y = both(F.col(a), F.col(b))
        df = df.withColumns({f"_x{i}": x, f"_y{i}": y})
        if method == "spearman":
            df = average_rank(average_rank(df, f"_x{i}", ["date"], f"_rx{i}"), f"_y{i}", ["date"], f"_ry{i}")
            x, y = F.col(f"_rx{i}"), F.col(f"_ry{i}")
        else:
            x, y = F.col(f"_x{i}"), F.col(f"_y{i}")
        asked += [correlation(x, y).alias(f"_r{i}"), F.count(x).alias(f"_n{i}")]
    wide = df.groupBy("date").agg(*asked)
    cells = [F.struct(F.lit(a).alias("factor_a"), F.lit(b).alias("factor_b"), F.col(f"_r{i}").alias("rho"), F.col(f"_n{i}").alias("n")) for i, (a, b) in enumerate(pairs)]
    return wide.select("date", F.explode(F.array(*cells)).alias("p")).select("date", "p.*")


def factor_correlation(factors: dict[str, DataFrame], method: str = "spearman", min_overlap: int = 20) -> DataFrame:
    """factor_a, factor_b, statistics of the periods' correlations, n_overlap, comparable, reason.

    A period counts with three common assets or more: n_overlap is how many such periods there are, n_periods in how many
    a correlation exists. A pair with fewer than `min_overlap` periods keeps its statistics, but isn't comparable.
    """
    if min_overlap < 1:
        fail("correlation", "bad_min_overlap", "one period at least")
    if len(factors) < 2:
        fail("correlation", "too_few", "two factors at least")
    by_date = correlation_by_date(join_factors(factors), list(factors), method)
    return _summary(by_date, min_overlap)


def _summary(by_date: DataFrame, min_overlap: int) -> DataFrame:
    pair = ["factor_a", "factor_b"]
    usable = by_date.withColumn("rho", F.when(F.col("n") >= LEAST_ASSETS, F.col("rho")))
    overlap = by_date.groupBy(*pair).agg(F.count_if(F.col("n") >= LEAST_ASSETS).alias("n_overlap"))
    out = series_stats(usable, pair, "rho").join(overlap, pair).withColumn("comparable", F.col("n_periods") >= min_overlap)
    return out.withColumn("reason", F.when(~F.col("comparable"), "insufficient_overlap")).orderBy(F.desc_nulls_last(F.abs("mean")), *pair)


def correlation_matrix(summary: DataFrame, names: list[str], value: str = "mean") -> DataFrame:
    """The symmetric matrix, ones on its diagonal; null for pairs that aren't comparable."""
    shown = F.when(F.col("comparable"), F.col(value)).alias(value)
    cells = summary.select(F.col("factor_a").alias("factor"), F.col("factor_b").alias("other"), shown)
    turned = cells.select(F.col("other").alias("factor"), F.col("factor").alias("other"), value)
    own = summary.sparkSession.createDataFrame([(n, n, 1.0) for n in names], f"factor string, other string, {value} double")
    return cells.unionByName(turned).unionByName(own).groupBy("factor").pivot("other", names).agg(F.first(value))


def redundancy_check(candidate: DataFrame, library: dict[str, DataFrame], threshold: float = 0.7, method: str = "spearman", min_overlap: int = 20, name: str = "candidate", top: int = 5) -> DataFrame:
    """The library factors nearest to a candidate: factor, mean, n_periods, n_overlap, redundant; at most `top` of them.

    Pairs that aren't comparable take no part: no row at all means that nothing can be said, not that nothing is redundant.
    """
    if not library:
        fail("correlation", "empty_library", "nothing to compare with")
    if name in library:
        fail("correlation", "name_clash", f"{name!r} is in the library")
    panel = join_factors({name: candidate, **library})
    found = _summary(correlation_by_date(panel, [], method, [(name, n) for n in library]), min_overlap)
    out = found.where("comparable").select(F.col("factor_b").alias("factor"), "mean", "n_periods", "n_overlap", (F.abs("mean") >= threshold).alias("redundant"))
    return out.orderBy(F.desc_nulls_last(F.abs("mean")), "factor").limit(top)
