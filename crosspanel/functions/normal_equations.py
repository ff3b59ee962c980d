"""Least squares of any number of groups from sufficient statistics.

The cross products of a group's regressors are partial aggregates, so what is shuffled is one small matrix a task and
group and never a row; the normal equations are then solved by elimination in array expressions. A regressor that
those before it explain, up to `TOLERANCE` of its own variance, is told by its pivot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Share of a regressor's variance that must be left to it by those before it.
TOLERANCE = 1e-12


def finite(column: Column) -> Column:
    """Neither missing, nor NaN, nor infinite."""
    return F.coalesce(F.abs(column.cast("double")) < float("inf"), F.lit(False))


def moments(y: Column, xs: list[Column], constant: bool, weight: Column | None = None) -> Column:
    """Aggregate: rows n, the matrix of products of the regressors with y's as last column, and the means (0 without a constant).

    With a constant and no weights, products are of deviations from the means, which adds up without cancellation.
    """
    vs = [v.cast("double") for v in (*xs, y)]
    if weight is None and constant:
        cell = lambda a, b: F.covar_pop(a, b) * F.count(F.lit(1))
        means = [F.avg(v) for v in vs]
    else:
        w = F.lit(1.0) if weight is None else weight.cast("double")
        total = F.sum(w)
        means = [F.try_divide(F.sum(w * v), total) if constant else F.lit(0.0) for v in vs]
        mean_of = dict(zip(map(id, vs), means, strict=True))
        cell = lambda a, b: F.sum(w * a * b) - total * mean_of[id(a)] * mean_of[id(b)]
    rows = F.array(*(F.array(*(cell(a, b) for b in vs)) for a in vs[:-1]))
    return F.struct(F.count(F.lit(1)).alias("n"), rows.alias("products"), F.array(*means).alias("means"))


def solve(products: Column) -> Column:
    """Struct of the coefficients `b` and whether a regressor had to be left out (its coefficient is 0) as `singular`.

    `products` is symmetric but for its last column, so elimination needs no exchange of rows.
    """
    size = F.size(products)
    own = F.transform(products, lambda row, i: F.get(row, i))

    def step(state: Column, at: Column) -> Column:
        rows = state["rows"]
        pivot_row = F.get(rows, at)
        pivot = F.get(pivot_row, at)
        sound = (pivot > TOLERANCE * F.get(own, at)) & (F.get(own, at) > 0)
        inverse = F.when(sound, 1 / pivot).otherwise(0.0)
        cleared = F.transform(rows, lambda row, i: F.when(i == at, F.transform(row, lambda v: v * inverse)).otherwise(F.zip_with(row, pivot_row, lambda v, p: v - F.get(row, at) * inverse * p)))
        return F.struct(cleared.alias("rows"), (state["singular"] | ~F.coalesce(sound, F.lit(False))).alias("singular"))

    start = F.struct(products.alias("rows"), F.lit(False).alias("singular"))
    done = F.aggregate(F.sequence(F.lit(0), size - 1), start, step)
    return F.struct(F.transform(done["rows"], lambda row: F.get(row, F.size(row) - 1)).alias("b"), done["singular"].alias("singular"))


def fitted(df: DataFrame, keys: list[str], y: str, xs: list[str], constant: bool = True, weight: str | None = None) -> DataFrame:
    """keys, n, coefficients `b` in the order of `xs`, the constant `a` (0 without one) and `singular`, from rows where all is finite."""
    there = finite(F.col(y))
    for c in [*xs, *([weight] if weight else [])]:
        there = there & finite(F.col(c))
    found = df.where(there).groupBy(*keys).agg(moments(F.col(y), [F.col(x) for x in xs], constant, None if weight is None else F.col(weight)).alias("_m"))
    found = found.withColumn("_s", solve(F.col("_m.products")))
    explained = F.aggregate(F.zip_with(F.col("_s.b"), F.col("_m.means"), lambda b, m: F.coalesce(b, F.lit(0.0)) * m), F.lit(0.0), lambda total, v: total + v)
    constant_term = F.element_at("_m.means", -1) - explained if constant else F.lit(0.0)
    return found.select(*keys, F.col("_m.n").alias("n"), F.col("_s.b").alias("b"), constant_term.alias("a"), F.col("_s.singular").alias("singular"))
