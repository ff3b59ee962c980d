"""Cross-sectional regressions and their averages over time."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crosspanel.functions.normal_equations import fitted
from crosspanel.operators.inference import nw_summary


def cross_sectional_regression(panel: DataFrame, y: str, xs: list[str], add_constant: bool = True, min_obs: int = 10, weights: str | None = None) -> DataFrame:
    """date, regressor, coef, n: least squares section by section, from the sections' cross products.

    NULL where a section has too few complete rows, or regressors of which one is a combination of the others.
    """
    names = [*(["const"] if add_constant else []), *xs]
    found = fitted(panel, ["date"], y, xs, add_constant, weights)
    usable = (F.col("n") >= max(min_obs, len(names))) & ~F.col("singular")
    values = [*([F.col("a")] if add_constant else []), *(F.get("b", F.lit(i)) for i in range(len(xs)))]
    cells = F.array(*(F.struct(F.lit(name).alias("regressor"), F.when(usable, v).alias("coef")) for name, v in zip(names, values, strict=True)))
    return found.select("date", "n", F.explode(cells).alias("c")).select("date", "c.regressor", "c.coef", "n")


def fama_macbeth(panel: DataFrame, y: str, xs: list[str], add_constant: bool = True, min_obs: int = 10, lags: int | None = None, horizon: int = 1, weights: str | None = None) -> DataFrame:
    """regressor, n, mean, std, t_naive, t_nw, n_eff, lags, vif of the sections' coefficients."""
    coefs = cross_sectional_regression(panel, y, xs, add_constant, min_obs, weights)
    return nw_summary(coefs, ["regressor"], "coef", lags=lags, horizon=horizon)


def shanken_inflation(mean_coef: np.ndarray, factor_cov: np.ndarray) -> float:
    """1 + lambda' S^-1 lambda; NaN if S can't be inverted."""
    lam, cov = np.atleast_1d(np.asarray(mean_coef, float)), np.atleast_2d(np.asarray(factor_cov, float))
    try:
        value = 1 + float(lam @ np.linalg.solve(cov, lam))
    except np.linalg.LinAlgError:
        return float("nan")
    return value if np.isfinite(value) else float("nan")
