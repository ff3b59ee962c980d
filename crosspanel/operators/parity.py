"""Agreement of two implementations, quantity by quantity."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ParityCheck:
    """One quantity: pairs compared, largest difference, rows on one side only."""

    name: str
    n: int
    max_diff: float
    unmatched: int


@dataclass
class ParityReport:
    """All quantities; an empty report is not agreement."""

    tol: float
    checks: list[ParityCheck] = field(default_factory=list)

    @property
    def ok(self) -> bool:
        """Every quantity compared something and stays within the tolerance."""
        return bool(self.checks) and all(c.n and not c.unmatched and c.max_diff <= self.tol for c in self.checks)


def compare(left: DataFrame, right: DataFrame, keys: list[str], value: str, name: str | None = None) -> ParityCheck:
    """Full outer join of two results on their keys."""
    a, b = left.select(*keys, F.col(value).alias("_a"), F.lit(1).alias("_l")), right.select(*keys, F.col(value).alias("_b"), F.lit(1).alias("_r"))
    gap = F.abs(F.col("_a") - F.col("_b"))
    one_sided = F.col("_l").isNull() | F.col("_r").isNull() | (F.col("_a").isNull() != F.col("_b").isNull())
    r = a.join(b, keys, "full_outer").agg(F.count(gap).alias("n"), F.max(gap).alias("gap"), F.count_if(one_sided).alias("lone")).first()
    return ParityCheck(name or value, r.n, r.gap or 0.0, r.lone)


def check_parity(pairs: dict[str, tuple[DataFrame, DataFrame, list[str], str]], tol: float = 1e-10) -> ParityReport:
    """Compare each named pair of (left, right, keys, value)."""
    return ParityReport(tol, [compare(*p, name=n) for n, p in pairs.items()])
