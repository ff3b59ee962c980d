"""Counted ranks and what rests on them, against numpy on the whole groups."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from crosspanel.functions.order_statistics import at_rank, counted_ranks, lowest_mean, quantiles
from crosspanel.operators import preprocess, tail

SCHEMA = "g string, x double"


@pytest.fixture(scope="module")
def groups():
    """A hot group, one of ties, one of a single value, and one without a name."""
    rng = np.random.default_rng(7)
    return {"hot": rng.standard_t(2, 3000).tolist(), "ties": rng.integers(0, 4, 400).astype(float).tolist(), "one": [3.5], None: rng.normal(size=50).tolist()}


@pytest.fixture(scope="module")
def table(spark, groups):
    rows = [(g, x) for g, xs in groups.items() for x in xs] + [("hot", None), ("bare", None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.mark.parametrize("ranges", [1, 3, 128])
def test_ranks_are_those_of_the_whole_group(table, groups, ranges):
    got = {(r.g, r.x): (r._c, r._lo, r._n) for r in counted_ranks(table, "x", ["g"], ranges).collect()}
    want = {(g, v): (xs.count(v), sum(x < v for x in xs), len(xs)) for g, xs in groups.items() for v in set(xs)}
    assert got == want


def test_quantiles_equal_numpy(table, groups):
    got = {r.g: (r.low, r.mid, r.high) for r in quantiles(table, "x", ["g"], {"low": 0.05, "mid": 0.5, "high": 0.95}).collect()}
    assert set(got) == set(groups)
    for g, xs in groups.items():
        assert got[g] == pytest.approx(tuple(np.quantile(xs, [0.05, 0.5, 0.95])))
    whole = [x for xs in groups.values() for x in xs]
    assert quantiles(table, "x", [], {"mid": 0.5}).first().mid == pytest.approx(np.median(whole))


def test_smallest_values_and_their_mean(table, groups):
    for g, cut, mean in counted_ranks(table, "x", ["g"]).groupBy("g").agg(at_rank(F.col("x"), F.lit(0)), lowest_mean(F.col("x"), F.lit(30))).collect():
        low = sorted(groups[g])[:30]
        assert cut == low[0] and mean == pytest.approx(np.mean(low))


def test_tails_of_ties_and_of_nothing(spark, table, groups):
    got = {r.g: r for r in tail.crash_stats(table, "x", ["g"], 0.1).collect()}
    ties = groups["ties"]
    cut = sorted(ties)[int(np.ceil(0.1 * len(ties))) - 1]
    assert got["ties"].cut == cut and got["ties"].hits == sum(x <= cut for x in ties)
    empty = spark.createDataFrame([], SCHEMA)
    assert tail.crash_stats(empty, "x", ["g"]).count() == 0
    none = tail.crash_stats(empty, "x").first()
    assert none.n == 0 and none.hits == 0 and none.cut is None and none.cvar is None
    assert tail.tail_risk(empty, "x").first().value_at_risk is None
    fixed = tail.crash_stats(table.where("g = 'ties'"), "x", threshold=1.0).first()
    assert fixed.hits == sum(x <= 1 for x in ties) and fixed.mean_crash == pytest.approx(np.mean([x for x in ties if x <= 1]))


@pytest.mark.parametrize("method", ["mad", "sigma", "quantile"])
def test_pooled_winsorizing(table, groups, method):
    xs = np.array([x for v in groups.values() for x in v])
    mid, half = (np.median(xs), 3 * 1.4826 * np.median(np.abs(xs - np.median(xs)))) if method == "mad" else (xs.mean(), 3 * xs.std(ddof=1))
    low, high = np.quantile(xs, [0.01, 0.99]) if method == "quantile" else (mid - half, mid + half)
    out = preprocess.winsorize(table, "x", method, by_date=False)
    assert out.columns == ["g", "x"] and out.where("x IS NULL").count() == 2
    assert sorted(r.x for r in out.where("x IS NOT NULL").collect()) == pytest.approx(sorted(np.clip(xs, low, high)))


def test_pooled_standardizing(spark, table, groups):
    xs = np.array([x for v in groups.values() for x in v])
    score = [r.x for r in preprocess.standardize(table, "x", by_date=False).where("x IS NOT NULL").collect()]
    assert sorted(score) == pytest.approx(sorted((xs - xs.mean()) / xs.std(ddof=1)))
    rank = preprocess.standardize(table, "x", "rank", by_date=False)
    want = [((xs < x).sum() + (xs == x).sum() / 2) / len(xs) for x in xs]
    assert sorted(r.x for r in rank.where("x IS NOT NULL").collect()) == pytest.approx(sorted(want)) and rank.count() == table.count()
    flat = spark.createDataFrame([("a", 2.0), ("b", 2.0), ("c", None)], SCHEMA)
    assert [r.x for r in preprocess.standardize(flat, "x", by_date=False).orderBy("g").collect()] == [2.0, 2.0, None]
    assert [r.x for r in preprocess.standardize(flat, "x", "demean", by_date=False).orderBy("g").collect()] == [0.0, 0.0, None]
    empty = spark.createDataFrame([], SCHEMA)
    assert all(preprocess.winsorize(empty, "x", m, by_date=False).count() == 0 for m in ("mad", "sigma", "quantile"))
