"""Mixing sources to target weights: token weights raked to several marginals, then documents sampled by them.

Tokens are summed by cell (source, language, topic). Iterative proportional fitting scales the cells to the target
share of each value of each dimension in turn, until all hold together. No cell may get more tokens than it has: what a
value as a whole cannot supply goes to the other values of its dimension by their shares, and within a value, where
cells are exhausted, the free ones are scaled to its goal. So as many tokens are drawn as are asked for, unless all
that may be drawn are fewer. A document's probability is its cell's weight over its cell's tokens, and a hash of its id
decides: the same documents every time, on any number of machines.

Goals that no weights meet together, such as those of a source that is in one language only, leave a miss: the last
dimension's goals hold, and `marginals` tells every value's goal and what it gets. With `most_miss` a larger one is
refused with an error.

Every value of every dimension is raked for itself, however many there are. Up to `driver_cells` cells are raked on the
driver and broadcast to the documents; more stay a table, which is scaled by joins with its marginals, written once a
cycle over the last but one, and merged with the documents. Both ways take the same steps to the same weights.

Where a table has no topics, `text_topic` gives a stand-in: the largest of `n_topics` groups of words by hash.

Defined results. Null in a dimension: a value of its own, raked like others. Null or empty text: no tokens, probability
of its cell. Null doc_id: drawn by a hash of its text. Repeated rows: the same decision for each. Empty table: no rows. A target for a value that does not
occur: its share goes to the others. A target of 0: probability 0. Other columns of the input are not touched.
"""

from __future__ import annotations

import uuid
import zlib
from collections import Counter
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crosspanel.llm.common import shared_dir, stage, words_of

NONE = "(none)"

#: Marginals of so many values at most are broadcast to the cells.
SMALL = 10_000
#: A move, as a share of a cell, that is no more than what sums of doubles differ by.
_NOISE = 1e-12
#: Parts that the documents of a cell are dealt to where cells are merged with documents.
SALTS = 16


@dataclass(frozen=True)
class Settings:
    """Targets and bounds. A dimension's target is a share for each value, or its own shares to a power, normalised."""

    targets: dict[str, dict[str, float] | float] = field(default_factory=lambda: {"source": 0.5, "lang": 0.5, "topic": 0.0})
    #: Tokens to draw, as a share of all.
    keep_share: float = 0.4
    #: Cells that are raked on the driver; more are raked as a table.
    driver_cells: int = 100_000
    n_topics: int = 8
    seed: int = 17
    cycles: int = 500
    #: What a cell may still have to move when raking ends, as a share of its tokens drawn (of one token, where it has less).
    tolerance: float = 1e-9
    #: The largest miss of a value's goal, as a share of all tokens drawn, that is not refused; None: any is taken.
    most_miss: float | None = None


def text_topic(text: str | None, n_topics: int) -> tuple[int, str]:
    """Words of a text, and the word group with the most of its words of five bytes or more."""
    words = words_of(text or "")
    groups = Counter()
    for word, n in Counter(words).items():
        if len(word) >= 5:
            groups[zlib.crc32(word.lower()) % n_topics] += n
    best = min(groups, key=lambda g: (-groups[g], g)) if groups else 0
    return len(words), f"topic{best}"


def measured(text: Column, settings: Settings) -> Column:
    """struct(n_tokens, topic) of a text column."""
    n = settings.n_topics

    @F.pandas_udf("n_tokens long, topic string")
    def measure(texts: pd.Series) -> pd.DataFrame:
        found = [text_topic(t if isinstance(t, str) else None, n) for t in texts]
        return pd.DataFrame({"n_tokens": np.array([x[0] for x in found], np.int64), "topic": [x[1] for x in found]})

    return measure(text)


def capped_goals(share: np.ndarray, have: np.ndarray, total: float) -> np.ndarray:
    """`total` dealt by shares, no value over what it has: what one lacks goes to the others. Less if all have less."""
    share = share / share.sum() if share.sum() else np.full(len(share), 1 / max(len(share), 1))
    full = (share > 0) & (have <= 0)
    while True:
        free = (share > 0) & ~full
        scale = max(total - have[full].sum(), 0.0) / share[free].sum() if free.any() else 0.0
        over = free & (share * scale >= have)
        if not over.any():
            return np.where(full, have, share * scale)
        full |= over


def settled(moved: float, last: float | None, tolerance: float) -> bool:
    """Whether cells are within the tolerance of where raking leads: by the largest moves of this cycle and the last, as shares.

    A small move alone says little where each is nearly as large as the one before; what is left is a geometric sum.
    """
    return moved <= _NOISE or (last is not None and moved < last and moved * moved <= tolerance * (last - moved))


def rake(cells: pd.DataFrame, shares: dict[str, dict[str, float]], total: float, cycles: int = 500, tolerance: float = 1e-9) -> np.ndarray:
    """Tokens to draw from each cell: marginals as near the shares as the cells' tokens allow, `total` in all."""
    have = cells["tokens"].to_numpy(float)
    parts = []
    for name, target in shares.items():
        code, values = pd.factorize(cells[name])
        parts.append((code, np.array([target.get(v, 0.0) for v in values], float), np.bincount(code, have, len(values))))
    total = min([total, have.sum(), *(h[s > 0].sum() if s.sum() else h.sum() for _, s, h in parts)])
    goals = [(code, capped_goals(share, held, total)) for code, share, held in parts]
    weight = have * (total / have.sum() if have.sum() else 0.0)
    last = None
    for _ in range(cycles):
        before = weight.copy()
        for code, goal in goals:
            weight = _scaled(weight, have, code, goal)
        if weight.sum() <= 0:
            break
        moved = float((np.abs(weight - before) / np.maximum(before, 1.0)).max())
        if settled(moved, last, tolerance):
            break
        last = moved
    return weight


def _scaled(weight: np.ndarray, have: np.ndarray, code: np.ndarray, goal: np.ndarray) -> np.ndarray:
    """Weights with each value's sum at its goal: all scaled down, or those that are not exhausted scaled up, at most to what they have."""
    n = len(goal)
    full = weight >= have
    now, held = np.bincount(code, weight, n), np.bincount(code, np.where(full, weight, 0.0), n)
    down = goal <= now
    rest = np.where(down, now, now - held)
    factor = np.divide(np.where(down, goal, goal - held), rest, out=np.zeros(n), where=rest > 0)
    factor, down = factor[code], down[code]
    return np.minimum(np.where(full & ~down, weight, weight * factor), have)


def _shares(marginal: pd.DataFrame, target: dict[str, float] | float) -> dict[str, float]:
    if isinstance(target, dict):
        known = {str(k): float(v) for k, v in target.items()}
        return {v: known.get(v, 0.0) for v in marginal["value"]}
    tokens = marginal["tokens"].to_numpy(float)
    power = np.where(tokens > 0, np.maximum(tokens, 1.0) ** target, 0.0)
    return dict(zip(marginal["value"], power / power.sum() if power.sum() else power, strict=True))


def dimensions(docs: DataFrame, settings: Settings, *also: Column) -> DataFrame:
    """The dimensions and n_tokens of each document, with the columns `also`; a null is a value of its own."""
    rows = docs.select(*also, *(F.col(x).cast("string").alias(f"dim_{x}") for x in settings.targets if x in docs.columns), measured(F.col("text"), settings).alias("m"))
    if "topic" in settings.targets and "topic" not in docs.columns:
        rows = rows.withColumn("dim_topic", F.col("m.topic"))
    kept = [x for x in rows.columns if x != "m" and not x.startswith("dim_")]
    return rows.select(*kept, *(F.coalesce(F.col(f"dim_{x}"), F.lit(NONE)).alias(x) for x in settings.targets), F.col("m.n_tokens").alias("n_tokens"))


def mix(docs: DataFrame, settings: Settings | None = None) -> DataFrame:
    """doc_id, the dimensions, n_tokens, weight, probability and sampled of each document.

    `docs` holds doc_id, text and the dimensions, or all dimensions but topic. weight is what the tokens of the
    document's cell count for in the mix against what they count for as they are.
    """
    settings = settings or Settings()
    rows = stage(dimensions(docs, settings, F.col("doc_id"), place(settings).alias("place")), "dimensions")
    joined = with_plan(rows, draw_plan(rows, settings))
    return joined.select("doc_id", *settings.targets, "n_tokens", "weight", "probability", (F.col("place") < F.col("probability")).alias("sampled"))


def draw(docs: DataFrame, settings: Settings | None = None) -> DataFrame:
    """The documents that are sampled, with all their columns. Two passes over the texts, which are not shuffled."""
    settings = settings or Settings()
    plan = draw_plan(dimensions(docs, settings), settings)
    rows = with_plan(dimensions(docs, settings, F.struct(*(docs[c] for c in docs.columns)).alias("document"), place(settings).alias("place")), plan)
    return rows.where("place < probability").select("document.*")


def place(settings: Settings) -> Column:
    """A hash of a document's id, or of its text where it has none, spread evenly over 0 to 1: it is drawn if below its probability."""
    key = F.when(F.col("doc_id").isNotNull(), F.xxhash64("doc_id", F.lit(settings.seed))).otherwise(F.xxhash64("text", F.lit(settings.seed)))
    return F.pmod(key, F.lit(1 << 52)) / F.lit(float(1 << 52))


def _marginal(cells: DataFrame, name: str, target: dict[str, float] | float) -> DataFrame:
    """(value, have, share) of each value of a dimension; the same shares as `_shares` gives, but for their sum."""
    marginal = cells.groupBy(name).agg(F.sum("tokens").cast("double").alias("have"))
    if isinstance(target, dict):
        known = cells.sparkSession.createDataFrame(list({str(k): float(v) for k, v in target.items()}.items()), f"`{name}` string, share double")
        marginal = marginal.join(known, name, "left").select(name, "have", F.coalesce("share", F.lit(0.0)).alias("share"))
    else:
        marginal = marginal.select(name, "have", F.when(F.col("have") > 0, F.pow(F.greatest("have", F.lit(1.0)), F.lit(float(target)))).otherwise(0.0).alias("share"))
    marginal = stage(marginal, "marginal")
    if not (marginal.agg(F.sum("share")).first()[0] or 0.0):
        marginal = marginal.withColumn("share", F.lit(1.0))
    return marginal


def _goals(marginal: DataFrame, name: str, total: float) -> tuple[DataFrame, int]:
    """(value, goal) of each value of a dimension by `capped_goals`, and how many there are.

    A value is full once the scale of the shares reaches what it has for each of them; the scale only grows, so it is
    all that one round needs to know of those before.
    """
    share, have = F.col("share"), F.col("have")
    scale, n_full = 0.0, -1
    while True:
        full = (share > 0) & (have <= share * scale)
        n, count, held, rest = marginal.agg(F.count("*"), F.count_if(full), F.sum(F.when(full, have)), F.sum(F.when((share > 0) & ~full, share))).first()
        if count == n_full:
            break
        n_full, scale = count, (max(total - (held or 0.0), 0.0) / rest if rest else scale)
    return marginal.select(name, F.when(full, have).otherwise(share * scale).alias("goal")), n


def rake_table(cells: DataFrame, settings: Settings, total: float, all_tokens: float) -> DataFrame:
    """`rake` over a table of cells (the dimensions, tokens), which gets a column weight."""
    spark = cells.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/raked-{uuid.uuid4().hex}"
    marginals = {name: _marginal(cells, name, target) for name, target in settings.targets.items()}
    total = min([total, all_tokens, *(m.where("share > 0").agg(F.sum("have")).first()[0] or 0.0 for m in marginals.values())])
    goals = {name: _goals(m, name, total) for name, m in marginals.items()}
    kept = cells.select(*settings.targets, F.col("tokens").cast("double").alias("tokens"))
    now = kept.withColumn("weight", F.col("tokens") * (total / all_tokens if all_tokens else 0.0))
    full, last = F.col("weight") >= F.col("tokens"), None
    for cycle in range(settings.cycles):
        step = now.withColumn("before", F.col("weight"))
        for name, (goal, n) in goals.items():
            sums = step.groupBy(name).agg(F.sum("weight").alias("sum"), F.sum(F.when(full, F.col("weight")).otherwise(0.0)).alias("held")).join(goal, name)
            down = F.col("goal") <= F.col("sum")
            rest, need = F.when(down, F.col("sum")).otherwise(F.col("sum") - F.col("held")), F.when(down, F.col("goal")).otherwise(F.col("goal") - F.col("held"))
            factor = sums.select(name, down.alias("down"), F.when(rest > 0, need / rest).otherwise(0.0).alias("factor"))
            step = step.join(F.broadcast(factor) if n <= SMALL else factor.hint("merge"), name)
            moved = F.when(full & ~F.col("down"), F.col("weight")).otherwise(F.col("weight") * F.col("factor"))
            step = step.withColumn("weight", F.least(moved, F.col("tokens"))).drop("factor", "down")
        step.write.mode("overwrite").parquet(f"{path}-{cycle % 2}")
        now = spark.read.schema(step.schema).parquet(f"{path}-{cycle % 2}")
        moved, left = now.agg(F.max(F.abs(F.col("weight") - F.col("before")) / F.greatest("before", F.lit(1.0))), F.sum("weight")).first()
        now = now.drop("before")
        if (left or 0.0) <= 0 or settled(moved, last, settings.tolerance):
            break
        last = moved
    return now


def marginals(docs: DataFrame, settings: Settings | None = None) -> DataFrame:
    """dimension, value, tokens, goal, weight and miss of every value: the share of the draw it is to have, that it gets, and the difference.

    The goal is the target's share of what is drawn, before anything is known of what the values can supply.
    """
    settings = settings or Settings()
    rows = stage(dimensions(docs, settings), "dimensions")
    return _misses(with_cells(rows, settings, draw_plan(rows, settings)), settings)


def with_cells(rows: DataFrame, settings: Settings, plan: dict) -> DataFrame:
    """(the dimensions, tokens, drawn) of each cell."""
    cells = rows.groupBy(*settings.targets).agg(F.sum("n_tokens").alias("n_tokens"))
    found = with_plan(cells, plan)
    return found.select(*settings.targets, F.col("n_tokens").cast("double").alias("tokens"), (F.col("n_tokens") * F.col("probability")).alias("drawn"))


def _misses(cells: DataFrame, settings: Settings) -> DataFrame:
    out = []
    for name, target in settings.targets.items():
        wanted = _marginal(cells, name, target)
        whole = wanted.agg(F.sum("share").alias("whole"))
        got = cells.groupBy(name).agg(F.sum("tokens").cast("long").alias("tokens"), F.sum("drawn").alias("drawn"))
        every = cells.agg(F.sum("drawn").alias("all_drawn"))
        rows = got.join(wanted, name).join(F.broadcast(whole)).join(F.broadcast(every))  # one row each
        goal, weight = F.try_divide("share", "whole"), F.coalesce(F.try_divide("drawn", "all_drawn"), F.lit(0.0))
        out.append(rows.select(F.lit(name).alias("dimension"), F.col(name).alias("value"), "tokens", goal.alias("goal"), weight.alias("weight"), (weight - goal).alias("miss")))
    return reduce(DataFrame.unionByName, out)


def draw_plan(rows: DataFrame, settings: Settings) -> dict:
    """Each cell's weight and probability, from (dimensions, n_tokens): a pandas table, or a Spark table of many cells."""
    dims = list(settings.targets)
    cells = stage(rows.groupBy(*dims).agg(F.sum("n_tokens").alias("tokens")), "cells")
    n, total = cells.agg(F.count("*"), F.sum("tokens").cast("double")).first()
    total = total or 0.0
    if n > settings.driver_cells:
        raked = stage(rake_table(cells, settings, settings.keep_share * total, total), "raked")
        drawn = raked.agg(F.sum("weight")).first()[0]
        probability = F.when(F.col("tokens") > 0, F.col("weight") / F.col("tokens")).otherwise(settings.keep_share)
        raked = raked.select(*dims, (probability * (total / drawn if drawn else 0.0)).alias("weight"), probability.alias("probability"))
        return _checked({"dims": dims, "cells": raked}, cells, settings)
    table = cells.orderBy(*dims).toPandas()
    shares = {}
    for name in dims:
        marginal = table.groupby(name, as_index=False)["tokens"].sum().rename(columns={name: "value"})
        shares[name] = _shares(marginal, settings.targets[name])
    have = table["tokens"].to_numpy(float)
    weight = rake(table, shares, settings.keep_share * total, settings.cycles, settings.tolerance) if len(table) else have
    table["probability"] = np.divide(weight, have, out=np.full(len(have), settings.keep_share), where=have > 0)
    table["weight"] = table["probability"] * (total / weight.sum() if weight.sum() else 0.0)
    return _checked({"dims": dims, "cells": table}, cells, settings)


def _checked(plan: dict, cells: DataFrame, settings: Settings) -> dict:
    """The plan, unless some goal is missed by more than `most_miss`."""
    if settings.most_miss is not None:
        rows = _misses(with_cells(cells.withColumnRenamed("tokens", "n_tokens"), settings, plan), settings)
        worst = rows.agg(F.max_by(F.struct("dimension", "value", "goal", "weight", "miss"), F.abs("miss")).alias("w")).first().w
        if worst is not None and abs(worst.miss) > settings.most_miss:
            raise ValueError(f"{worst.dimension} {worst.value!r} gets {worst.weight:.4f} of the tokens and not {worst.goal:.4f}")
    return plan


def with_plan(rows: DataFrame, plan: dict) -> DataFrame:
    """Rows with the weight and probability of their cell: broadcast if at most `driver_cells`, else merged, large cells in parts."""
    dims, cells = plan["dims"], plan["cells"]
    if isinstance(cells, DataFrame):
        parts = cells.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salted = rows.withColumn("_salt", F.spark_partition_id() % SALTS)
        return salted.join(parts.hint("merge"), [*dims, "_salt"]).select(*rows.columns, "weight", "probability")
    if cells.empty:
        return rows.select("*", F.lit(0.0).alias("weight"), F.lit(0.0).alias("probability"))
    small = rows.sparkSession.createDataFrame(cells[[*dims, "weight", "probability"]])
    return rows.join(F.broadcast(small), dims).select(*rows.columns, "weight", "probability")
