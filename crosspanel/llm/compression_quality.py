"""Quality classifier by compression: how much better a text packs with a dictionary of good text than with one of bad.

Two zstandard dictionaries are trained, on labelled good and on labelled bad text. A text is cut into blocks (all of
it, whatever its length), each block is packed with either dictionary, and the normalised size difference
(bad - good) / (bad + good) of the text and of its worst block, with the share of blocks that side with bad and the
two packed sizes per byte, becomes a probability by a logistic curve fitted on further labelled rows.

Fitting takes a bounded sample: of each label the `n_dictionary` + `n_calibration` / 2 rows that come first by a hash of
their id, shared between dictionaries and curve in that proportion however many there are, so that the curve never sees
what a dictionary was made of. Of a dictionary row at most `excerpt_blocks` blocks, spread over the text, come to the
driver; of a calibration row, which is packed whole where it lies, only the features do. Scoring takes every row, in one
pass without a shuffle; the model (two dictionaries of at most `dictionary_bytes` and a few weights) goes with the task.

Defined results. Null text: scored as empty. Empty text: the calibrated score of an empty text. Labels null or other
than 0 and 1, and labels of an id that has both: not learned from. Several texts of one id: one is learned from. A label missing altogether: all scores are the share of good rows, 0.5 without any
rows. Repeated rows: one result a row. Empty table: no rows. Other columns of the input are not touched.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crosspanel.llm.common import remainder, stage


@dataclass(frozen=True)
class Settings:
    """Bounds of the fitting sample, and how texts are packed."""

    n_dictionary: int = 1200
    n_calibration: int = 3000
    dictionary_bytes: tuple[int, ...] = (112_640, 32_768)
    block: int = 512
    excerpt_blocks: int = 64
    level: int = 1
    threshold: float = 0.7


def _blocks(text: bytes, size: int) -> list[bytes]:
    return [text[i : i + size] for i in range(0, max(len(text), 1), size)]


class Packer:
    """The two compressors and what they say of a text."""

    def __init__(self, good: bytes, bad: bytes, settings: Settings) -> None:
        self.settings = settings
        self.good, self.bad = (
            zstandard.ZstdCompressor(
                level=settings.level, dict_data=zstandard.ZstdCompressionDict(x), write_content_size=False, write_checksum=False, write_dict_id=False
            )
            for x in (good, bad)
        )

    def features(self, text: str | None) -> list[float]:
        blocks = _blocks((text or "").encode("utf-8", "surrogatepass"), self.settings.block)
        good, bad = (np.array([len(p.compress(x)) for x in blocks], float) for p in (self.good, self.bad))
        size = np.array([len(x) + 1.0 for x in blocks])
        worse = (bad - good) / (bad + good)
        g, b, n = good.sum(), bad.sum(), size.sum()
        return [(b - g) / (b + g), worse.min(), size[worse < 0].sum() / n, min(g / n, 2.0), min(b / n, 2.0)]


def _terms(x: np.ndarray) -> np.ndarray:
    """Features, their squares and products, and a constant."""
    n = x.shape[1]
    return np.column_stack([np.ones(len(x)), x, *(x[:, i] * x[:, j] for i in range(n) for j in range(i, n))])


@dataclass
class Model:
    """Dictionaries, scaling and weights; without dictionaries, a constant."""

    settings: Settings
    good: bytes = b""
    bad: bytes = b""
    centre: np.ndarray | None = None
    spread: np.ndarray | None = None
    weights: np.ndarray | None = None
    constant: float = 0.5
    #: What the log odds of all labelled rows are above those of the sample.
    shift: float = 0.0

    def scores(self, texts) -> np.ndarray:
        """Probability that each text is good."""
        if self.weights is None:
            return np.full(len(texts), self.constant)
        packer = Packer(self.good, self.bad, self.settings)
        x = np.array([packer.features(t) for t in texts]).reshape(-1, len(self.centre))
        return self._curve((x - self.centre) / self.spread, self.shift)

    def _curve(self, z: np.ndarray, shift: float = 0.0) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(_terms(np.clip(z, -6, 6)) @ self.weights + shift, -30, 30)))

    def calibrate(self, x: np.ndarray, labels: np.ndarray, half: np.ndarray, penalty: float = 0.01, rounds: int = 60) -> float:
        """Fit the curve to features by Newton steps on one half of the rows, give its log loss on the other, then fit on all."""
        self.centre, self.spread = x.mean(0), x.std(0) + 1e-9
        z = _terms(np.clip((x - self.centre) / self.spread, -6, 6))
        loss = 0.0
        for rows in (half, np.ones(len(x), bool)):
            a, y, w = z[rows], labels[rows], np.zeros(z.shape[1])
            for _ in range(rounds):
                p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
                s = p * (1 - p) + 1e-6
                step = np.linalg.solve((a * s[:, None]).T @ a + penalty * np.eye(len(w)), a.T @ (y - p) - penalty * w)
                w = w + step * min(1.0, 5.0 / (np.abs(step).max() + 1e-9))
            self.weights = w
            if rows is half:
                p = np.clip(self._curve(((x - self.centre) / self.spread)[~half]), 1e-6, 1 - 1e-6)
                loss = float(-np.mean(np.where(labels[~half] == 1, np.log(p), np.log(1 - p)))) if (~half).any() else 0.0
        return loss


def excerpt(text: str, settings: Settings) -> bytes:
    """At most `excerpt_blocks` blocks of a text, spread evenly over it."""
    blocks = _blocks(text.encode("utf-8", "surrogatepass"), settings.block)
    n = min(len(blocks), settings.excerpt_blocks)
    return b"".join(blocks[i * len(blocks) // n] for i in range(n))


def _dictionary(texts: list[bytes], size: int, block: int) -> bytes:
    samples = [x for t in texts for x in _blocks(t, block)]
    order = np.random.default_rng(7).permutation(len(samples))
    samples = [samples[i] for i in order]
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:  # too little text to train on: its own bytes serve
        return b"".join(samples)[:size] or b"\x00" * 8


def fit(docs: DataFrame, labels: DataFrame, settings: Settings | None = None, modulus: int = 4, held_out: int = 2) -> Model:
    """A model from documents (doc_id, text) and labels (doc_id, quality) outside the held-out split.

    Ids are chosen among the labels alone, so only the chosen documents' texts move.
    """
    settings = settings or Settings()
    rows = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & (remainder(F.col("doc_id"), modulus) != held_out))
    rows = rows.groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"), F.max("quality").alias("most")).where("quality = most").drop("most")
    bound = settings.n_dictionary + settings.n_calibration // 2
    by = F.xxhash64("doc_id")
    ids = [rows.where(F.col("quality") == y).orderBy(by, "doc_id").limit(bound) for y in (1, 0)]
    text = F.col("text").cast("string")
    chosen = docs.select("doc_id", text.alias("text")).where(F.col("text").isNotNull()).join(F.broadcast(ids[0].unionByName(ids[1])), "doc_id")
    # an id may stand in several rows: one of them, chosen where they lie
    chosen = chosen.groupBy("doc_id", "quality").agg(F.min(F.struct(F.xxhash64("text"), "text")).getField("text").alias("text"))
    ranked = chosen.withColumn("rank", F.row_number().over(Window.partitionBy("quality").orderBy(by, "doc_id")))
    sample = stage(ranked, "labelled")
    have = {r["quality"]: r["count"] for r in sample.groupBy("quality").count().collect()}
    model = Model(settings)
    n_good, n_bad = have.get(1, 0), have.get(0, 0)
    if not n_good or not n_bad:
        model.constant = n_good / (n_good + n_bad) if n_good + n_bad else 0.5
        return model
    share = settings.n_dictionary / bound
    # a single row of a label serves both
    learns = F.col("rank") <= F.when(F.col("quality") == 1, max(1, int(n_good * share))).otherwise(max(1, int(n_bad * share)))
    fits = ~learns | (F.lit(n_good < 2) & (F.col("quality") == 1)) | (F.lit(n_bad < 2) & (F.col("quality") == 0))
    cut = F.pandas_udf(lambda texts: pd.Series([excerpt(x, settings) for x in texts]), "binary")
    found = sample.where(learns).select("quality", "rank", cut("text").alias("text")).orderBy("quality", "rank").toPandas()
    learn = [[bytes(x) for x in found[found["quality"] == y]["text"]] for y in (1, 0)]
    tried = [Model(settings, *(_dictionary(x, size, settings.block) for x in learn)) for size in settings.dictionary_bytes]

    @F.pandas_udf("array<array<double>>")
    def features(texts: pd.Series) -> pd.Series:
        packers = [Packer(m.good, m.bad, settings) for m in tried]
        return pd.Series([[p.features(x) for p in packers] for x in texts])

    rest = sample.where(fits).select("quality", "rank", features("text").alias("features")).orderBy("quality", "rank").toPandas()
    y = np.append(rest["quality"].to_numpy(float), 0.0)
    half = np.append(rest.groupby("quality").cumcount().to_numpy() % 2 == 0, True)
    best = None
    for i, one in enumerate(tried):
        x = np.array([*([list(r[i]) for r in rest["features"]]), Packer(one.good, one.bad, settings).features("")])
        loss = one.calibrate(x, y, half)
        if best is None or loss < best[0]:
            best = (loss, one)
    share = {r["quality"]: r["count"] for r in rows.groupBy("quality").count().collect()}
    best[1].shift = float(np.log(share[1] / share[0]) - np.log((rest["quality"] == 1).sum() / (rest["quality"] == 0).sum()))
    return best[1]


def score_column(model: Model, text: Column) -> Column:
    """The score of a text column."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(model.scores(list(texts)), dtype="float64")

    return score(text)


def classify(docs: DataFrame, model: Model, modulus: int = 4, held_out: int = 2) -> DataFrame:
    """doc_id, held_out, score and predicted of each document (doc_id, text)."""
    scored = docs.select("doc_id", (remainder(F.col("doc_id"), modulus) == held_out).alias("held_out"), score_column(model, F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= model.settings.threshold).cast("int"))
