"""Periodic run detection: every maximal repetition of words, by the runs theorem.

Each run holds, at the start of some period of it, a longest Lyndon word under the order of the words or under that
order turned round. So the two Lyndon words that start at each word are all there is to look at:

1. Words become numbers, and a suffix array over them is built by doubling; its inverse ranks all suffixes.
2. The longest Lyndon word at i ends before the next smaller rank; under the order turned round, before the next
   greater one.
3. Each such word that could be the root of a run is extended to both sides by longest common extensions: the LCP array
   of the suffixes, and of the text read backwards, each under a sparse table of range minima.

Documents go through in batches of some hundred thousand words; a longer one is a batch of its own. One pass, no
shuffle; memory follows the batch, the sparse tables only the documents in which a root has a repeat beside it.

Defined results. Null or empty text: no words, no runs, an empty collapsed text. Null doc_id: kept. Repeated rows: one
result each. Empty table: no rows. Very long texts are taken whole. Other columns of the input are not touched.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crosspanel.llm.common import words_of

SCHEMA = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
#: Words compared beyond the first on each side of a root before it is extended.
PROBES = 4
_RUN = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


@dataclass(frozen=True)
class RunRule:
    """Which repetitions count: at least `least_words` long, and `least_periods` (2 or more) times their period."""

    least_words: int = 6
    least_periods: int = 4
    #: Words of a batch.
    batch_words: int = 50_000


def suffix_ranks(symbols: np.ndarray, text: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """The inverse suffix array of several texts in a row: texts in turn, within each its suffixes in order.

    `text` numbers the texts upwards, `stop` is the end of each position's text; a suffix that ends is the smaller.
    Each doubling sorts again only what is not told apart yet.
    """
    n = len(symbols)
    key = text.astype(np.int64) << 32 | symbols
    order = np.argsort(key, kind="stable")
    rank = np.empty(n, np.int64)
    place, key = np.arange(n), key[order]
    first = np.ones(n, bool)
    first[1:] = key[1:] != key[:-1]
    rank[order] = np.maximum.accumulate(np.where(first, place, 0))
    alone = first & np.append(first[1:], True)
    open_, width = order[~alone], 1
    while len(open_):
        ahead = open_ + width
        inside = ahead < stop[open_]
        second = np.zeros(len(open_), np.int64)
        second[inside] = rank[ahead[inside]] + 1
        key = rank[open_] << 32 | second
        by = np.argsort(key, kind="stable")
        open_, key = open_[by], key[by]
        place = np.arange(len(key))
        group, own = np.ones(len(key), bool), np.ones(len(key), bool)
        group[1:], own[1:] = (key[1:] >> 32) != (key[:-1] >> 32), key[1:] != key[:-1]
        rank[open_] = (key >> 32) + np.maximum.accumulate(np.where(own, place, 0)) - np.maximum.accumulate(np.where(group, place, 0))
        open_ = open_[~(own & np.append(own[1:], True))]
        width *= 2
    return rank


def next_beyond(rank: np.ndarray, greater: bool) -> np.ndarray:
    """The next position of a smaller rank (or a greater one); the number of positions where there is none."""
    own = (-rank if greater else rank).tolist()
    n = len(own)
    own.append(-n - 1)
    out = [n] * (n + 1)
    for i in range(n - 1, -1, -1):
        r, j = own[i], i + 1
        while own[j] > r:
            j = out[j]
        out[i] = j
    return np.array(out[:n], np.int64)


def common_prefixes(symbols: np.ndarray, rank: np.ndarray, text: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """LCP array: what each suffix, by rank, has in common with the one before it. 0 across texts."""
    n = len(symbols)
    order = np.empty(n, np.int64)
    order[rank] = np.arange(n)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = np.where(text[order[1:]] == text[order[:-1]], order[:-1], -1)
    s, ends, out, h = symbols.tolist(), stop.tolist(), np.zeros(n, np.int32), 0
    found = [0] * n
    for i, j in enumerate(before.tolist()):
        if j < 0:
            h = 0
            continue
        most = ends[i] - (i if i > j else j)
        while h < most and s[i + h] == s[j + h]:
            h += 1
        found[i] = h
        if h:
            h -= 1
    out[rank] = found
    return out


class Extensions:
    """Longest common extensions of pairs of positions in one text each, by range minima over the LCP array."""

    def __init__(self, symbols: np.ndarray, rank: np.ndarray, text: np.ndarray, stop: np.ndarray):
        self.rank = rank
        self.minima = [common_prefixes(symbols, rank, text, stop)]
        while 2 ** len(self.minima) <= len(rank):
            last, half = self.minima[-1], 2 ** (len(self.minima) - 1)
            self.minima.append(np.minimum(last[:-half], last[half:]))

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        low, high = np.minimum(self.rank[a], self.rank[b]) + 1, np.maximum(self.rank[a], self.rank[b])
        level = np.frexp((high - low + 1).astype(float))[1] - 1
        out = np.zeros(len(a), np.int64)
        for k in np.unique(level):
            at = level == k
            out[at] = np.minimum(self.minima[k][low[at]], self.minima[k][high[at] - 2**k + 1])
        return out


def _roots(symbols: np.ndarray, rank: np.ndarray, begin: np.ndarray, stop: np.ndarray, rule: RunRule) -> tuple[np.ndarray, np.ndarray]:
    """(i, period) of the Lyndon words that have as much of a repeat beside them as a run's root must have.

    A run reaches beyond its root by its length less a period, half of that at least on one side: there some of the
    words that must repeat are compared, the first and the last among them.
    """
    at = np.arange(len(symbols))
    smaller, greater = np.minimum(next_beyond(rank, False), stop), next_beyond(rank, True)
    real = greater < stop  # a run to the end of its text is found under the other order
    i, period = np.concatenate([at, at[real]]), np.concatenate([smaller - at, (greater - at)[real]])
    room = rule.least_periods * period <= (stop - begin)[i]
    i, period = i[room], period[room]
    reach = (np.maximum(rule.least_words, rule.least_periods * period) - period + 1) // 2
    parts = [(reach - 1) * part // PROBES for part in range(PROBES + 1)]
    found = np.zeros(len(i), bool)
    for fits, first, way in ((i + period + reach <= stop[i], 0, 1), (i - reach >= begin[i], -1, -1)):
        at = np.flatnonzero(fits)
        for step in parts:
            word = i[at] + first + way * step[at]
            at = at[symbols[word] == symbols[word + period[at]]]
        found[at] = True
    return i[found], period[found]


def find_runs(symbols: np.ndarray, lengths: np.ndarray, rule: RunRule) -> tuple[np.ndarray, ...]:
    """(text, start, length, period) of the runs of several texts in a row, by text, start and period."""
    n = len(symbols)
    ends = np.cumsum(lengths)
    text = np.repeat(np.arange(len(lengths)), lengths)
    stop, begin = ends[text], (ends - lengths)[text]
    none = np.zeros(0, np.int64)
    if not n:
        return none, none, none, none
    rank = suffix_ranks(symbols, text, stop)
    i, period = _roots(symbols, rank, begin, stop, rule)
    if not len(i):
        return none, none, none, none
    # only the texts with such roots are extended
    wanted = np.zeros(len(lengths), bool)
    wanted[text[i]] = True
    here = wanted[text]
    moved = np.cumsum(here) - 1
    shift = np.zeros(n, np.int64)
    shift[here] = np.flatnonzero(here) - moved[here]
    i = moved[i]
    symbols, text, old_begin, rank = symbols[here], text[here], begin[here], rank[here]
    begin, stop = begin[here] - shift[here], stop[here] - shift[here]
    rank = rank - old_begin + begin  # texts come in turn, so a text's ranks are its own places
    n = len(symbols)
    right = np.zeros(len(i), np.int64)
    more = i + period < stop[i]
    right[more] = Extensions(symbols, rank, text, stop)(i[more], (i + period)[more])
    back, back_text, back_stop = symbols[::-1], text[-1] - text[::-1], n - begin[::-1]
    left = np.zeros(len(i), np.int64)
    more = i > begin[i]
    if more.any():
        reach = Extensions(back, suffix_ranks(back, back_text, back_stop), back_text, back_stop)
        left[more] = reach(n - i[more], n - (i + period)[more])
    length = left + period + right
    keep = length >= np.maximum(rule.least_words, rule.least_periods * period)
    runs = np.unique(np.stack([text[i], (i - left - begin[i]), length, period], 1)[keep], axis=0)
    runs = runs[np.lexsort((runs[:, 3], runs[:, 1], runs[:, 0]))]
    return tuple(runs.T)


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words that no run repeats: of each run its first period stays, unless another run drops it."""
    if not runs:
        return b" ".join(words)
    edge = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        edge[start + period] += 1
        edge[start + length] -= 1
    return b" ".join([w for w, drop in zip(words, np.cumsum(edge[:-1]).tolist(), strict=True) if not drop])


def runs_of_texts(texts: list[str | None], rule: RunRule | None = None) -> list[tuple[list[bytes], list[tuple[int, int, int]]]]:
    """Words and runs (start, length, period) of each text."""
    words = [words_of(t or "") for t in texts]
    flat = list(chain.from_iterable(words))
    number = dict(zip(distinct := dict.fromkeys(flat), range(len(distinct)), strict=True))
    symbols = np.array(list(map(number.__getitem__, flat)), np.int64)
    text, start, length, period = find_runs(symbols, np.array([len(w) for w in words], np.int64), rule or RunRule())
    runs: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for t, *run in zip(text.tolist(), start.tolist(), length.tolist(), period.tolist(), strict=True):
        runs[t].append(tuple(run))
    return list(zip(words, runs, strict=True))


def detect_runs(docs: DataFrame, rule: RunRule | None = None) -> DataFrame:
    """doc_id, number of words, runs by start and period, and the text without what they repeat, of each document (doc_id, text)."""
    rule = rule or RunRule()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, at = batch.column(0), batch.column(1), 0
            while at < len(texts):
                part, size = [], 0
                while at + len(part) < len(texts) and (not part or size < 6 * rule.batch_words):
                    part.append(texts[at + len(part)].as_py())
                    size += len(part[-1] or "")
                found = runs_of_texts(part, rule)
                yield pa.RecordBatch.from_arrays([
                    ids.slice(at, len(part)), pa.array([len(w) for w, _ in found], pa.int64()),
                    pa.array([[dict(zip(("start", "length", "period"), r, strict=True)) for r in runs] for _, runs in found], _RUN),
                    pa.array([collapse(w, runs).decode("utf-8", "surrogatepass") for w, runs in found], pa.string()),
                ], ["doc_id", "n_words", "runs", "collapsed"])
                at += len(part)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)


def with_planted_periods(docs: DataFrame) -> DataFrame:
    """doc_id and text; a tenth of the documents, by crc32 of the id, is made periodic from some word on.

    With h = crc32(id) and g = floor(h / 10): where h % 10 = 0, each word from a = g % n on becomes the one of
    1 + floor((n - a) / (3 + g % 8)) words from a on that its place falls on. A null id or text stays as it is.
    """
    doc_id, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.call_function("div", h, F.lit(10))
    n = F.size("w").cast("long")
    rows = docs.select(doc_id.alias("doc_id"), text.alias("text"), g.alias("g"), F.when(h % 10 == 0, F.regexp_extract_all(text, F.lit(r"([^\x20\x09-\x0D]+)"))).alias("w"))
    rows = rows.withColumn("a", F.when(n > 0, F.col("g") % n)).withColumn("p", 1 + F.expr("(size(w) - a) div (3 + g % 8)"))
    periodic = F.expr("transform(sequence(0L, size(w) - 1L), i -> w[cast(if(i < a, i, a + (i - a) % p) as int)])")
    return rows.select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(periodic, " ")).otherwise(F.col("text")).alias("text"))


def run_digests(found: DataFrame) -> DataFrame:
    """Number of runs, the longest (ties: earliest start, then shortest period), and digests of all runs and of the collapsed text."""
    listed = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("before"), (-r["period"]).alias("shorter"))))
    rows = found.withColumn("best", best).withColumn("listed", F.when(F.size("runs") > 0, F.concat(listed, F.lit("\n"))).otherwise(""))
    length, period = F.col("best.length"), -F.col("best.shorter")
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.before")).alias("start"), length.alias("length"), period.alias("period"),
        F.call_function("div", 1000 * length, period).alias("exponent_milli"), _sha256(F.col("listed")).alias("runs_sha256"), _sha256(F.col("collapsed")).alias("collapsed_sha256"),
    )


def _sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)
