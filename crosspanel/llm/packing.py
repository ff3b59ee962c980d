"""Best-fit packing of tokenised documents into sequences, improved by swap-based local search.

1. Every document becomes its ids and an end id; only longer ones are cut, from the end, into full pieces, so that a
   first piece may be shorter. One pass, no shuffle; ids become a checksum at once.
2. Packing depends on lengths alone, so it is worked out on the histogram of piece lengths, which has at most
   `capacity` entries however many documents there are. Bins that hold the same lengths are one pattern with a count:
   best fit, largest first, fills them; then a local search exchanges one piece for one, two for one, or moves a
   piece between underfull bins wherever that increases squared fill, until bins empty. It ends where the bins are as
   few as their tokens allow, where nothing is gained any more, or after a stated effort; every state of it is a packing
   of all pieces.
3. Pieces of each length are numbered across the data (per-partition counts, then offsets) and take the places that
   the patterns hold for that length, by binary search in a table as small as the patterns are.

Defined results. Null text: an empty document, which is its end id alone. Null doc_id: kept. Repeated rows: packed one
by one. Empty table: no rows. Very long texts: cut, never shortened. Other columns of the input are not touched.
"""

from __future__ import annotations

import base64
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crosspanel.llm.common import stage

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, row long, rank long"


@dataclass(frozen=True)
class Settings:
    """Size of a sequence, the end id, and how far the local search looks."""

    capacity: int = 2048
    end_id: int = 0
    #: Rounds without a gain after which the search stops, and most rounds.
    patience: int = 3
    rounds: int = 60
    #: Takers looked at in all, after which the search stops too: what bounds its time on the driver.
    effort: int = 2_000_000


def encoder(ranks_path: str, pattern: str, special: dict[str, int]):
    """The byte-pair encoder of a rank file; its ids are those of the library the vocabulary came with."""
    import tiktoken

    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("pieces", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n ids: all full, but for the first."""
    first = n % capacity or min(n, capacity)
    return [(0, first)] + [(at, capacity) for at in range(first, n, capacity)]


def tokenise(docs: DataFrame, ranks_path: str, pattern: str, special: dict[str, int], settings: Settings) -> DataFrame:
    """The pieces of each document, numbered among those of their length within the task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        encode = encoder(ranks_path, pattern, special).encode_to_numpy
        part, row, seen = TaskContext.get().partitionId(), 0, Counter()
        for batch in batches:
            out = []
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                ids = np.append(encode(text, allowed_special="all") if text else np.zeros(0, "<u4"), np.uint32(settings.end_id)).astype("<u4")
                for piece, (start, length) in enumerate(cut(len(ids), settings.capacity)):
                    out.append((doc_id, piece, start, length, zlib.crc32(ids[start : start + length].tobytes()), part, row, seen[length]))
                    seen[length] += 1
                row += 1
            frame = pd.DataFrame(out, columns=[x.split()[0] for x in PIECES.split(", ")])
            yield frame.astype({"doc_id": "Int64"})

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInPandas(run, PIECES)


class Bins:
    """Patterns (sorted lengths) with the number of bins that hold them, by what is left in them."""

    def __init__(self, capacity: int) -> None:
        self.capacity = capacity
        self.count: dict[tuple[int, ...], int] = defaultdict(int)
        self.by_room: dict[int, dict[tuple[int, ...], None]] = defaultdict(dict)

    def add(self, pattern: tuple[int, ...], n: int) -> None:
        """n more bins of this pattern; less, if n is negative."""
        if not n or not pattern:
            return
        room = self.capacity - sum(pattern)
        self.count[pattern] += n
        if self.count[pattern]:
            self.by_room[room][pattern] = None
        else:
            del self.count[pattern]
            self.by_room[room].pop(pattern, None)
            if not self.by_room[room]:
                del self.by_room[room]


def best_fit(lengths: dict[int, int], capacity: int) -> Bins:
    """Best fit, longest first; all pieces of a length at once."""
    bins = Bins(capacity)
    for length in sorted(lengths, reverse=True):
        left = lengths[length]
        for room in sorted(r for r in bins.by_room if r >= length):
            fits = room // length
            for pattern in list(bins.by_room.get(room, ())):
                if not left:
                    break
                full = min(bins.count[pattern], left // fits)
                if full:
                    bins.add(pattern, -full)
                    bins.add(tuple(sorted((*pattern, *[length] * fits))), full)
                    left -= full * fits
                if 0 < left < fits and pattern in bins.count:
                    bins.add(pattern, -1)
                    bins.add(tuple(sorted((*pattern, *[length] * left))), 1)
                    left = 0
        each = capacity // length
        bins.add((length,) * each, left // each)
        bins.add((length,) * (left % each), 1 if left % each else 0)
    return bins


def _less(pattern: tuple[int, ...], gone: tuple[int, ...], new: tuple[int, ...] = ()) -> tuple[int, ...]:
    rest = list(pattern)
    for x in gone:
        rest.remove(x)
    return tuple(sorted((*rest, *new)))


def improve(bins: Bins, settings: Settings) -> None:
    """Exchange and move pieces between underfull bins while that increases squared fill.

    For bins a (fuller) and b, a gains what b loses, so squared fill grows whenever the fuller bin grows. Bins are
    taken from the emptiest up as givers; each gives pieces to the fullest bins that a move, a one-for-one or a
    two-for-one exchange brings nearer to full. A step applies to as many bins of both patterns as there are.
    """
    capacity, idle, left = bins.capacity, 0, [settings.effort]
    total = sum(sum(p) * n for p, n in bins.count.items())
    for _ in range(settings.rounds):
        if sum(bins.count.values()) <= -(-total // capacity):
            return
        changed = False
        givers = sorted((p for p in bins.count if sum(p) < capacity), key=sum)
        # the emptier half first; the rest too once that half has nothing left to give
        for giver in givers if idle else givers[: max(1, len(givers) // 2)]:
            if giver not in bins.count:
                continue
            step = _step(bins, giver, left)
            if step:
                changed = True
                taker, giver_new, taker_new = step
                n = min(bins.count[giver], bins.count[taker]) if giver != taker else bins.count[giver] // 2
                bins.add(giver, -n)
                bins.add(taker, -n)
                bins.add(giver_new, n)
                bins.add(taker_new, n)
            if left[0] <= 0:
                return
        idle = 0 if changed else idle + 1
        if idle >= settings.patience:
            return


@lru_cache(maxsize=20_000)
def _pairs(pattern: tuple[int, ...]) -> set[tuple[int, int]]:
    """Pairs of a pattern's pieces that differ; at most 63 lengths that differ fit in a pattern of 2048."""
    own = sorted(Counter(pattern).items())
    return {(a, b) for i, (a, _) in enumerate(own) for b, _ in own[i + 1 :]} | {(a, a) for a, n in own if n > 1}


def _step(bins: Bins, giver: tuple[int, ...], left: list[int]) -> tuple | None:
    """The gain that leaves a taker fullest: (taker, giver's new pattern, taker's new pattern)."""
    fill, capacity = sum(giver), bins.capacity
    ones, twos = sorted(set(giver), reverse=True), _pairs(giver)
    for room in sorted(r for r in bins.by_room if 0 < r and capacity - r >= fill):
        for taker in list(bins.by_room[room]):
            if taker == giver and bins.count[giver] < 2:
                continue
            left[0] -= 1
            if left[0] < 0:
                return None
            best = None
            for x in ones:  # move
                if x <= room and (best is None or x > best[0]):
                    best = (x, (x,), ())
            own = sorted(set(taker))
            for x in ones:  # one for one
                for y in own:
                    gain = x - y
                    if 0 < gain <= room and (best is None or gain > best[0]):
                        best = (gain, (x,), (y,))
            for a, b in _pairs(taker):  # two of the taker's for one of the giver's
                for x in ones:
                    gain = x - a - b
                    if 0 < gain <= room and (best is None or gain > best[0]):
                        best = (gain, (x,), (a, b))
            for a, b in twos:  # two of the giver's for one of the taker's
                for y in own:
                    gain = a + b - y
                    if 0 < gain <= room and (best is None or gain > best[0]):
                        best = (gain, (a, b), (y,))
            if best:
                _, gone, back = best
                return taker, _less(giver, gone, back), _less(taker, back, gone)
    return None


def places(bins: Bins) -> pd.DataFrame:
    """For each length, runs of places: the first rank they take, the first sequence, the offset in it, how many."""
    rows, sequence = [], 0
    for pattern, n in sorted(bins.count.items()):
        offset = 0
        for length in pattern:
            rows.append((length, sequence, offset, n))
            offset += length
        sequence += n
    frame = pd.DataFrame(rows, columns=["length", "sequence", "offset", "n"]).astype("int64").sort_values(["length", "sequence", "offset"], kind="stable")
    frame["rank"] = frame.groupby("length")["n"].cumsum() - frame["n"]
    return frame


def pack(docs: DataFrame, ranks_path: str, pattern: str, special: dict[str, int], settings: Settings | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece of every document (doc_id, text)."""
    settings = settings or Settings()
    pieces = stage(tokenise(docs, ranks_path, pattern, special, settings), "pieces")
    # at most `capacity` lengths a task; one row a length after the sum
    tallies = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    lengths = {r["length"]: r["n"] for r in tallies.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    bins = best_fit(lengths, settings.capacity)
    improve(bins, settings)
    table = places(bins)
    own = {n: (t["rank"].to_numpy(), t["sequence"].to_numpy(), t["offset"].to_numpy()) for n, t in table.groupby("length")}
    # how many of the length came in earlier tasks: a running sum, over one row a task
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = tallies.select("part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    ranked = pieces.join(offsets, ["part", "length"]).withColumn("rank", F.col("rank") + F.col("base"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for n in np.unique(length):
                rows = length == n
                first, seq, off = own[int(n)]
                at = np.searchsorted(first, rank[rows], "right") - 1
                sequence[rows], offset[rows] = seq[at] + rank[rows] - first[at], off[at]
            columns = [batch.column(x) for x in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sequence), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(
        place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    )
