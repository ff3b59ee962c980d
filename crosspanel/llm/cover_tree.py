"""Exact top-k inner products by dual-tree search over cover trees.

1. A bounded sample of rows, the first by a hash, gives pivots chosen farthest first. Rows are dealt to blocks by their
   nearest pivot, and by a hash where a pivot has many, so that near rows share a block; each pivot's covering radius is
   measured over all of its rows.
2. The kth best score that a query reaches in the sample is a floor of its result: it only meets the pivots whose radius
   lets a score reach that floor. Queries are a stated set against all rows, in blocks: a task holds one block of rows
   and one bounded group of queries.
3. A task builds a cover tree of its rows and one of its queries. A node at level i covers its rows within BASE ** i of
   its centre (covering); the centres of its children lie further apart than their level's distance (separation), and
   the first of them is its own (nesting). A node whose rows would need over `fan_out` children at the next level is
   split by farthest-first centres, and the level is the one that their covering distance gives: no leaf
   has over `leaf` rows unless they are copies. Pairs of nodes are compared together: the product of two centres with
   both measured radii bounds every score below the pair, and the pair is dropped once that bound is under the worst kth
   score of the query node. Products of leaves are taken in tiles of bounded size.

Results are exact, whatever the sample: it only decides what is dropped early. Copies of one vector fill a leaf of
radius 0.

Defined results. Vectors that are null, empty, or hold a null or non-finite component take no part; a null id takes
none. A query has no candidates of another length than its own. Rows that repeat an id and a vector count once; an id
with several vectors is a row for each, as a candidate and as a query, ranked for each. Ties go to the smaller id. Fewer
than k candidates: all of them; none: no row. Empty table: no rows. Scores are whole and exact; a vector so long that
they could leave 64 bits is refused with an error. Other columns of the input are not touched.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crosspanel.llm.common import stage

ROW = "vec_id long, size int, values binary, own long, pivot int, away double"
HITS = "query_id long, own long, vec_id long, score long"
BASE = 1.3

#: Squared lengths up to which products are exact in doubles, and in 64-bit whole numbers.
IN_DOUBLES, IN_LONGS = 2.0**52, 2.0**62


#: Rows and queries of a product.
TILE = 1024


@dataclass(frozen=True)
class Settings:
    """Results a query, scaling of components, and sizes of blocks, groups and the sample."""

    k: int = 5
    scale: int = 256
    block_rows: int = 8_192
    query_rows: int = 8_192
    sample_rows: int = 2_048
    pivots: int = 24
    leaf: int = 128
    fan_out: int = 64


def farthest_first(rows: np.ndarray, first: int, most: int, goal: float = 0.0) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Centres among rows, each farthest from those before, until `most` or all rows are within `goal`: centres, nearest, distance to it."""
    centres, belongs = [first], np.zeros(len(rows), int)
    near = np.sqrt(((rows - rows[first]) ** 2).sum(1))
    while len(centres) < most and near.max() > goal:
        far = int(np.argmax(near))
        away = np.sqrt(((rows - rows[far]) ** 2).sum(1))
        closer = away < near
        near[closer], belongs[closer] = away[closer], len(centres)
        centres.append(far)
    return centres, belongs, near


class CoverTree:
    """Nodes over rows in the order `order`: centre, level, measured radius, rows from `begin` to `end`, children."""

    def __init__(self, rows: np.ndarray, settings: Settings) -> None:
        self.order = np.arange(len(rows))
        self.level: list[float] = []
        self.radius: list[float] = []
        self.span: list[tuple[int, int]] = []
        self.children: list[np.ndarray] = []
        centres: list[int] = []

        def node(centre: int, level: float, radius: float, begin: int, end: int) -> int:
            centres.append(centre)
            self.level.append(level)
            self.radius.append(radius)
            self.span.append((begin, end))
            self.children.append(np.zeros(0, int))
            return len(centres) - 1

        radius = float(np.sqrt(((rows - rows[0]) ** 2).sum(1).max()))
        todo = [node(0, _level(radius) + 1, radius, 0, len(rows))]
        while todo:
            at = todo.pop()
            begin, end = self.span[at]
            if end - begin <= settings.leaf or self.radius[at] == 0:
                continue
            own = self.order[begin:end].copy()
            level = _level(self.radius[at])  # the highest at which this node falls apart
            first = int(np.flatnonzero(own == centres[at])[0])
            chosen, belongs, near = farthest_first(rows[own], first, settings.fan_out + 1, BASE**level)
            if len(chosen) > settings.fan_out:
                # centres are no nearer to each other than they leave any row, so that distance is a level between
                parts = max(2, min(settings.fan_out, -(-2 * len(own) // settings.leaf)))
                chosen, belongs, near = farthest_first(rows[own], first, parts)
                level = math.log(float(near.max())) / math.log(BASE) - 1e-12
            by = np.argsort(belongs, kind="stable")
            self.order[begin:end] = own[by]
            below, start = [], begin
            for i, n in enumerate(np.bincount(belongs, minlength=len(chosen)).tolist()):
                below.append(node(int(own[chosen[i]]), level, float(near[belongs == i].max()), start, start + n))
                start += n
            self.children[at] = np.array(below)
            todo += below
        self.centre = rows[centres]
        self.centres = centres
        self.length = np.sqrt((self.centre**2).sum(1))
        self.reach = np.array(self.radius)


def _level(radius: float) -> int:
    """The highest level whose distance is below a radius."""
    if radius <= 0:
        return 0
    level = math.ceil(math.log(radius) / math.log(BASE)) - 1
    return level - 1 if BASE**level >= radius else level


def search(
    queries: np.ndarray, query_ids: np.ndarray, query_own: np.ndarray, floors: np.ndarray, rows: np.ndarray, row_ids: np.ndarray, row_own: np.ndarray, settings: Settings
) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """For each query its k best (score, id, whether there is one), none below its floor, and how many pairs of rows were scored."""
    n, k = len(queries), settings.k
    scores, ids, have = np.zeros((n, k), np.int64), np.zeros((n, k), np.int64), np.zeros((n, k), bool)
    if not n or not len(rows):
        return scores, ids, have, 0
    exact = max(float((queries**2).sum(1).max()), float((rows**2).sum(1).max())) < IN_DOUBLES
    mine, theirs = CoverTree(queries, settings), CoverTree(rows, settings)
    order, other = mine.order, theirs.order
    q, x = queries[order], rows[other]
    if not exact:
        q, x = q.astype(np.int64), x.astype(np.int64)
    q_ids, q_own, x_ids, x_own = query_ids[order], query_own[order], row_ids[other], row_own[other]
    worst, scored = floors[order].astype(float), 0

    def bounds(a, b) -> np.ndarray:
        top = np.atleast_1d(mine.centre[a] @ theirs.centre[b].T) + mine.length[a] * theirs.reach[b] + theirs.length[b] * mine.reach[a] + mine.reach[a] * theirs.reach[b]
        return top + 1e-9 * np.abs(top) + 1e-6

    def tile(begin: int, end: int, left: int, right: int) -> int:
        """Score some queries against some rows and keep each query's best; how many pairs that were."""
        found = q[begin:end] @ x[left:right].T
        good = found >= worst[begin:end, None]
        good &= (q_ids[begin:end, None] != x_ids[None, left:right]) | (q_own[begin:end, None] != x_own[None, left:right])
        i, j = np.nonzero(good)
        if not len(i):
            return found.size
        touched = np.unique(i)
        old, slot = np.nonzero(have[begin + touched])
        who = np.concatenate([i, touched[old]])
        s = np.concatenate([found[i, j].astype(np.int64), scores[begin + touched[old], slot]])
        v = np.concatenate([x_ids[left + j], ids[begin + touched[old], slot]])
        by = np.lexsort((v, -s, who))
        who, s, v = who[by], s[by], v[by]
        rank = np.arange(len(who)) - np.searchsorted(who, who)
        keep = rank < k
        at = (begin + who[keep], rank[keep])
        scores[at], ids[at], have[at] = s[keep], v[keep], True
        full = begin + touched[have[begin + touched, k - 1]]
        worst[full] = np.maximum(worst[full], scores[full, k - 1])
        return found.size

    todo = [(float(bounds(0, 0)[0]), 0, 0)]
    while todo:
        top, a, b = todo.pop()
        begin, end = mine.span[a]
        if top < worst[begin:end].min():
            continue
        below_a, below_b = mine.children[a], theirs.children[b]
        if len(below_a) or len(below_b):
            split_b = len(below_b) and (not len(below_a) or theirs.reach[b] >= mine.reach[a])
            tops = bounds(a, below_b) if split_b else bounds(below_a, b)
            # the most promising pair comes off first
            todo += [(float(tops[i]), a, int(below_b[i])) if split_b else (float(tops[i]), int(below_a[i]), b) for i in np.argsort(tops)]
            continue
        left, right = theirs.span[b]
        for low in range(begin, end, TILE):
            for side in range(left, right, TILE):
                scored += tile(low, min(low + TILE, end), side, min(side + TILE, right))
    back = np.empty(n, int)
    back[order] = np.arange(n)
    return scores[back], ids[back], have[back], scored


def _whole(vector: pa.Scalar, scale: int) -> np.ndarray | None:
    """floor(scale * x) of a vector that takes part."""
    if not vector.is_valid or not len(vector.values) or vector.values.null_count:
        return None
    x = np.floor(scale * vector.values.to_numpy().astype(float))
    if not np.isfinite(x).all():
        return None
    if float((x**2).sum()) >= IN_LONGS:
        raise ValueError("a vector is so long that its scores could leave 64 bits")
    return x


def scaled(vectors: DataFrame, settings: Settings, pivots: dict[int, np.ndarray] | None = None) -> DataFrame:
    """vec_id, size, values (32- or 64-bit whole numbers), a hash of them, nearest pivot and distance, of the vectors that take part."""
    pivots = pivots or {}
    kinds = (pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int32(), pa.float64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            out: list[list] = [[] for _ in kinds]
            for vec_id, vector in zip(batch.column(0), batch.column(1), strict=True):
                x = _whole(vector, settings.scale) if vec_id.is_valid else None
                if x is None:
                    continue
                packed = x.astype(np.int32 if np.abs(x).max() < 2**31 else np.int64).tobytes()
                near = np.sqrt(((pivots[len(x)] - x) ** 2).sum(1)) if len(x) in pivots else np.zeros(1)
                best = int(np.argmin(near))
                own = np.int64(np.uint64(xxhash.xxh64_intdigest(x.astype(np.int64).tobytes())).view(np.int64))
                for column, value in zip(out, (vec_id.as_py(), len(x), packed, int(own), best, float(near[best])), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], [c.split()[0] for c in ROW.split(", ")])

    return vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>")).mapInArrow(run, ROW)


def _matrix(values, size: int) -> np.ndarray:
    """Rows of packed whole numbers as doubles, which hold them exactly up to 2^53."""
    return np.array([np.frombuffer(v, np.int32 if len(v) == 4 * size else np.int64) for v in values], float).reshape(-1, size)


def top_k(vectors: DataFrame, is_query, settings: Settings | None = None) -> DataFrame:
    """query_id, rank, vec_id and score of the k best rows for every row of (vec_id, embedding) that `is_query` chooses."""
    settings = settings or Settings()
    k = settings.k
    sample: dict[int, tuple] = {}
    first = scaled(vectors, settings).orderBy(F.xxhash64("vec_id", F.lit(3)), "vec_id", "own").limit(settings.sample_rows)
    for size, some in first.toPandas().groupby("size"):
        some = some.drop_duplicates(["vec_id", "own"])
        sample[int(size)] = (some["vec_id"].to_numpy(), some["own"].to_numpy(), _matrix(some["values"], int(size)))
    pivots = {size: x[farthest_first(x, 0, settings.pivots)[0]] for size, (_, _, x) in sample.items()}
    rows = stage(scaled(vectors, settings, pivots), "vectors")
    # a row for each length and pivot
    cells = {(r["size"], r["pivot"]): (r["n"], r["away"]) for r in rows.groupBy("size", "pivot").agg(F.count("*").alias("n"), F.max("away").alias("away")).collect()}
    parts = {cell: -(-n // settings.block_rows) for cell, (n, _) in cells.items()}
    asked = rows.where(is_query(F.col("vec_id")))
    groups = max(1, math.ceil(asked.count() / settings.query_rows))
    block = F.pmod(F.xxhash64("vec_id", "own"), F.get(F.col("parts"), F.lit(0)).cast("long")).cast("int")

    def with_parts(df: DataFrame) -> DataFrame:
        small = df.sparkSession.createDataFrame([(s, p, [n]) for (s, p), n in parts.items()] or [(0, 0, [1])], "size int, pivot int, parts array<int>")
        return df.join(F.broadcast(small), ["size", "pivot"])

    def meets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The floor of each query, and the pivots where a score may reach it."""
        for batch in batches:
            sizes = batch.column("size").to_numpy()
            at, met, floors = [], [], []
            for size in np.unique(sizes):
                mine = np.flatnonzero(sizes == size)
                own_ids, own = batch.column("vec_id").to_numpy()[mine], batch.column("own").to_numpy()[mine]
                q = _matrix([batch.column("values")[int(i)].as_py() for i in mine], int(size))
                floor = np.full(len(mine), -np.inf)
                ids, others, x = sample.get(int(size), (np.zeros(0), np.zeros(0), np.zeros((0, size))))
                if len(x) > k:
                    s = q @ x.T
                    s[(own_ids[:, None] == ids[None]) & (own[:, None] == others[None])] = -np.inf
                    floor = np.partition(s, len(x) - k, axis=1)[:, len(x) - k]
                    floor -= 1e-9 * np.abs(floor) + 1e-6  # products beyond 2^53 are rounded
                length = np.sqrt((q**2).sum(1))
                for p in [p for s, p in cells if s == size]:
                    centre = pivots[int(size)][p] if int(size) in pivots else None
                    top = q @ centre + length * cells[int(size), p][1] if centre is not None else np.full(len(q), np.inf)
                    hit = np.flatnonzero(top + 1e-9 * np.abs(top) + 1e-6 >= floor)
                    at += mine[hit].tolist()
                    met += [p] * len(hit)
                    floors += floor[hit].tolist()
            own = batch.select(["vec_id", "own", "size", "values"]).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*own.columns, pa.array(met, pa.int32()), pa.array(floors, pa.float64())], ["vec_id", "own", "size", "values", "pivot", "floor"])

    pairs = asked.select("vec_id", "own", "size", "values").mapInArrow(meets, "vec_id long, own long, size int, values binary, pivot int, floor double")
    pairs = pairs.withColumn("group", F.pmod(F.xxhash64("vec_id", "own"), F.lit(groups)).cast("int"))
    reached = F.lit(0)
    if groups > 1:
        # the rows of a pivot go to the groups of which some query reaches it: a row for each of those
        pairs = stage(pairs, "reached")
        by_pivot = pairs.groupBy("size", "pivot").agg(F.collect_set("group").alias("groups"))
        own = with_parts(rows).join(F.broadcast(by_pivot), ["size", "pivot"])  # a row for each length and pivot
        reached = F.explode("groups")
    else:
        own = with_parts(rows)
    dealt = own.select("vec_id", "own", "size", "values", "pivot", block.alias("block"), reached.alias("group"))
    pairs = with_parts(pairs).select("vec_id", "own", "size", "values", "floor", "pivot", F.explode(F.sequence(F.lit(0), F.get("parts", F.lit(0)) - 1)).alias("block"), "group")

    def once(table: pa.Table) -> dict:
        """A block's rows, those that repeat an id and a vector once."""
        frame = table.to_pandas().drop_duplicates(["vec_id", "own"])
        return {c: frame[c].to_numpy() for c in frame.columns} | {"x": _matrix(frame["values"], int(frame["size"].iloc[0]))}

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [np.zeros(0, np.int64)] * 4
        if left.num_rows and right.num_rows:
            x, q = once(left), once(right)
            scores, ids, have, _ = search(q["x"], q["vec_id"], q["own"], q["floor"], x["x"], x["vec_id"], x["own"], settings)
            at = np.nonzero(have)
            out = [q["vec_id"][at[0]], q["own"][at[0]], ids[at], scores[at]]
        return pa.table(out, names=[c.split()[0] for c in HITS.split(", ")])

    key = ["size", "pivot", "block", "group"]
    hits = dealt.groupBy(*key).cogroup(pairs.groupBy(*key)).applyInArrow(meet, HITS)
    by = Window.partitionBy("query_id", "own").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
