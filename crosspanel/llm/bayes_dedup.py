"""MinHash near-duplicates with sequential Bayesian verification.

Documents are sets of shingles (five words; the whole sequence of a shorter text), A-Z folded. Documents with one and
the same set are one class, and classes are what is compared.

1. Every class has a signature of `bands` x `rows` minima. Classes that agree in all rows of a band are candidates.
2. Candidates compare their signatures batch by batch. With m of n minima equal and a uniform prior, a pair's similarity
   is distributed as Beta(m + 1, n - m + 1): where it reaches the threshold with less than `miss` probability, the pair
   is given up after that batch. Pairs that are left after the last batch are ties.
3. The texts of each component of ties meet, and every pair there that could still join something is verified on the
   full sets, in whole numbers. Components of the verified links are the result.

A group (a band's bucket, a component of ties) of any size goes the same way: it is dealt into blocks of bounded size,
and a few of its members, the centres, join every block. What a block's own pairs join is one part from then on; a
group of near copies becomes one part by its centres. Only members outside their group's largest part are then compared
with the members of all other blocks (`joined_in_groups`), so no group costs its square unless most of it is unlike its
centres, and no pair that could join two parts is left out.

Nothing is sampled, capped or dropped. Only texts of classes with a tie are shuffled: rows of others are mostly held
back by a bitmap of the keys asked for.

Defined results. Null or empty text, or one of blanks: the set is empty and linked with nothing. Null doc_id: kept; it
has the least non-null id of its component, null where there is none, and is `kept` only then. Repeated rows: copies,
each with its row. One id with several texts: each row goes by its own text. Empty table: no rows. Very long texts: all
shingles count. Other columns of the input are not touched.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crosspanel.llm import minhash_forest
from crosspanel.llm.common import only_wanted, stage
from crosspanel.llm.components import connected_components
from crosspanel.llm.minhash_forest import shared_shingles, shingle_sets, text_keys


@dataclass(frozen=True)
class Settings:
    """The threshold, in hundredths, the shape of the signatures, and how sure a pair is given up."""

    percent: int = 85
    words: int = 5
    bands: int = 20
    rows: int = 5
    #: Minima compared at a time.
    batch: int = 20
    #: Probability, after any batch, that a pair given up has the similarity asked for.
    miss: float = 1e-4
    #: Members of a block of a bucket; texts, and shingles of them, of a block of a component.
    block: int = 8192
    verify_block: int = 1024
    verify_shingles: int = 1_000_000
    #: Members of a large group that join every block of it.
    centres: int = 16

    @property
    def signature(self) -> minhash_forest.Settings:
        return minhash_forest.Settings(words=self.words, trees=self.bands, depth=self.rows)

    @cached_property
    def least_equal(self) -> list[tuple[int, int, int]]:
        """(from, to, least number of equal minima up to there) of each batch."""
        n, t, out = self.bands * self.rows, self.percent / 100, []
        for at in range(0, n, self.batch):
            seen = min(at + self.batch, n)
            # P(similarity >= t | m of seen) is the chance of at most m heads in seen + 1 throws at t
            chance, least = 0.0, 0
            for m in range(seen + 1):
                chance += comb(seen + 1, m) * t**m * (1 - t) ** (seen + 1 - m)
                if chance >= self.miss:
                    least = m
                    break
            out.append((at, seen, least))
        return out


def survivors(own: np.ndarray, others: np.ndarray, settings: Settings) -> np.ndarray:
    """Which of `others` still may be similar to `own` after all batches of their signatures."""
    at, equal = np.arange(len(others)), np.zeros(len(others), np.int64)
    for a, b, least in settings.least_equal:
        equal = equal + (others[at, a:b] == own[a:b]).sum(1)
        left = equal >= least
        at, equal = at[left], equal[left]
        if not len(at):
            break
    out = np.zeros(len(others), bool)
    out[at] = True
    return out


def spanning(n: int, hits: Callable[[int, np.ndarray], np.ndarray], part: np.ndarray, sides: np.ndarray | None) -> list[tuple[int, int]]:
    """Pairs (a, b) with `hits`, enough to join all that such pairs join: members reached are compared with those that are not.

    Members of one `part` are joined already. With `sides`, only pairs across the two sides count.
    """
    pairs, left = [], np.arange(n)
    while len(left) > 1:
        own = part[left] == part[left[0]]
        frontier, left = left[own].tolist(), left[~own]
        while frontier and len(left):
            at = frontier.pop()
            here = left if sides is None else left[sides[left] != sides[at]]
            here = here[hits(at, here)] if len(here) else here
            if len(here):
                pairs += [(at, x) for x in here.tolist()]
                reached = np.isin(part[left], part[here])
                frontier += left[reached].tolist()
                left = left[~reached]
    return pairs


Finder = Callable[[list[dict], np.ndarray, "np.ndarray | None"], list[tuple[int, int]]]


def _edges_of(rows: DataFrame, key: list[str], find: Finder) -> DataFrame:
    """Edges (u, v) that `find` gives for each block (key, near, far) of rows, a block in one task."""

    def one(held: list[dict]) -> list[tuple[bytes, bytes]]:
        if len(held) < 2:
            return []
        sides = np.array([r["side"] for r in held]) if held[0]["far"] >= 0 else None
        numbers: dict[bytes, int] = {}
        part = np.array([numbers.setdefault(r["part"], len(numbers)) for r in held])
        return [(held[a]["set"], held[b]["set"]) for a, b in find(held, part, sides) if held[a]["set"] != held[b]["set"]]

    def out(edges: list) -> pa.RecordBatch:
        edges = list(dict.fromkeys(edges))
        return pa.RecordBatch.from_arrays([pa.array([e[i] for e in edges], pa.binary()) for i in (0, 1)], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = [], None
        for batch in batches:
            edges = []
            for row in batch.to_pylist():
                at = tuple(row[k] for k in (*key, "near", "far"))
                if at != last:
                    edges += one(held)
                    held, last = [], at
                held.append(row)
            yield out(edges)
        yield out(one(held))

    by = [*key, "near", "far"]
    return rows.repartition(*by).sortWithinPartitions(*by, "set").mapInArrow(run, "u binary, v binary")


def joined_in_groups(rows: DataFrame, key: list[str], find: Finder, centres: int, split: bool, label: str) -> DataFrame:
    """(node, component) of all that `find` joins within the groups of rows (key, set, n, blocks, ...).

    `n` is the size of a row's group, `blocks` into how many blocks it is dealt; `split` says whether any has several.
    """
    own = F.pmod(F.xxhash64("set", F.lit(5)), F.col("blocks")).cast("int")
    every = F.sequence(F.lit(0), F.col("blocks").cast("int") - 1)
    central = (F.col("blocks") > 1) & (F.pmod(F.xxhash64("set", F.lit(11)), F.col("n")) < centres)
    near = F.explode(F.when(central, every).otherwise(F.array(own)))
    first = rows.withColumn("near", near).withColumns({"far": F.lit(-1), "side": F.lit(0), "part": F.col("set")})
    parts = connected_components(_edges_of(first.drop("n", "blocks"), key, find), label)
    if not split:
        return parts
    parts = stage(parts, label)
    large = rows.where(F.col("blocks") > 1).join(parts.withColumnsRenamed({"node": "set", "component": "part"}), "set", "left").withColumn("part", F.coalesce("part", "set"))
    large = stage(large, label)
    sizes = large.groupBy(*key, "part").agg(F.count("*").alias("n_part"))
    sizes = sizes.groupBy(*key).agg(F.max(F.struct("n_part", "part")).alias("most"), F.sum("n_part").alias("n_all"))
    # members outside the largest part of their group, in blocks of their own, against the members of all blocks
    rest = (F.col("n_all") - F.col("most.n_part")).alias("n_rest")
    sizes = sizes.select(*key, F.col("most.part").alias("main"), rest).where("n_rest > 0")
    sizes = large.groupBy(*key).agg(F.first("n").alias("n"), F.first("blocks").alias("blocks")).join(sizes, key).withColumn("rest_blocks", F.ceil(F.col("n_rest") * F.col("blocks") / F.col("n")))
    sizes = stage(sizes.drop("n", "blocks", "n_rest"), label)
    if sizes.isEmpty():
        return parts
    dealt = large.join(sizes, key)
    rest_own = F.pmod(F.xxhash64("set", F.lit(17)), F.col("rest_blocks")).cast("int")
    rest = dealt.where(F.col("part") != F.col("main")).withColumn("near", rest_own).withColumn("far", F.explode(every)).withColumn("side", F.lit(0))
    rests = F.sequence(F.lit(0), F.col("rest_blocks").cast("int") - 1)
    others = dealt.withColumn("near", F.explode(rests)).withColumn("far", own).withColumn("side", F.lit(1))
    across = _edges_of(rest.unionByName(others).drop("n", "blocks", "rest_blocks", "main"), key, find)
    return connected_components(across.unionByName(parts.select(F.col("node").alias("u"), F.col("component").alias("v"))), label)


def banded(classes: DataFrame, settings: Settings) -> DataFrame:
    """(band, bucket, set) of every class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            rows = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(n, settings.bands, settings.rows)
            with np.errstate(over="ignore"):
                key = np.zeros((n, settings.bands), np.uint64)
                for i in range(settings.rows):
                    key = minhash_forest._mix(key) + rows[:, :, i]
            yield pa.RecordBatch.from_arrays([
                pa.array(np.tile(np.arange(settings.bands, dtype=np.int32), n)), pa.array(key.ravel().view(np.int64)),
                batch.column(0).take(pa.array(np.repeat(np.arange(n), settings.bands))),
            ], ["band", "bucket", "set"])

    return classes.select("set", "signature").mapInArrow(run, "band int, bucket long, set binary")


def _candidate_parts(classes: DataFrame, settings: Settings) -> DataFrame:
    """(node, component) of classes tied by candidates that survive all batches."""
    rows = banded(classes.where(F.col("signature").isNotNull()), settings)
    shared = stage(rows.groupBy("band", "bucket").agg(F.count("*").alias("n")).where("n > 1").withColumn("blocks", F.ceil(F.col("n") / settings.block)), "buckets")
    members = rows.join(shared, ["band", "bucket"]).join(classes.select("set", "signature"), "set")

    def find(held: list[dict], part: np.ndarray, sides: np.ndarray | None) -> list[tuple[int, int]]:
        signatures = np.frombuffer(b"".join(r["signature"] for r in held), np.uint16).reshape(len(held), -1)
        return spanning(len(held), lambda at, here: survivors(signatures[at], signatures[here], settings), part, sides)

    return joined_in_groups(members, ["band", "bucket"], find, settings.centres, not shared.where("blocks > 1").isEmpty(), "ties")


def _verified_parts(docs: DataFrame, classes: DataFrame, ties: DataFrame, settings: Settings) -> DataFrame:
    """(node, component) of classes joined by links that hold on the full sets."""
    found = classes.select("set", "n_shingles", "text_key.*").join(ties.withColumnsRenamed({"node": "set", "component": "tied"}), "set")
    sizes = found.groupBy("tied").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("shingles"))
    blocks = F.greatest(F.ceil(F.col("n") / settings.verify_block), F.ceil(F.col("shingles") / settings.verify_shingles))
    sizes = stage(sizes.select("tied", "n", F.least(F.col("n"), blocks).alias("blocks")), "tied-sizes")
    found = stage(found.drop("n_shingles").join(sizes, "tied"), "tied")
    text = F.col("text").cast("string")
    texts = only_wanted(docs.select(*text_keys(text), text.alias("text")), found, "t1", found.count())
    texts = texts.groupBy("t1", "t2").agg(F.first("text").alias("text"))
    rows = found.hint("merge").join(texts.hint("merge"), ["t1", "t2"]).drop("t1", "t2")
    percent = settings.percent

    def find(held: list[dict], part: np.ndarray, sides: np.ndarray | None) -> list[tuple[int, int]]:
        sets = shingle_sets([r["text"] for r in held], settings.words)
        both = shared_shingles(sets).astype(np.int64)
        size = np.array([len(s) for s in sets], np.int64)
        linked = 100 * both >= percent * (size[:, None] + size[None, :] - both)
        return spanning(len(held), lambda at, here: linked[at, here], part, sides)

    return joined_in_groups(rows, ["tied"], find, settings.centres, not sizes.where("blocks > 1").isEmpty(), "links")


def near_duplicates(docs: DataFrame, settings: Settings | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id (the least doc_id that links reach) and kept of each document (doc_id, text)."""
    settings = settings or Settings()
    signed = stage(minhash_forest.sign(docs, settings.signature), "signatures")
    classes = signed.groupBy("set").agg(
        F.count("*").alias("copies"), F.min("doc_id").alias("first_id"), F.first("signature").alias("signature"),
        F.first("n_shingles").alias("n_shingles"), F.min(F.struct("t1", "t2")).alias("text_key"),
    )
    classes = stage(classes, "classes")
    joined = _verified_parts(docs, classes, _candidate_parts(classes, settings), settings)
    named = classes.select("set", "copies", "first_id", "n_shingles").join(joined.withColumnRenamed("node", "set"), "set", "left").withColumn("component", F.coalesce("component", "set"))
    least = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = stage(named.where("n_shingles > 0").join(least, "component").select("set", "copies", "component_id"), "named")
    # sets that hold over a thousandth of all rows, a thousand at most, go to the rows; the rows of others are merged
    often = max(1000, signed.count() // 1000)
    hot, rare = F.broadcast(named.where(F.col("copies") > often)), named.where(F.col("copies") <= often)
    rows = signed.select("doc_id", "set", "n_shingles")
    full, out = rows.where("n_shingles > 0"), ["doc_id", "n_shingles", "component_id"]
    empty = rows.where("n_shingles = 0").withColumn("component_id", F.col("doc_id"))
    rest = full.join(F.broadcast(hot.select("set")), "set", "left_anti").hint("merge").join(rare.hint("merge"), "set")
    result = full.join(hot, "set").select(*out).unionByName(rest.select(*out)).unionByName(empty.select(*out))
    return result.select("doc_id", F.col("n_shingles").cast("long").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
