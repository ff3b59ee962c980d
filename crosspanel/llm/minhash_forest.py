"""N-gram Jaccard join by a MinHash LSH forest, with exact verification.

Documents are sets of shingles (five words; all words of a shorter text), A-Z folded. Documents with one and the same
set are one class, and classes are what is compared.

1. Every class has a signature of `trees` x `depth` minima. A tree is the trie of all signatures' paths in it; sorted,
   classes that share a prefix stand together. Within each subtree below the shortest prefix that can be needed, matches
   are looked for at the longest prefix first: classes that share it and whose signatures agree enough are tied. A class
   whose ties so far are of such similarity that prefixes of this length find the recall asked for stops there; the
   others go on to prefixes one shorter, down to the length at which pairs of the least similarity are found with that
   recall. Members tied already are not compared again, so a group of near copies costs about its size. Groups beyond
   `block` members are dealt into blocks and all pairs of blocks compared.
2. Components of those ties hold every pair found. The texts of each component meet, in blocks and pairs of blocks
   where there are many or long ones, and the Jaccard similarity of all pairs there is computed exactly from the sets.
   What comes out is each class's number of links and a spanning star for each block, never the pairs.
3. Components of the verified links give the classes of documents.

Nothing is sampled, capped or dropped. Only texts of classes with a tie are shuffled: most others are held back by a
bitmap of the keys asked for.

Defined results. Null or empty text: no words; all such documents are one set, hence copies of each other. Null
doc_id: kept; a component's id is its least non-null id. Repeated rows: copies. One id with several texts: each row
goes by its own text. Empty table: no rows. Very long
texts: all shingles count. Other columns of the input are not touched.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crosspanel.llm.common import BLANKS, only_wanted, sorted_out, stage
from crosspanel.llm.components import connected_components


@dataclass(frozen=True)
class Settings:
    """Shingles, the similarity asked for, and the shape of the forest."""

    words: int = 5
    similarity: float = 0.8
    recall: float = 0.999
    trees: int = 16
    depth: int = 6
    #: Standard errors by which a signature may understate the similarity of a pair still compared exactly.
    slack: float = 4.5
    block: int = 8192
    #: Texts, and shingles of them, that a block of a component holds.
    verify_block: int = 1024
    verify_shingles: int = 1_000_000

    def found(self, similarity, length: int):
        """Share of pairs of a similarity that have a prefix of this length in common in some tree."""
        return 1 - (1 - similarity**length) ** self.trees

    def shortest(self) -> int:
        """The longest prefix at which pairs of the similarity asked for are found with the recall asked for."""
        return next((k for k in range(self.depth, 1, -1) if self.found(self.similarity, k) >= self.recall), 1)

    def least_agreement(self) -> int:
        """Equal minima below which a pair is not tied."""
        n, s = self.trees * self.depth, self.similarity
        return max(1, int(np.ceil(n * (s - self.slack * np.sqrt(s * (1 - s) / n)))))


_RNG = np.random.default_rng(20_240_229)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_PLACE = _RNG.integers(1, 2**63, 4096, dtype=np.uint64) | np.uint64(1)
_ORDER = _RNG.integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)
_FACTOR = _RNG.integers(1, 2**63, 4096, dtype=np.uint64) | np.uint64(1)
_SHIFT = _RNG.integers(1, 2**63, 4096, dtype=np.uint64)
_IS_BLANK = np.zeros(256, bool)
_IS_BLANK[[ord(x) for x in BLANKS]] = True
#: Words hashed at a time: a character takes some sixty bytes meanwhile.
_WORDS = 1 << 15


def _mix(h: np.ndarray) -> np.ndarray:
    """A finaliser: all bits depend on all bits."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_sets(texts: list[str | None], words: int = 5) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    raw = [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts]
    data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    blank = _IS_BLANK[data]
    edge = np.diff(blank.astype(np.int8), prepend=1)
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    ends = ends[-len(starts) :] if len(starts) else starts
    stops = np.cumsum([len(x) + 1 for x in raw])
    first = np.searchsorted(starts, np.concatenate([[0], stops[:-1]]))
    last = np.append(first[1:], len(starts))
    empty = np.zeros(0, np.uint64)
    if not len(starts):
        return [empty] * len(texts)
    with np.errstate(over="ignore"):
        word = np.empty(len(starts), np.uint64)
        for at in range(0, len(starts), _WORDS):
            here, size = starts[at : at + _WORDS], ends[at : at + _WORDS] - starts[at : at + _WORDS]
            inside = here[0] + np.flatnonzero(~blank[here[0] : here[-1] + size[-1]])
            place = inside - np.repeat(here, size)
            own = _BYTE[data[inside]] * _PLACE[place & 4095] + place.astype(np.uint64)
            begin = np.concatenate([[0], np.cumsum(size)[:-1]])
            word[at : at + _WORDS] = _mix(np.add.reduceat(_mix(own), begin) + size.astype(np.uint64))
        n = len(word)
        gram = np.zeros(max(n - words + 1, 0), np.uint64)
        for i in range(words):
            gram += word[i : n - words + 1 + i] * _ORDER[i]
        gram = _mix(gram)
        out = []
        for a, b in zip(first.tolist(), last.tolist(), strict=True):
            if b - a >= words:
                out.append(np.unique(gram[a : b - words + 1]))
            elif b > a:
                out.append(_mix((word[a:b] * _ORDER[: b - a]).sum(keepdims=True) + np.uint64(b - a)))
            else:
                out.append(empty)
    return out


def signature(shingles: np.ndarray, size: int) -> np.ndarray:
    """Minima of `size` hash functions over a set, 16 bits of each."""
    least = np.full(size, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(shingles), 4096):
            part = shingles[at : at + 4096, None] * _FACTOR[None, :size] + _SHIFT[None, :size]
            least = np.minimum(least, (part ^ (part >> np.uint64(32))).min(0))
    return (_mix(least) & np.uint64(0xFFFF)).astype(np.uint16)


def _batches(texts: pa.Array, most: int = 1_000_000) -> Iterator[tuple[int, list]]:
    """Some megabytes of text at a time."""
    at, values = 0, texts
    while at < len(values):
        part, size = [], 0
        while at + len(part) < len(values) and (not part or size < most):
            part.append(values[at + len(part)].as_py())
            size += len(part[-1] or "")
        yield at, part
        at += len(part)


def text_keys(text: Column) -> list[Column]:
    """Two hashes of a text that stand for it."""
    return [F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(7), text).alias("t2")]


def sign(docs: DataFrame, settings: Settings) -> DataFrame:
    """doc_id, set (a digest of the document's shingle set), its size, the signature, and keys of the text. One pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in _batches(batch.column(1)):
                sets = shingle_sets(texts, settings.words)
                own = batch.slice(at, len(texts))
                yield pa.RecordBatch.from_arrays([
                    own.column(0), pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                    pa.array([len(s) for s in sets], pa.int32()),
                    pa.array([signature(s, settings.trees * settings.depth).tobytes() if len(s) else None for s in sets], pa.binary()), own.column(2), own.column(3),
                ], ["doc_id", "set", "n_shingles", "signature", "t1", "t2"])

    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), *text_keys(text))
    return rows.mapInArrow(run, "doc_id long, set binary, n_shingles int, signature binary, t1 long, t2 long")


def prefixes(classes: DataFrame, settings: Settings) -> DataFrame:
    """(tree, prefix, set) for every class and tree, prefix the shortest that can be needed."""
    k, trees = settings.shortest(), settings.trees

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            paths = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(n, trees, settings.depth)[:, :, :k]
            with np.errstate(over="ignore"):
                key = np.zeros((n, trees), np.uint64)
                for i in range(k):
                    key = (key << np.uint64(16) if k <= 4 else _mix(key)) + paths[:, :, i]
            yield pa.RecordBatch.from_arrays([
                pa.array(np.tile(np.arange(trees, dtype=np.int32), n)), pa.array(key.ravel().view(np.int64)),
                batch.column(0).take(pa.array(np.repeat(np.arange(n), trees))),
            ], ["tree", "prefix", "set"])

    return classes.select("set", "signature").mapInArrow(run, "tree int, prefix long, set binary")


def _tied_in_run(run: np.ndarray, signatures: np.ndarray, least: int, group: np.ndarray, done: np.ndarray, sides: np.ndarray | None) -> list[tuple[int, int, int]]:
    """Ties (a, b, equal minima) that join groups of a run of members, which share a prefix.

    Each member is compared with those not reached yet, unless both are done. With `sides`, only pairs across the two
    sides count.
    """
    ties, left = [], run
    while len(left) > 1:
        own = group[left] == group[left[0]]
        frontier, left = left[own].tolist(), left[~own]
        while frontier and len(left):
            at = frontier.pop()
            here = left[~done[left]] if done[at] else left
            if sides is not None:
                here = here[sides[here] != sides[at]]
            agree = (signatures[here] == signatures[at]).sum(1)
            hit = agree >= least
            if hit.any():
                ties += [(at, x, n) for x, n in zip(here[hit].tolist(), agree[hit].tolist(), strict=True)]
                reached = np.isin(group[left], group[here[hit]])
                frontier += left[reached].tolist()
                left = left[~reached]
    return ties


def tied(signatures: np.ndarray, tree: int, settings: Settings, sides: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Ties among members of one subtree, looked for at prefixes from the longest to the shortest that each member needs."""
    n, least = len(signatures), settings.least_agreement()
    if n == 2:
        apart = sides is not None and sides[0] == sides[1]
        return [] if apart or (signatures[0] == signatures[1]).sum() < least else [(0, 1)]
    paths = signatures.reshape(n, settings.trees, settings.depth)[:, tree]
    order = np.lexsort(paths.T[::-1])
    same = paths[order[1:]] == paths[order[:-1]]
    shared = np.where(same.all(1), settings.depth, same.argmin(1))  # minima that neighbours in the sorted trie have in common
    group, done = np.arange(n), np.zeros(n, bool)
    found, looked_for = np.zeros(n), np.zeros(n)
    ties = []
    for length in range(settings.depth, settings.shortest() - 1, -1):
        new = []
        for run in np.split(order, np.flatnonzero(shared < length) + 1):
            if len(run) > 1 and not done[run].all() and (group[run] != group[run[0]]).any():
                new += _tied_in_run(run, signatures, least, group, done, sides)
        for a, b, agree in new:
            group[group == group[b]] = group[a]
            share = settings.found(agree / signatures.shape[1], length)
            for x in (a, b):
                found[x] += 1
                looked_for[x] += 1 / share
        ties += [(a, b) for a, b, _ in new]
        done = (found > 0) & (found >= settings.recall * looked_for)
        if (group == group[0]).all():
            break
    return ties


def candidate_ties(members: DataFrame, settings: Settings) -> DataFrame:
    """Edges (u, v) among members (tree, prefix, near, far, side, set, signature), each group in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key = [], None

        def out(rows: list, key: tuple | None) -> list[tuple[bytes, bytes]]:
            if len(rows) < 2:
                return []
            x = np.frombuffer(b"".join(r[1] for r in rows), np.uint16).reshape(len(rows), -1)
            sides = np.array([r[2] for r in rows]) if key[2] != key[3] else None
            return [(rows[a][0], rows[b][0]) for a, b in tied(x, key[0], settings, sides)]

        for batch in batches:
            edges = []
            keys = zip(*(batch.column(x).to_pylist() for x in ("tree", "prefix", "near", "far")), strict=True)
            for k, row in zip(keys, zip(*(batch.column(x).to_pylist() for x in ("set", "signature", "side")), strict=True), strict=True):
                if k != key:
                    edges += out(held, key)
                    held, key = [], k
                held.append(row)
            yield _edges(edges)
        yield _edges(out(held, key))

    return members.sortWithinPartitions("tree", "prefix", "near", "far").mapInArrow(run, "u binary, v binary")


def _edges(edges: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
    edges = list(dict.fromkeys(edges))
    return pa.RecordBatch.from_arrays([pa.array([e[i] for e in edges], pa.binary()) for i in (0, 1)], ["u", "v"])


def in_blocks(rows: DataFrame, key: list[str], blocks: Column) -> DataFrame:
    """Deal groups into as many blocks as `blocks` says and repeat each block for each other: near, far and side.

    A group of n blocks has each row n times; groups of one block stay as they are.
    """
    n = F.greatest(F.lit(1), blocks.cast("int"))
    own = F.pmod(F.xxhash64("set", F.lit(5)), n).cast("int")
    other = F.explode(F.sequence(F.lit(0), n - 1))
    dealt = rows.withColumn("own", own).withColumn("other", other)
    return dealt.select(
        *key, *(x for x in rows.columns if x not in key), F.least("own", "other").alias("near"), F.greatest("own", "other").alias("far"),
        F.when(F.col("own") > F.col("other"), 1).otherwise(0).alias("side"),
    )


def shared_shingles(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets."""
    n = len(sets)
    flat = np.concatenate(sets) if n else np.zeros(0, np.uint64)
    by = np.argsort(flat, kind="stable")
    flat = flat[by]
    edge = np.flatnonzero(np.append(True, flat[1:] != flat[:-1])) if len(flat) else np.zeros(0, int)
    count = np.diff(np.append(edge, len(flat)))
    owner = np.repeat(np.arange(n, dtype=np.int32), [len(s) for s in sets])[by]
    del flat, by
    out = np.zeros((n, n), np.float32)
    cells, few = out.reshape(-1), 12
    for c in np.unique(count[(count > 1) & (count <= few)]):  # shingles of few sets, pair by pair
        at = edge[count == c]
        for i in range(c):
            first = owner[at + i].astype(np.int64) * n
            for j in range(i + 1, c):
                np.add.at(cells, first + owner[at + j], np.float32(1))
    many = np.flatnonzero(count > few)
    out += out.T
    for at in range(0, len(many), 2048):  # the rest as products of membership tables
        part = many[at : at + 2048]
        table = np.zeros((n, len(part)), np.float32)
        for column, m in enumerate(part):
            table[owner[edge[m] : edge[m] + count[m]], column] = 1
        out += table @ table.T
    np.fill_diagonal(out, [len(s) for s in sets])
    return out


def verify(groups: DataFrame, settings: Settings) -> DataFrame:
    """Exact links among the texts of each group: (set, links, peer), links counted in documents, peer a tie to another set."""
    schema = "set binary, links long, peer binary"

    def check(held: dict[bytes, tuple[np.ndarray, int, int]], across: bool) -> list[tuple]:
        ids, sets = list(held), [s for s, _, _ in held.values()]
        copies, side = (np.array([x[k] for x in held.values()]) for k in (1, 2))
        size = np.array([len(s) for s in sets], float)
        both = shared_shingles(sets)
        linked, links = np.zeros(both.shape, bool), np.zeros(len(ids), np.int64)
        for at in range(0, len(ids), 128):  # some rows at a time: tables of doubles are large
            own = slice(at, at + 128)
            linked[own] = both[own] >= settings.similarity * (size[own, None] + size[None, :] - both[own]) - 1e-6
            if across:
                linked[own] &= side[own, None] != side[None, :]
        np.fill_diagonal(linked, False)
        for at in range(0, len(ids), 128):
            links[at : at + 128] = linked[at : at + 128] @ copies
        out, left = [], np.arange(len(ids))
        peer: dict[int, int] = {}
        while len(left):
            frontier, left = [int(left[0])], left[1:]
            while frontier and len(left):
                at = frontier.pop()
                hit = linked[at, left]
                peer.update((int(x), at) for x in left[hit])
                frontier += left[hit].tolist()
                left = left[~hit]
        for i, n in enumerate(links.tolist()):
            if n:
                out.append((ids[i], n, ids[peer[i]] if i in peer else None))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, key = {}, None  # sets take the place of their texts at once: of each, its shingles, copies and side
        for batch in batches:
            found = []
            keys = list(zip(*(batch.column(x).to_pylist() for x in ("component", "near", "far")), strict=True))
            rows = list(zip(*(batch.column(x).to_pylist() for x in ("set", "copies", "side")), strict=True))
            for at, texts in _batches(batch.column("text")):
                for i, s in enumerate(shingle_sets(texts, settings.words), at):
                    if keys[i] != key:
                        found += check(held, key[1] != key[2]) if len(held) > 1 else []
                        held, key = {}, keys[i]
                    name, copies, side = rows[i]
                    if name not in held and hashlib.blake2b(s.tobytes(), digest_size=16).digest() == name:  # one text for each set
                        held[name] = s, copies, side
            yield _links(found)
        yield _links(check(held, key[1] != key[2]) if len(held) > 1 else [])

    return groups.sortWithinPartitions("component", "near", "far").mapInArrow(run, schema)


def _links(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.binary(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["set", "links", "peer"])


def _classes(docs: DataFrame, settings: Settings) -> tuple[DataFrame, DataFrame]:
    """Signed documents, and of each set of theirs: its component, copies, links, and the component's least id and row."""
    signed = stage(sign(docs, settings), "signatures")
    classes = signed.groupBy("set").agg(
        F.count("*").alias("copies"), F.min("doc_id").alias("first_id"), F.first("signature").alias("signature"), F.first("n_shingles").alias("n_shingles"),
        F.min(F.struct("t1", "t2")).alias("text_key"), F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "t1", "t2")).alias("first_row"),
    )
    classes = stage(classes, "classes")
    rows = prefixes(classes.where(F.col("signature").isNotNull()), settings)
    shared = rows.groupBy("tree", "prefix").agg(F.count("*").alias("n")).where(F.col("n") > 1)
    members = rows.join(shared, ["tree", "prefix"]).join(classes.select("set", "signature"), "set")
    dealt = in_blocks(members, ["tree", "prefix"], F.ceil(F.col("n") / settings.block)).repartition("tree", "prefix", "near", "far")
    ties = candidate_ties(dealt, settings)
    found = connected_components(ties, "ties").withColumnRenamed("node", "set")
    wanted = classes.select("set", "copies", "n_shingles", "text_key").join(found, "set")
    sizes = wanted.groupBy("component").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("shingles"))
    wanted = stage(wanted.join(sizes, "component").select("*", "text_key.*").drop("text_key", "n_shingles"), "wanted")
    text = F.col("text").cast("string")
    # copies of a text become one where they lie; a merge join at every size: which texts are wanted grows with the input
    texts = only_wanted(docs.select(*text_keys(text), text.alias("text")), wanted, "t1", wanted.count()).groupBy("t1", "t2").agg(F.first("text").alias("text"))
    texts = wanted.hint("merge").join(texts.hint("merge"), ["t1", "t2"]).drop("t1", "t2")
    blocks = F.greatest(F.ceil(F.col("n") / settings.verify_block), F.ceil(F.col("shingles") / settings.verify_shingles))
    groups = in_blocks(texts, ["component"], blocks).repartition("component", "near", "far")
    links = stage(verify(groups, settings), "links")
    tally = links.groupBy("set").agg(F.sum("links").alias("links"))
    joined = connected_components(links.where(F.col("peer").isNotNull()).select(F.col("set").alias("u"), F.col("peer").alias("v")), "links-joined")
    of_set = classes.select("set", "copies", "first_id", "first_row").join(tally, "set", "left").join(joined.withColumnRenamed("node", "set"), "set", "left")
    of_set = of_set.withColumn("component", F.coalesce("component", "set"))
    least = of_set.groupBy("component").agg(F.min("first_id").alias("class_id"), F.min("first_row").alias("row"))
    return signed, of_set.join(least, "component").select("set", "component", "copies", "class_id", "row", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))


def similar_documents(docs: DataFrame, settings: Settings | None = None) -> DataFrame:
    """doc_id, class_id and n_links of each document (doc_id, text).

    class_id is the least doc_id among all documents tied to it by links; n_links counts the other documents whose
    similarity is at least the one asked for, copies included.
    """
    signed, named = _classes(docs, settings or Settings())
    named = stage(named.select("set", "copies", "class_id", "n_links"), "named")
    # sets that hold over a thousandth of all rows, a thousand at most, go to the rows; the rows of others are merged
    often = max(1000, signed.count() // 1000)
    hot = F.broadcast(named.where(F.col("copies") > often))
    rows, out = signed.select("doc_id", "set"), ["doc_id", "class_id", "n_links"]
    rest = rows.join(F.broadcast(hot.select("set")), "set", "left_anti").join(named.where(F.col("copies") <= often).hint("merge"), "set")
    return rows.join(hot, "set").select(*out).unionByName(rest.select(*out))


def distinct_documents(docs: DataFrame, settings: Settings | None = None) -> DataFrame:
    """One row of each class of similar documents, with all its columns: the one with the least id, then by its text's hash.

    Every row goes by its own text: rows that share an id but not a text are told apart, rows without an id are
    compared like others, and of rows with one id and text the one stays whose columns, as JSON text, come first. Rows
    that no other row is like, told by a bitmap, are kept where they lie; only the others are shuffled.
    """
    signed, named = _classes(docs, settings or Settings())
    named = stage(named.select("set", "component", "row", "n_links", "copies"), "named")
    of_set, alike = F.xxhash64("set").alias("s1"), named.where("n_links > 0")
    n_sets, n_rows = alike.agg(F.count("*"), F.coalesce(F.sum("copies"), F.lit(0))).first()
    shared = only_wanted(signed.select(of_set, "t1"), alike.select(of_set), "s1", n_sets)
    rows = docs.select(F.struct("*").alias("document"), F.col("doc_id").cast("long").alias("doc_id"), *text_keys(F.col("text").cast("string")))
    open_, alone = sorted_out(rows, shared, "t1", n_rows)
    keep = named.select("component", "row.doc_id", "row.t1", "row.t2").distinct().select(F.col("doc_id").alias("id"), F.col("t1").alias("k1"), F.col("t2").alias("k2"))
    found = open_.hint("merge").join(keep.hint("merge"), open_["doc_id"].eqNullSafe(keep["id"]) & (open_["t1"] == keep["k1"]) & (open_["t2"] == keep["k2"]), "left_semi")
    one = found.groupBy("doc_id", "t1", "t2").agg(F.min_by("document", F.to_json("document")).alias("document"))
    return one.select("document.*").unionByName(alone.select("document.*"))
