"""Language-model scoring by prediction by partial matching over bytes.

The model is a trie of byte contexts of up to `order` bytes with the counts of what followed each in the training
documents. A byte is predicted from its longest context that was seen; where that context never saw the byte, an
escape (method D: each distinct successor gives half a count to the escape) leads to the context one byte shorter,
from which all bytes that the longer one knew are excluded; after the empty context all remaining bytes are alike.
A document is its words in order, A-Z folded, one blank between two, and an end, so its probability is that of its
tokens.

The trie is never in one place. Each byte's probability depends on the `order` + 1 bytes that end with it, its gram:

1. Documents are dealt into chunks by a hash. A chunk gives its distinct grams with their counts, and its distinct
   tokens with theirs, cut into shards: grams by the last two bytes of their context, tokens by hash.
2. Within a shard the lists of `fan_in` chunks are merged into one, and those again, until `fan_in` are left, so that
   no task ever gets more lists than that: a merged list holds distinct grams, and grows as the language does.
3. A shard of grams holds all contexts that end in its byte pairs, hence whole subtrees of the trie down from order
   two; the counts of one-byte contexts, 65,536 at most, go with the task. It works out the log probability of every
   gram asked for. A shard of tokens sums their counts.
4. Answers go down the way the lists came up, to the chunks, which sum them over their documents.

A chunk is about `chunk_mb` of text whatever the input's size, and there are as many shards as the session has
shuffle partitions. A very frequent word or passage is one gram a chunk.

Defined results. Null text: the end alone. Empty text: the same. Null doc_id: kept, split by the empty text. Repeated
rows: counted and scored one by one. No training rows: all counts are 0, all bytes alike. Empty table: no rows. Very
long texts: whole, some megabytes of grams at a time. Other columns of the input are not touched.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crosspanel.llm.common import pack_ints, pack_words, remainder, stage, unpack_ints, unpack_words, words_of

#: The end of a text, and the bytes that can follow a context (all but the blanks other than these two).
END, BLANK = b"\n", b" "
ALPHABET = 252

RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


@dataclass(frozen=True)
class Settings:
    """Length of contexts, the split, and the size of chunks."""

    order: int = 5
    modulus: int = 7
    held_out: int = 2
    chunk_mb: float = 24
    #: Lists of one shard that are merged in one task.
    fan_in: int = 64


def tokens_of(text: str | None) -> list[bytes]:
    """The text's words, A-Z folded."""
    return [x.lower() for x in words_of(text or "")]


def coded(words: list[bytes]) -> bytes:
    """The bytes the model predicts: words, blanks between them, and the end."""
    return BLANK.join(words) + END


def grams_of(texts: list[bytes], order: int) -> np.ndarray:
    """For every byte of the coded texts, in order, the gram that ends with it; before a text stand ends."""
    lead = END * order
    data = np.frombuffer(b"".join(lead + x for x in texts), np.uint8)
    if not len(data):
        return np.zeros(0, np.uint64)
    gram = np.zeros(len(data) - order, np.uint64)
    for i in range(order + 1):
        gram <<= np.uint64(8)
        gram |= data[i : len(data) - order + i]
    sizes = np.array([len(x) for x in texts])
    begin = np.cumsum(sizes + order) - sizes - order
    keep = np.ones(len(gram), bool)
    # grams that would reach from one text over its successor's lead
    for i in range(order):
        at = begin[1:] - order + i
        keep[at] = False
    return gram[keep]


def _counted(values: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values, ascending, and their summed weights."""
    if not len(values):
        return values, np.zeros(0, np.int64)
    if weights is None:
        values = np.sort(values)
    else:
        by = np.argsort(values, kind="stable")
        values, weights = values[by], weights[by]
    first = np.flatnonzero(np.append(True, values[1:] != values[:-1]))
    if weights is None:
        return values[first], np.diff(np.append(first, len(values)))
    return values[first], np.add.reduceat(weights, first)


class _Chunk:
    """Grams and tokens of a chunk's documents."""

    def __init__(self, settings: Settings) -> None:
        self.settings = settings
        self.grams = (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        self.tokens: Counter = Counter()

    def add(self, batch: list[tuple[bool, list[bytes]]]) -> None:
        """(held out, words) of some documents."""
        parts = [self.grams]
        for held in (False, True):
            found = grams_of([coded(words) for h, words in batch if h == held], self.settings.order)
            values, counts = _counted(found)
            parts.append((values, counts * (not held)))
        self.grams = _counted(np.concatenate([x[0] for x in parts]), np.concatenate([x[1] for x in parts]))
        for held, words in batch:
            if held:
                for word in words:
                    self.tokens.setdefault(word, 0)
                self.tokens.setdefault(END, 0)
            else:
                self.tokens.update(words)
                self.tokens[END] += 1

    def rows(self, chunk: int, shards: int) -> Iterator[tuple]:
        """(kind, shard, chunk, first, keys, counts): what each shard gets of the chunk."""
        grams, counts = self.grams
        shard = gram_shard(grams, shards)
        by = np.argsort(shard, kind="stable")
        for a, b in _runs(shard[by]):
            own = by[a:b]
            yield 0, int(shard[own[0]]), chunk, pack_ints(np.diff(grams[own].astype(np.int64), prepend=0)), pack_ints(counts[own])
        words = list(self.tokens)
        shard = np.fromiter((zlib.crc32(x) % shards for x in words), np.int64, len(words))
        by = np.argsort(shard, kind="stable")
        for a, b in _runs(shard[by]):
            own = sorted(words[i] for i in by[a:b])
            yield 1, int(shard[by[a]]), chunk, pack_words(own), pack_ints([self.tokens[x] for x in own])


def gram_shard(grams: np.ndarray, shards: int) -> np.ndarray:
    """Where a gram goes: by the two bytes before its last."""
    with np.errstate(over="ignore"):
        pair = (grams >> np.uint64(8)) & np.uint64(0xFFFF)
        return (((pair + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(shards)).astype(np.int64)


def _runs(sorted_values: np.ndarray) -> list[tuple[int, int]]:
    if not len(sorted_values):
        return []
    first = np.flatnonzero(np.append(True, sorted_values[1:] != sorted_values[:-1]))
    return list(zip(first.tolist(), np.append(first[1:], len(sorted_values)).tolist(), strict=True))


def gram_log_probabilities(grams: np.ndarray, counts: np.ndarray, pairs: np.ndarray, order: int) -> np.ndarray:
    """log10 of each gram's last byte after the rest. All grams that share the two bytes before their last must be here.

    `grams` ascending; `counts` of training; `pairs` the training counts of all two-byte grams, as a 65,536 table.
    """
    n = len(grams)
    out, open_ = np.zeros(n), np.ones(n, bool)
    # excluded at the next level: their summed counts there, and how many they are
    gone_count, gone = np.zeros(n), np.zeros(n)
    levels = []
    for size in range(order + 1, 1, -1):
        if size > 2:
            own, place = np.unique(grams & np.uint64(2 ** (8 * size) - 1 if size < 8 else 2**64 - 1), return_inverse=True)
            count = np.bincount(place, counts, len(own))
        else:
            own = np.arange(65536, dtype=np.uint64)
            place, count = (grams & np.uint64(0xFFFF)).astype(np.int64), pairs.astype(float)
        levels.append((own, place, count))
    single = pairs.reshape(256, 256).sum(0).astype(float)
    levels.append((np.arange(256, dtype=np.uint64), (grams & np.uint64(0xFF)).astype(np.int64), single))
    for level, (own, place, count) in enumerate(levels):
        context, at = np.unique(own >> np.uint64(8), return_inverse=True)
        total = np.bincount(at, count, len(context))
        kinds = np.bincount(at, count > 0, len(context)).astype(float)
        c, mass, distinct = count[place], total[at[place]], kinds[at[place]]
        rest, fresh = mass - gone_count, distinct - gone
        some = open_ & (rest > 0)
        known = some & (c > 0)
        out[known] += np.log10((2 * c[known] - 1) / (2 * rest[known]))
        missed = some & ~known
        out[missed] += np.log10(fresh[missed] / (2 * rest[missed]))
        open_ &= ~known
        if level + 1 == len(levels):
            gone = np.where(distinct > 0, distinct, gone)
            break
        # what this context knows is excluded from the next: its bytes' counts there
        next_own, _, next_count = levels[level + 1]
        width = np.uint64(2 ** (8 * (len(levels) - level - 1)) - 1)
        below = next_count[np.searchsorted(next_own, own & width)] * (count > 0)
        gone_count = np.bincount(at, below, len(context))[at[place]]
        gone = distinct
    left = ALPHABET - gone
    out[open_] -= np.log10(np.maximum(left[open_], 1))
    return out


class _Lists:
    """Keys (grams, or tokens) of some lists of one shard, with summed counts."""

    def __init__(self, kind: int) -> None:
        self.kind = kind
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []
        self.grams, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.tokens: Counter = Counter()

    def add(self, keys: bytes, counts: bytes) -> None:
        """One more list."""
        if self.kind:
            for word, n in zip(unpack_words(keys), unpack_ints(counts).tolist(), strict=True):
                self.tokens[word] += n
            return
        self.parts.append((unpack_grams(keys), unpack_ints(counts)))
        if len(self.parts) == 16:
            self._fold()

    def _fold(self) -> None:
        self.grams, self.counts = _counted(np.concatenate([self.grams, *(x[0] for x in self.parts)]), np.concatenate([self.counts, *(x[1] for x in self.parts)]))
        self.parts = []

    def summed(self) -> tuple:
        """Keys, ascending, and counts."""
        if self.kind:
            words = sorted(self.tokens)
            return words, np.array([self.tokens[x] for x in words], np.int64)
        self._fold()
        return self.grams, self.counts


def unpack_grams(keys: bytes) -> np.ndarray:
    """A packed list of grams."""
    return np.cumsum(unpack_ints(keys)).astype(np.uint64)


def packed(kind: int, keys, counts) -> tuple[bytes, bytes]:
    """A list of one shard, ready to move."""
    return pack_words(keys) if kind else pack_ints(np.diff(keys.astype(np.int64), prepend=0)), pack_ints(counts)


def merge_lists(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One list of the lists of a group (kind, shard, node)."""
    kind, shard, node = (x.as_py() for x in key)
    lists = _Lists(kind)
    for batch in batches:
        for keys, counts in zip(batch.column("keys"), batch.column("counts"), strict=True):
            lists.add(keys.as_py(), counts.as_py())
    keys, counts = packed(kind, *lists.summed())
    row = (kind, shard, node, keys, counts)
    yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, _LIST_TYPES, strict=True)], _LIST_NAMES)


def pass_down(left: pa.Table, right: pa.Table) -> pa.Table:
    """Answers for each list of a group (left), out of the answers for the list they were merged into (right)."""
    out = []
    kind = left.column("kind")[0].as_py()
    above_keys, above = right.column("keys")[0].as_py(), right.column("values")[0].as_py()
    if kind:
        known = dict(zip(unpack_words(above_keys), unpack_ints(above).tolist(), strict=True))
    else:
        grams, found = unpack_grams(above_keys), np.frombuffer(above, np.float32)
    for shard, node, keys in zip(left.column("shard").to_pylist(), left.column("node").to_pylist(), left.column("keys").to_pylist(), strict=True):
        values = pack_ints([known[x] for x in unpack_words(keys)]) if kind else found[np.searchsorted(grams, unpack_grams(keys))].tobytes()
        out.append((kind, shard, node, keys, values))
    return pa.table([pa.array([r[i] for r in out], t) for i, t in enumerate(_LIST_TYPES)], names=[*_LIST_NAMES[:-1], "values"])


_LIST_NAMES = ["kind", "shard", "node", "keys", "counts"]
_LIST_TYPES = (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
LISTS = "kind int, shard int, node int, keys binary, counts binary"
ANSWERS = "kind int, shard int, node int, keys binary, values binary"


def _documents(table: pa.Table, most: int = 3_000_000) -> Iterator[tuple[list, list[bool], list[list[bytes]]]]:
    """ids, held out, words: some megabytes of text at a time."""
    ids, held, words, size = [], [], [], 0
    for doc_id, out, text in zip(table.column("doc_id"), table.column("held_out"), table.column("text"), strict=True):
        text = text.as_py() or ""
        ids.append(doc_id.as_py())
        held.append(out.as_py())
        words.append(tokens_of(text))
        size += len(text)
        if size >= most:
            yield ids, held, words
            ids, held, words, size = [], [], [], 0
    if ids:
        yield ids, held, words


def score_documents(docs: DataFrame, settings: Settings | None = None) -> DataFrame:
    """Base and model score of every document (doc_id, text); see RESULT for the columns."""
    settings = settings or Settings()
    spark = docs.sparkSession
    shards = max(16, int(spark.conf.get("spark.sql.shuffle.partitions")))
    size = docs.agg(F.sum(F.octet_length(F.col("text").cast("string"))).alias("n")).first().n or 0
    n_chunks = max(1, math.ceil(size / (settings.chunk_mb * 1_000_000)))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
        (remainder(F.col("doc_id"), settings.modulus) == settings.held_out).alias("held_out"),
        F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_chunks)).cast("int").alias("chunk"),
    )

    def ask(table: pa.Table) -> pa.Table:
        chunk = _Chunk(settings)
        for _, held, words in _documents(table):
            chunk.add(list(zip(held, words, strict=True)))
        found = list(chunk.rows(table.column("chunk")[0].as_py(), shards))
        return pa.table([pa.array([r[i] for r in found], t) for i, t in enumerate(_LIST_TYPES)], names=_LIST_NAMES)

    # a shard's lists form a tree: list `node` of one level is part of list `node // fan_in` of the next
    levels, nodes, above = [stage(rows.groupBy("chunk").applyInArrow(ask, LISTS), "grams")], n_chunks, F.floor(F.col("node") / settings.fan_in).cast("int")
    while nodes > settings.fan_in:
        groups = levels[-1].select("kind", "shard", above.alias("above"), "keys", "counts").groupBy("kind", "shard", "above")
        levels.append(stage(groups.applyInArrow(merge_lists, LISTS), "merged"))
        nodes = math.ceil(nodes / settings.fan_in)

    def pair_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(65536, np.int64)
        for batch in batches:
            for keys, counts in zip(batch.column(0), batch.column(1), strict=True):
                pair = (unpack_grams(keys.as_py()) & np.uint64(0xFFFF)).astype(np.int64)
                seen += np.bincount(pair, unpack_ints(counts.as_py()), 65536).astype(np.int64)
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(seen[at])], ["pair", "n"])

    # at most 65,536 rows
    counted = levels[-1].where("kind = 0").select("keys", "counts").mapInArrow(pair_counts, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    pairs = np.zeros(65536, np.int64)
    for row in counted.collect():
        pairs[row.pair] = row.n

    def answer(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, shard = (x.as_py() for x in key)
        lists, held = _Lists(kind), []
        for batch in batches:
            for node, keys, counts in zip(batch.column("node").to_pylist(), batch.column("keys").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                lists.add(keys, counts)
                held.append((node, keys))
        all_keys, counts = lists.summed()
        tokens, distinct = (int(counts.sum()), int((counts > 0).sum())) if kind else (0, 0)
        if not kind:
            p = gram_log_probabilities(all_keys, counts, pairs, settings.order).astype(np.float32)
        out = []
        for i, (node, keys) in enumerate(held):
            values = pack_ints([lists.tokens[x] for x in unpack_words(keys)]) if kind else p[np.searchsorted(all_keys, unpack_grams(keys))].tobytes()
            out.append((kind, shard, node, keys, values, 0 if i else tokens, 0 if i else distinct))
        kinds = (*_LIST_TYPES, pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], [*_LIST_NAMES[:-1], "values", "tokens", "distinct"])

    top = stage(levels[-1].groupBy("kind", "shard").applyInArrow(answer, f"{ANSWERS}, tokens long, distinct long"), "answers")
    total = top.agg(F.sum("tokens").alias("tokens"), F.sum("distinct").alias("distinct")).first()
    answered = top.drop("tokens", "distinct")
    for level in levels[-2::-1]:
        below = level.drop("counts").withColumn("above", above).groupBy("kind", "shard", "above")
        answered = stage(below.cogroup(answered.withColumn("above", F.col("node")).groupBy("kind", "shard", "above")).applyInArrow(pass_down, ANSWERS), "answers")
    train_tokens, distinct = total.tokens or 0, total.distinct or 0
    base = math.log10(train_tokens + distinct + 1)

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        grams, values, known = [np.zeros(0, np.uint64)], [np.zeros(0, np.float32)], {}
        for kind, keys, found in zip(right.column("kind").to_pylist(), right.column("keys"), right.column("values"), strict=True):
            if kind == 0:
                grams.append(unpack_grams(keys.as_py()))
                values.append(np.frombuffer(found.as_py(), np.float32))
            else:
                known.update(zip(unpack_words(keys.as_py()), unpack_ints(found.as_py()).tolist(), strict=True))
        grams, values = np.concatenate(grams), np.concatenate(values).astype(float)
        by = np.argsort(grams)
        grams, values = grams[by], values[by]
        log_of = {w: math.log10(c + 1) for w, c in known.items()}
        out = [[] for _ in RESULT.split(", ")]
        for ids, held, words in _documents(left):
            texts = [coded(x) for x in words]
            sums = np.concatenate([[0.0], np.cumsum(values[_found(grams, grams_of(texts, settings.order))])])
            ends = np.cumsum([0] + [len(x) for x in texts])
            for i, (doc_id, h, own) in enumerate(zip(ids, held, words, strict=True)):
                tokens = [*own, END]
                row = (
                    doc_id, h, len(tokens), sum(known[x] > 0 for x in tokens), train_tokens,
                    math.fsum(log_of[x] for x in tokens) - len(tokens) * base, float(sums[ends[i + 1]] - sums[ends[i]]),
                )
                for column, value in zip(out, row, strict=True):
                    column.append(value)
        kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
        return pa.table([pa.array(x, t) for x, t in zip(out, kinds, strict=True)], names=[x.split()[0] for x in RESULT.split(", ")])

    return rows.groupBy("chunk").cogroup(answered.select(F.col("node").alias("chunk"), "kind", "keys", "values").groupBy("chunk")).applyInArrow(finish, RESULT)


def _found(ascending: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Where each wanted value stands; sorted first, so that the search runs along both."""
    by = np.argsort(wanted)
    out = np.empty(len(wanted), np.int64)
    out[by] = np.searchsorted(ascending, wanted[by])
    return out
