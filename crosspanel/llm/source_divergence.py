"""Source divergence audit: how far the word use of each source is from every other of its language, and by which words.

1. One pass counts the terms of each (lang, source) and the documents that hold them; each task merges its counts before
   they are shuffled, so a source or a word that is everywhere is a few rows a task.
2. Terms in enough documents of their language are its vocabulary, dealt by hash into chunks of bounded size, where each
   gets a slot. A group's counts of a chunk are packed into one vector.
3. The groups of a language are dealt by hash into blocks, and each vector is sent to the tile of its block with every
   block: a tile is one task, which reads the two blocks' vectors chunk after chunk and adds up its part of the matrix
   of all pairs. What a tile holds is two blocks' counts of one chunk and that part, whatever the corpus.

Shares are whole numbers of 10^9ths: p = 1 + floor(10^9 (count + 5) / (N + 5 V)), exact by long division.

Defined results. Null text, lang or source: ''. A group without terms, and a language without a vocabulary, still give
their pairs. Repeated rows count as often as they are there. Empty table: no rows. Very long texts count whole; a task
passes its counts on whenever they reach `held` entries. Other columns of the input are not touched.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crosspanel.llm.common import pack_ints, stage, unpack_ints

#: Shares count in 10^9ths, with this much added to every count.
WHOLE, ADDED = 1_000_000_000, 5

#: What no term holds becomes a blank, A-Z become a-z: bytes of UTF-8, where all others of 128 and above are term bytes.
_FOLD = bytes(x + 32 if 65 <= x <= 90 else x if x >= 128 or 97 <= x <= 122 else 32 for x in range(256))


@dataclass(frozen=True)
class Settings:
    """Which terms count, and the sizes of chunks and blocks."""

    least_documents: int = 30
    top_terms: int = 50
    chunk_terms: int = 8192
    block_groups: int = 64
    #: Entries that a task holds before it passes its counts on.
    held: int = 500_000


def terms_of(text: str | None) -> list[bytes]:
    """The terms `[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+` of a text, A-Z folded, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


def count_terms(docs: DataFrame, settings: Settings) -> DataFrame:
    """(lang, source, term, count, docs), each possibly in several rows; a row with a null term for every group there is."""
    schema = "lang string, source string, term string, count long, docs long"

    def rows(counts: dict, held: dict) -> Iterator[pa.RecordBatch]:
        for (lang, source), own in counts.items():
            terms, n = list(own), len(own) + 1  # the last row stands for the group itself
            docs = list(map(held[lang, source].__getitem__, terms))
            columns = [pa.array([*terms, None], pa.binary()).cast(pa.string()), pa.array([*own.values(), 0], pa.int64()), pa.array([*docs, 0], pa.int64())]
            yield pa.RecordBatch.from_arrays([*(pa.repeat(pa.scalar(x, pa.string()), n) for x in (lang, source)), *columns], ["lang", "source", "term", "count", "docs"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, held, size = defaultdict(Counter), defaultdict(Counter), 0
        for batch in batches:
            for group in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                words, group = terms_of(group[2].as_py()), group[:2]
                before = len(counts[group])
                counts[group].update(words)
                held[group].update(set(words))
                size += 1 + len(counts[group]) - before
                if size >= settings.held:
                    yield from rows(counts, held)
                    counts, held, size = defaultdict(Counter), defaultdict(Counter), 0
        yield from rows(counts, held)

    text = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")]
    return docs.select(*text).mapInArrow(run, schema)


def share(count: Column, total: Column, n_terms: Column) -> Column:
    """1 + floor(10^9 (count + 5) / (total + 5 n_terms)), whole numbers throughout; null without terms."""
    over = (F.lit(WHOLE).cast("decimal(38,0)") * (count + ADDED).cast("decimal(19,0)")).cast("decimal(38,0)")
    under = (total + ADDED * n_terms).cast("decimal(38,0)")
    return F.when(n_terms > 0, 1 + F.call_function("div", over, under))


def shares(counts: np.ndarray, totals: np.ndarray, n_terms: int) -> np.ndarray:
    """The same for rows of counts, by long division three digits at a time, so that nothing leaves 64 bits."""
    rest, under = counts.astype(np.int64) + ADDED, (totals.astype(np.int64) + ADDED * n_terms).reshape(-1, *[1] * (counts.ndim - 1))
    out = np.zeros(counts.shape, np.int64)
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // under
        rest %= under
    return out + 1


def _tables(docs: DataFrame, settings: Settings) -> tuple[DataFrame, DataFrame]:
    """Counts of kept terms (lang, source, term, count, lang_count, chunk, slot, chunk_terms), and the groups (lang, source,
    total, n_terms, lang_total)."""
    counts = count_terms(docs, settings).groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))
    counts = stage(counts, "term-counts")
    kept = counts.where("term is not null").groupBy("lang", "term").agg(F.sum("count").alias("lang_count"), F.sum("docs").alias("docs"))
    kept = stage(kept.where(F.col("docs") >= settings.least_documents).drop("docs"), "kept-terms")
    # as many chunks for every language as all terms together fill, so that no language's terms meet in one task
    chunk = F.pmod(F.xxhash64("term"), F.lit(max(1, -(-kept.count() // settings.chunk_terms)))).cast("int")
    within = Window.partitionBy("lang", "chunk")
    slots = kept.withColumn("chunk", chunk).withColumn("slot", F.row_number().over(within.orderBy("term")) - 1)
    slots = stage(slots.withColumn("chunk_terms", F.count("*").over(within)), "vocabulary")
    found = stage(counts.drop("docs").join(slots, ["lang", "term"]), "kept-counts")
    sizes = kept.groupBy("lang").agg(F.sum("lang_count").alias("lang_total"), F.count("*").alias("n_terms"))
    totals = found.groupBy("lang", "source").agg(F.sum("count").alias("total"))
    groups = counts.where("term is null").select("lang", "source").join(totals, ["lang", "source"], "left").join(sizes, "lang", "left")
    return found, stage(groups.fillna(0, ["total", "n_terms", "lang_total"]), "groups")


def _packed(found: DataFrame) -> DataFrame:
    """One row for each group and chunk with terms of it: slots and counts, packed."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = [[pack_ints([x[k] for x in own]) for own in batch.column("own").to_pylist()] for k in ("slot", "count")]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], *(pa.array(x, pa.binary()) for x in packed)], ["lang", "source", "chunk", "chunk_terms", "slots", "counts"])

    own = found.groupBy("lang", "source", "chunk").agg(F.first("chunk_terms").alias("chunk_terms"), F.collect_list(F.struct("slot", "count")).alias("own"))
    rows = own.select("lang", "source", "chunk", F.col("chunk_terms").cast("int").alias("chunk_terms"), "own")
    return rows.mapInArrow(pack, "lang string, source string, chunk int, chunk_terms int, slots binary, counts binary")


def _tile(heads: list[dict], chunks: Iterator[list[dict]]) -> list[tuple[str, str, str, int]]:
    """(lang, source, item, value) of all pairs across the two sides of a tile, or within its one block.

    `heads` are the groups, `chunks` the vectors of one chunk of the vocabulary at a time, both in order.
    """
    lang, n_terms = heads[0]["lang"], heads[0]["n_terms"]
    sides = [[h for h in heads if h["side"] == s] for s in (0, 1)] if heads[0]["near"] != heads[0]["far"] else [heads, heads]
    totals = [np.array([h["total"] for h in side], np.int64) for side in sides]
    place = [{h["source"]: i for i, h in enumerate(side)} for side in sides]
    if not all(map(len, sides)):
        return []
    matrix, seen = np.zeros((len(sides[0]), len(sides[1])), np.int64), 0
    none = [shares(np.zeros(len(t), np.int64), t, n_terms) for t in totals] if n_terms else None
    for vectors in chunks:
        width = vectors[0]["chunk_terms"]
        dense = [np.zeros((len(side), width), np.int64) for side in (sides[:1] if sides[0] is sides[1] else sides)]
        for v in vectors:
            slots, counts = unpack_ints(v["slots"]), unpack_ints(v["counts"])
            s = 0 if sides[0] is sides[1] else v["side"]
            dense[s][place[s][v["source"]], slots] = counts
        p = shares(dense[0], totals[0], n_terms)
        q = p if sides[0] is sides[1] else shares(dense[1], totals[1], n_terms)
        for i, row in enumerate(p):
            matrix[i] += np.abs(q - row).sum(1)
        seen += width
    if n_terms:
        matrix += (n_terms - seen) * np.abs(none[0][:, None] - none[1][None, :])  # chunks of which neither side has a term
    out = []
    for i, a in enumerate(sides[0]):
        for j, b in enumerate(sides[1]):
            if a["source"] != b["source"]:
                out.append((lang, a["source"], b["source"], int(matrix[i, j])))
                if sides[0] is not sides[1]:
                    out.append((lang, b["source"], a["source"], int(matrix[i, j])))
    return out


def pair_values(found: DataFrame, groups: DataFrame, settings: Settings) -> DataFrame:
    """(lang, source, item, value) for every two groups of a language, tile by tile."""
    n_blocks = groups.groupBy("lang").agg(F.ceil(F.count("*") / settings.block_groups).cast("int").alias("blocks"))
    own = groups.drop("lang_total").join(n_blocks, "lang").withColumn("own", F.pmod(F.xxhash64("source"), F.col("blocks")).cast("int"))
    nothing = {"chunk": F.lit(-1), "chunk_terms": F.lit(0), "slots": F.lit(None).cast("binary"), "counts": F.lit(None).cast("binary")}
    vectors = _packed(found).join(own, ["lang", "source"])
    rows = own.withColumns(nothing).unionByName(vectors).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select(
        "lang", F.least("own", "other").alias("near"), F.greatest("own", "other").alias("far"), "chunk", "source", F.when(F.col("own") > F.col("other"), 1).otherwise(0).alias("side"),
        "total", "n_terms", "chunk_terms", "slots", "counts",
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flat = (row for batch in batches for row in batch.to_pylist())
        row = next(flat, None)
        while row is not None:
            key, heads = (row["lang"], row["near"], row["far"]), []
            while row is not None and (row["lang"], row["near"], row["far"]) == key and row["chunk"] < 0:
                heads.append(row)
                row = next(flat, None)

            def chunks(key: tuple = key) -> Iterator[list[dict]]:
                nonlocal row
                while row is not None and (row["lang"], row["near"], row["far"]) == key:
                    at, own = row["chunk"], []
                    while row is not None and (row["lang"], row["near"], row["far"], row["chunk"]) == (*key, at):
                        own.append(row)
                        row = next(flat, None)
                    yield own

            vectors = chunks()
            out = _tile(heads, vectors)
            for _ in vectors:  # a tile with one side only has read none
                pass
            kinds = (pa.string(), pa.string(), pa.string(), pa.int64())
            for at in range(0, len(out), 10_000):
                part = out[at : at + 10_000]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in part], k) for i, k in enumerate(kinds)], ["lang", "source", "item", "value"])

    dealt = rows.repartition("lang", "near", "far").sortWithinPartitions("lang", "near", "far", "chunk")
    return dealt.mapInArrow(run, "lang string, source string, item string, value long")


def term_values(found: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value) for every kept term that a group uses more than its language does."""
    rows = found.join(groups, ["lang", "source"])
    p, q = share(F.col("count"), F.col("total"), F.col("n_terms")), share(F.col("lang_count"), F.col("lang_total"), F.col("n_terms"))
    return rows.select("lang", "source", F.col("term").alias("item"), (p - q).alias("value")).where("value > 0")


def divergence(docs: DataFrame, settings: Settings | None = None) -> DataFrame:
    """lang, source, part, item, value and rank of documents (lang, source, text).

    Part `pair` has every other source of the language with the summed distance of all shares; part `term` the terms
    that most set a source apart from its language, at most `top_terms`.
    """
    settings = settings or Settings()
    found, groups = _tables(docs, settings)
    by = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    rank = F.row_number().over(by)
    pairs = pair_values(found, groups, settings).withColumn("rank", rank).withColumn("part", F.lit("pair"))
    terms = term_values(found, groups).withColumn("rank", rank).where(F.col("rank") <= settings.top_terms).withColumn("part", F.lit("term"))
    return pairs.unionByName(terms).select("lang", "source", "part", "item", "value", "rank")
