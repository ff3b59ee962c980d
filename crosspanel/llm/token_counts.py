"""Token counts: pieces are counted once per distinct pre-token and summed over each document's pre-token frequencies.

A piece model of this kind never joins a blank to what stands before it, so a text falls apart, exactly, into
pre-tokens: a run of blanks and what follows up to the next blank. No ids are made of any text.

1. Each task reads documents in chunks and keeps the chunk's distinct pre-tokens and every document's frequencies.
2. The distinct pre-tokens of all chunks meet by hash in shards; each shard counts each of its pre-tokens once.
3. The counts go back to the chunks that asked, and are summed by document.

A chunk ends after `chunk_words` distinct pre-tokens or `chunk_entries` frequencies, so memory is bounded whatever
the documents hold; a pre-token that is everywhere costs one entry a chunk. There are about as many shards as
chunks, so a shard holds about as much as a chunk.

Defined results. Null text: counted as empty, 0 bytes and 0 tokens. Null doc_id: kept. Repeated rows: one result a
row. Empty table: no rows. One very long text: a chunk of its own. Other columns of the input are not touched.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crosspanel.llm.common import pack_ints, pack_words, stage, unpack_ints, unpack_words

#: The blank, and the sign the model writes for it.
BLANK, SIGN = " ", "▁"

_RUNS = re.compile(" *[^ ]*")

CHUNKS = "chunk long, doc_ids array<long>, n_bytes array<long>, ends array<int>, word_at binary, freq binary, n_words long, words array<struct<first: long, shard: int, words: binary>>"
_PART = pa.struct([("first", pa.int64()), ("shard", pa.int32()), ("words", pa.binary())])
_CHUNKS = pa.schema([
    ("chunk", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("n_bytes", pa.list_(pa.int64())), ("ends", pa.list_(pa.int32())),
    ("word_at", pa.binary()), ("freq", pa.binary()), ("n_words", pa.int64()), ("words", pa.list_(_PART)),
])
_RESULT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])


def pretokens(text: str) -> list[str]:
    """The text's pre-tokens. The model puts one blank before any text, which is left off the first of them."""
    if not text:
        return []
    if SIGN in text:
        text = text.replace(SIGN, BLANK)
    if "  " not in text and text[-1] != BLANK and text[0] != BLANK:
        return text.split(BLANK)  # the blank before each is understood
    return [x[1:] for x in _RUNS.findall(BLANK + text) if x]


class _Chunk:
    """Documents under way: their frequencies of the chunk's distinct pre-tokens."""

    def __init__(self) -> None:
        self.ids, self.sizes, self.ends = [], [], []
        self.at, self.freq = array("i"), array("i")
        self.words: dict[str, int] = {}

    def add(self, doc_id: int | None, text: str) -> None:
        counts = Counter(pretokens(text))
        words = self.words
        self.at.extend([words.setdefault(x, len(words)) for x in counts])
        self.freq.extend(counts.values())
        self.ids.append(doc_id)
        self.sizes.append(len(text.encode("utf-8", "surrogatepass")))
        self.ends.append(len(self.at))

    def row(self, number: int, shards: int) -> pa.RecordBatch:
        """Pre-tokens in the order of their hash, cut by shard; places in each document ascending, as differences."""
        words = [x.encode("utf-8", "surrogatepass") for x in self.words]
        hashes = np.fromiter(map(zlib.crc32, words), np.uint64, len(words))
        order = np.argsort(hashes, kind="stable")
        rank = np.empty(len(words), np.int64)
        rank[order] = np.arange(len(words))
        shard = (hashes[order] * np.uint64(shards)) >> np.uint64(32)
        cuts = np.flatnonzero(np.diff(shard.astype(np.int64), prepend=-1)).tolist()
        parts = [
            {"first": a, "shard": int(shard[a]), "words": pack_words([words[i] for i in order[a:b]])}
            for a, b in zip(cuts, [*cuts[1:], len(words)], strict=True)
        ]
        ends = np.array(self.ends, np.int64)
        doc = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
        at, freq = rank[np.array(self.at, np.int64)], np.array(self.freq, np.int64)
        by = np.argsort(doc * (len(words) + 1) + at)
        at = at[by]
        steps = np.diff(at, prepend=0)
        begin = np.concatenate([[0], ends[:-1]])[np.diff(ends, prepend=0) > 0]
        steps[begin] = at[begin]
        row = [number, self.ids, self.sizes, ends, pack_ints(steps), pack_ints(freq[by]), len(words), parts]
        return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, _CHUNKS, strict=True)], schema=_CHUNKS)


def read_chunks(docs: DataFrame, shards: int, chunk_words: int, chunk_entries: int) -> DataFrame:
    """Documents in chunks: a row a chunk, its distinct pre-tokens by shard and each document's frequencies of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, chunk = TaskContext.get().partitionId() << 32, _Chunk()
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                chunk.add(doc_id.as_py(), text.as_py() or "")
                if len(chunk.words) >= chunk_words or len(chunk.at) >= chunk_entries:
                    yield chunk.row(number, shards)
                    number, chunk = number + 1, _Chunk()
        if chunk.ids:
            yield chunk.row(number, shards)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, CHUNKS)


def count_pieces(model, words: list[str]) -> list[int]:
    """Pieces of each pre-token (its first blank left off), as they stand inside a text."""
    found = model.encode(words, num_threads=1)
    out = list(map(len, found))
    for i, word in enumerate(words):
        if not word:  # a blank alone, which the library takes for no text
            out[i] = len(model.encode("\n ")) - len(model.encode("\n"))
    return out


def count_tokens(docs: DataFrame, model_path: str, limit: int = 4096, shards: int | None = None, chunk_words: int = 400_000, chunk_entries: int = 2_000_000) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of each document (doc_id, text)."""
    shards = shards or max(64, 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    chunks = stage(read_chunks(docs, shards, chunk_words, chunk_entries), "token-chunks")

    def count(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        known: dict[bytes, int] = {}
        for batch in batches:
            counts = []
            for packed in batch.column("words"):
                words = unpack_words(packed.as_py())
                fresh = [x for x in words if x not in known]
                known.update(zip(fresh, count_pieces(model, [x.decode("utf-8", "surrogatepass") for x in fresh]), strict=True))
                counts.append(pack_ints([known[x] for x in words]))
            yield pa.RecordBatch.from_arrays([batch.column("chunk"), batch.column("first"), pa.array(counts, pa.binary())], ["chunk", "first", "counts"])

    def total(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {f.name: [] for f in _RESULT}
        for row in left.to_pylist():
            pieces = np.zeros(row["n_words"], np.int64)
            for first, packed in zip(right.column("first").to_pylist(), right.column("counts"), strict=True):
                counts = unpack_ints(packed.as_py())
                pieces[first : first + len(counts)] = counts
            freq, ends = unpack_ints(row["freq"]), np.array(row["ends"], np.int64)
            steps = unpack_ints(row["word_at"])
            begin = np.concatenate([[0], ends[:-1]])
            # running places, started anew at each document
            run = np.cumsum(steps)
            before = np.concatenate([[0], run])[begin]
            at = run - np.repeat(before, ends - begin)
            n = np.diff(np.concatenate([[0], np.cumsum(pieces[at] * freq)])[np.concatenate([[0], ends])])
            out["doc_id"] += row["doc_ids"]
            out["n_bytes"] += row["n_bytes"]
            out["n_tokens"] += n.tolist()
            out["over_limit"] += (n > limit).tolist()
        return pa.table(out, schema=_RESULT)

    asked = chunks.select("chunk", F.explode("words").alias("part")).select("chunk", "part.first", "part.shard", "part.words")
    counted = asked.groupBy("shard").applyInArrow(count, "chunk long, first long, counts binary")
    return (
        chunks.drop("words").groupBy("chunk").cogroup(counted.groupBy("chunk"))
        .applyInArrow(total, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
    )
