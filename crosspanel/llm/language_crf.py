"""Language identification by a linear-chain conditional random field over words.

Every word carries a weight for each language, the sum of learned weights of its affixes, its character n-grams and
itself (the lexicon); learned transitions tie neighbouring words. Forward-backward gives each word's probability of
each language, so text that switches language is labelled word by word; a document's language is the one with the
largest share of its words' letters. A word over 32 characters, as texts without blanks are made of, counts as
consecutive words of 24 characters each; their n-grams run on across the cuts.

Fitting takes a bounded sample: `per_language` documents of each language by a hash of their id, and of each at most
`sample_words` consecutive words, cut where the documents lie. Sequences for training are put together from stretches of several documents, so
that the transitions learn how often text stays in a language. Prediction takes whole texts, in one pass without a
shuffle. Within a batch, texts are cut into segments that are chained exactly, so a very long text costs memory in
proportion to its length and no recursion.

Defined results. Null text, empty text and text without a letter: `und`, score 0. No labelled rows at all: `und`,
score 0 for every row. Ties go to the language that sorts first. Repeated rows: one result a row. Empty table: no
rows. Other columns of the input are not touched.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crosspanel.llm.common import remainder

UNKNOWN = "und"

#: Longer words are cut to parts of PART characters.
LONGEST, PART = 32, 24
SIGNS = ".,;:!?\"'()[]{}<>|*$%&#-–—…«»“”‘’0123456789"


@dataclass(frozen=True)
class Settings:
    """Bounds of the fitting sample, the size of the feature table and how it is learned."""

    per_language: int = 500
    sample_words: int = 300
    table_bits: int = 17
    longest_gram: int = 4
    sequence: int = 48
    stretch: int = 16
    batch: int = 128
    rounds: int = 160
    rate: float = 0.3
    segment: int = 64
    #: Parts that each language's documents are ranked in first.
    salts: int = 32


def bare(word: str) -> str:
    """A word as features see it: lower case, without signs at its ends; '' if it has no letter."""
    word = word.lower().strip(SIGNS)
    return word if any(map(str.isalpha, word)) else ""


def words_in(text: str, longest_gram: int) -> list[str | tuple[str, str, bool, bool]]:
    """Words of a text. A long one comes as parts: own characters, those after them that grams run into, is first, is last."""
    words = text.split()
    if not words or max(map(len, words)) <= LONGEST:
        return words
    out: list = []
    for x in words:
        if len(x) <= LONGEST:
            out.append(x)
            continue
        for at in range(0, len(x), PART):
            end = at + PART
            out.append((x[at:end], x[end : end + longest_gram - 1], at == 0, end >= len(x)))
    return out


def form_of(word: str | tuple[str, str, bool, bool]) -> tuple[str, int]:
    """What features are taken from, with the word's ends marked ('' if it has no letter), and the letters it counts for."""
    if isinstance(word, str):
        word = bare(word)
        return (f"^{word}$", len(word)) if word else ("", 0)
    own, more, first, last = word
    letters = len(bare(own))
    form = (own + more).lower()
    form = "^" + form.lstrip(SIGNS) if first else form
    form = form.rstrip(SIGNS) + "$" if last else form
    return (form, letters) if letters else ("", 0)


def feature_rows(forms: list[str], settings: Settings) -> np.ndarray:
    """Rows of the weight table for each form: its n-grams (affixes among them, by the marks at its ends) and itself. 0: none."""
    width = max(2, *map(len, forms))
    codes = np.array(forms, dtype=f"U{width}").view(np.uint32).reshape(len(forms), width).astype(np.uint64)
    size, mask = codes.shape[1], np.uint64((1 << settings.table_bits) - 1)
    length = np.array(list(map(len, forms)))
    with np.errstate(over="ignore"):
        mix = lambda h: (((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(40)) & mask
        out, h = [], np.zeros_like(codes)
        for n in range(1, settings.longest_gram + 1):
            h = h[:, : size - n + 1] * np.uint64(1_000_003) + codes[:, n - 1 :]
            if n == 1:
                continue
            rows = np.maximum(mix(h + np.uint64(n)), np.uint64(1))
            out.append(np.where(np.arange(rows.shape[1]) <= (length - n)[:, None], rows, 0))
            if size == n:
                break
        whole = np.zeros(len(forms), np.uint64)
        for i in range(size):
            whole = np.where(i < length, whole * np.uint64(16_777_619) + codes[:, i], whole)
        out.append(np.maximum(mix(whole + np.uint64(77)), np.uint64(1))[:, None])
    rows = np.concatenate(out, axis=1).astype(np.int32)
    rows[[not x for x in forms]] = 0
    return rows


@dataclass
class Model:
    """Languages, weights of features, and transition weights."""

    settings: Settings
    languages: list[str]
    weights: np.ndarray
    moves: np.ndarray

    def word_weights(self, forms: list[str]) -> np.ndarray:
        """Each form's weight for each language."""
        out = np.zeros((len(forms), len(self.languages)))
        for at in range(0, len(forms), 4096):
            part = forms[at : at + 4096]
            out[at : at + len(part)] = self.weights[feature_rows(part, self.settings)].sum(1)
        return out


def forward_backward(scores: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of sequences of equal length: scores (sequences, words, labels), moves (labels, labels).

    Gives each word's probability of each label, and each pair of neighbours' probability of each pair of labels.
    """
    n, size, k = scores.shape
    local, step = np.exp(scores - scores.max(2, keepdims=True)), np.exp(moves - moves.max())
    ahead, back = np.empty((n, size, k)), np.empty((n, size, k))
    x = np.ones((n, k))
    for t in range(size):
        x = (x @ step if t else x) * local[:, t]
        x /= x.sum(1, keepdims=True)
        ahead[:, t] = x
    x = np.ones((n, k))
    for t in range(size - 1, -1, -1):
        back[:, t] = x
        x = (x * local[:, t]) @ step.T
        x /= x.sum(1, keepdims=True)
    both = ahead * back
    pairs = ahead[:, :-1, :, None] * step * (local * back)[:, 1:, None, :]
    return both / both.sum(2, keepdims=True), pairs / pairs.sum((2, 3), keepdims=True)


def chained_marginals(scores: np.ndarray, ends: np.ndarray, moves: np.ndarray, segment: int) -> np.ndarray:
    """Marginals of the words of many texts, one after another in `scores`, text i ending before ends[i].

    Texts are cut into segments. A first pass gives each segment's transfer matrix, the matrices chain along each
    text, and a second pass fills in every segment from what enters it on either side. The result is exact.
    """
    k = scores.shape[1]
    starts = np.concatenate([[0], ends[:-1]])
    sizes = ends - starts
    parts = -(-sizes // segment)
    text = np.repeat(np.arange(len(ends)), parts)
    first = np.concatenate([[0], np.cumsum(parts)[:-1]])
    number = np.arange(len(text)) - first[text]
    begin = starts[text] + number * segment
    width = np.minimum(segment, ends[text] - begin)
    at = np.minimum(begin[:, None] + np.arange(segment), max(len(scores) - 1, 0))
    there = np.arange(segment) < width[:, None]
    local = np.exp(scores - scores.max(1, keepdims=True))[at]
    local[~there] = 1.0
    step = np.exp(moves - moves.max())
    n = len(text)
    # a segment's matrix: from the label before it to its last label
    through = np.broadcast_to(np.eye(k), (n, k, k)).copy()
    for t in range(segment):
        new = (through.reshape(-1, k) @ step).reshape(n, k, k) * local[:, t, None, :]
        new /= new.max((1, 2), keepdims=True)
        through = np.where(there[:, t, None, None], new, through)
    enter, leave = np.ones((n, k)), np.ones((n, k))
    for j in range(1, int(parts.max(initial=0))):
        own = first[parts > j] + j
        x = np.einsum("nk,nkl->nl", enter[own - 1], through[own - 1]) if j > 1 else _first(local[own - 1], there[own - 1], step)
        enter[own] = x / x.sum(1, keepdims=True)
    for j in range(int(parts.max(initial=0)) - 2, -1, -1):
        own = first[parts > j + 1] + j
        x = np.einsum("nkl,nl->nk", through[own + 1], leave[own + 1])
        leave[own] = x / x.sum(1, keepdims=True)
    ahead, x = np.empty((segment, n, k)), enter
    for t in range(segment):
        new = np.where((number == 0)[:, None], x, x @ step) * local[:, t] if t == 0 else (x @ step) * local[:, t]
        x = np.where(there[:, t, None], new / new.sum(1, keepdims=True), x)
        ahead[t] = x
    x = leave
    for t in range(segment - 1, -1, -1):
        ahead[t] *= x
        new = (x * local[:, t]) @ step.T
        x = np.where(there[:, t, None], new / new.sum(1, keepdims=True), x)
    both = ahead.transpose(1, 0, 2)[there]
    return both / both.sum(1, keepdims=True)


def _first(local: np.ndarray, there: np.ndarray, step: np.ndarray) -> np.ndarray:
    """What leaves the first segment of a text, into which nothing enters."""
    x = np.ones((len(local), local.shape[2]))
    for t in range(local.shape[1]):
        new = (x @ step if t else x) * local[:, t]
        x = np.where(there[:, t, None], new / new.sum(1, keepdims=True), x)
    return x


def fit_model(texts: list[str], langs: list[str], settings: Settings | None = None) -> Model:
    """Learn weights and transitions by gradient steps (AdaGrad) on the conditional likelihood."""
    settings = settings or Settings()
    languages = sorted(set(langs))
    k, rng = len(languages), np.random.default_rng(11)
    known: dict[str, int] = {"": 0}
    stretches: list[list[np.ndarray]] = [[] for _ in languages]
    for text, lang in zip(texts, langs, strict=True):
        words = words_in(text, settings.longest_gram)
        if len(words) > settings.sample_words:
            at = int(rng.integers(len(words) - settings.sample_words + 1))
            words = words[at : at + settings.sample_words]
        ids = np.array([known.setdefault(form_of(x)[0], len(known)) for x in words], int)
        for at in range(0, len(ids), settings.stretch):
            stretches[languages.index(lang)].append(ids[at : at + settings.stretch])
    model = Model(settings, languages, np.zeros((1 << settings.table_bits, k)), np.zeros((k, k)))
    usable = [i for i in range(k) if stretches[i]]
    if k < 2 or not usable:
        return model
    rows = feature_rows(list(known), settings)
    seen_w, seen_m = np.full_like(model.weights, 1e-6), np.full((k, k), 1e-6)
    for _ in range(settings.rounds):
        words = np.zeros((settings.batch, settings.sequence), int)
        labels = np.zeros((settings.batch, settings.sequence), int)
        for i in range(settings.batch):
            at, lang = 0, usable[rng.integers(len(usable))]
            while at < settings.sequence:
                piece = stretches[lang][rng.integers(len(stretches[lang]))][: settings.sequence - at]
                words[i, at : at + len(piece)], labels[i, at : at + len(piece)] = piece, lang
                at += max(1, len(piece))
                if rng.random() < 0.3:
                    lang = usable[rng.integers(len(usable))]
        distinct, place = np.unique(words, return_inverse=True)
        place = place.reshape(words.shape)
        own = rows[distinct]
        scores = model.weights[own].sum(1)
        p, pairs = forward_backward(scores[place], model.moves)
        miss = p - np.eye(k)[labels]
        moved = pairs.sum((0, 1)) - np.eye(k)[labels[:, :-1]].reshape(-1, k).T @ np.eye(k)[labels[:, 1:]].reshape(-1, k)
        by_word = np.stack([np.bincount(place.ravel(), miss[..., j].ravel(), len(distinct)) for j in range(k)], 1)
        slope = np.stack([np.bincount(own.ravel(), np.repeat(by_word[:, j], own.shape[1]), len(model.weights)) for j in range(k)], 1) / settings.batch
        slope[0] = 0
        seen_w += slope**2
        model.weights -= settings.rate * slope / np.sqrt(seen_w)
        moved = moved / settings.batch + 0.01 * model.moves
        seen_m += moved**2
        model.moves -= settings.rate * moved / np.sqrt(seen_m)
    model.weights = model.weights.astype(np.float32)
    return model


def label_words(model: Model, texts: list[str | None], cache: dict, table: list) -> tuple[list[list], np.ndarray, np.ndarray]:
    """Words of each text, the marginals of all of them, and each word's letters. `cache` and `table` keep words' weights."""
    split = [words_in(t or "", model.settings.longest_gram) for t in texts]
    fresh = list({w for words in split for w in words if w not in cache})
    if not table or len(cache) + len(fresh) > 200_000:  # words are cheap to weigh again
        cache.clear()
        table[:] = [np.zeros((0, len(model.languages))), np.zeros(0, int)]
        fresh = list({w for words in split for w in words})
    if fresh:
        forms, letters = zip(*map(form_of, fresh), strict=True)
        distinct = list(dict.fromkeys(forms))
        place = dict(zip(distinct, range(len(distinct)), strict=True))
        new = model.word_weights(distinct)[[place[x] for x in forms]]
        cache.update(zip(fresh, range(len(cache), len(cache) + len(fresh)), strict=True))
        table[:] = [np.concatenate([table[0], new]), np.concatenate([table[1], letters])]
    at = np.fromiter((cache[w] for words in split for w in words), int, sum(map(len, split)))
    if not len(at):
        return split, np.zeros((0, len(model.languages))), at
    ends = np.cumsum([len(x) for x in split if x])
    return split, chained_marginals(table[0][at], ends, model.moves, model.settings.segment), table[1][at]


def predict(model: Model | None, texts: list[str | None], cache: dict | None = None, table: list | None = None) -> tuple[list[str], list[float]]:
    """Language and its share of the letters, for each text."""
    if model is None or not model.languages:
        return [UNKNOWN] * len(texts), [0.0] * len(texts)
    split, p, letters = label_words(model, texts, {} if cache is None else cache, [] if table is None else table)
    langs, scores, at = [], [], 0
    mass = np.concatenate([np.zeros((1, len(model.languages))), np.cumsum(p * letters[:, None], axis=0)])
    for words in split:
        total = mass[at + len(words)] - mass[at]
        at += len(words)
        best = int(np.argmax(np.round(total, 9)))
        langs.append(model.languages[best] if total.sum() > 0.5 else UNKNOWN)
        scores.append(float(min(1.0, max(0.0, total[best] / total.sum()))) if total.sum() > 0.5 else 0.0)
    return langs, scores


def _excerpt(text: str, words: int) -> str:
    """At most so many consecutive words of a text, from a place that its checksum chooses; long words count as several."""
    place, split = zlib.crc32(text.encode("utf-8", "surrogatepass")), text.split()
    if len(split) > words:
        at = place % (len(split) - words + 1)
        split = split[at : at + words]
    text = " ".join(split)
    most = words * PART
    at = place % (len(text) - most + 1) if len(text) > most else 0
    return text[at : at + most]


def fit(docs: DataFrame, settings: Settings | None = None, modulus: int = 3, held_out: int = 1) -> Model | None:
    """A model from documents (doc_id, text, lang) outside the held-out split; reads a bounded sample of them."""
    settings = settings or Settings()
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (remainder(F.col("doc_id"), modulus) != held_out))
    # rows may repeat an id, and a language may hold most rows: a bounded share of each of its salts comes to its ranking
    rows = rows.select("doc_id", "lang", F.xxhash64("doc_id", "text").alias("row"), "text")
    ids = rows.drop("text").withColumn("salt", F.pmod(F.xxhash64("row", F.lit(3)), F.lit(settings.salts)))
    for group, most in ((("lang", "salt"), -(-2 * settings.per_language // settings.salts)), (("lang",), settings.per_language)):
        by = Window.partitionBy(*group).orderBy("row", "doc_id")
        ids = ids.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= most).drop("rank")
    excerpt = F.pandas_udf(lambda texts: pd.Series([_excerpt(x, settings.sample_words) for x in texts]), "string")
    chosen = rows.join(F.broadcast(ids.select("lang", "row").distinct()), ["lang", "row"], "left_semi")
    chosen = chosen.dropDuplicates(["lang", "row"]).select("doc_id", "lang", "row", excerpt("text").alias("text"))
    sample = chosen.orderBy("doc_id", "lang", "row").toPandas()
    if sample.empty:
        return None
    return fit_model(list(sample["text"]), list(sample["lang"]), settings)


def language_column(model: Model | None, text: Column) -> Column:
    """struct(lang_pred, score) of a text column."""

    @F.pandas_udf("lang_pred string, score double")
    def language(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        cache: dict = {}
        table: list = []
        for texts in batches:
            langs, scores, at = [], [], 0
            texts = [x if isinstance(x, str) else None for x in texts]
            while at < len(texts):  # some megabytes at a time
                end, size = at, 0
                while end < len(texts) and (end == at or size < 1_000_000):
                    size += len(texts[end] or "")
                    end += 1
                more = predict(model, texts[at:end], cache, table)
                langs += more[0]
                scores += more[1]
                at = end
            yield pd.DataFrame({"lang_pred": langs, "score": np.array(scores, float)})

    return language(text)


def identify(docs: DataFrame, model: Model | None, modulus: int = 3, held_out: int = 1) -> DataFrame:
    """doc_id, held_out, lang_pred and score of each document (doc_id, text)."""
    found = docs.select("doc_id", (remainder(F.col("doc_id"), modulus) == held_out).alias("held_out"), language_column(model, F.col("text")).alias("found"))
    return found.select("doc_id", "held_out", "found.lang_pred", "found.score")
