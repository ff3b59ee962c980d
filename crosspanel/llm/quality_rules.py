"""Line-first cleaning: rules judge each line, failing lines go, and documents that lose too much text go.

Defined results. Null text: no words, no lines; it fails. Empty text: likewise. Repeated rows: one result a row.
Empty table: no rows. Very long texts: read whole, line by line. Other columns of the input are not touched.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame

from crosspanel.llm.common import BLANKS, words_of

#: The characters that count as symbols.
SYMBOLS = "#*$%&|<>"
#: What may end a sentence, and what may follow that.
ENDINGS = ".!?:;,…。！？\"'”’»)]"
#: Signs between the entries of menus and breadcrumbs.
SEPARATORS = "|»›•·>→/"
#: Phrases of notices that belong to a site and not to its text, in English, German, French and Spanish.
NOTICES = (
    "all rights reserved", "copyright ©", "cookie policy", "privacy policy", "terms of use", "terms of service",
    "lorem ipsum", "enable javascript", "licensed under the", "sign in to", "log in to", "click here to",
    "subscribe to our", "share on facebook", "powered by", "skip to content",
    "alle rechte vorbehalten", "datenschutzerklärung", "cookie-richtlinie", "allgemeine geschäftsbedingungen", "zum inhalt springen", "newsletter abonnieren",
    "tous droits réservés", "mentions légales", "politique de confidentialité", "politique de cookies", "conditions d'utilisation", "aller au contenu", "abonnez-vous à",
    "todos los derechos reservados", "aviso legal", "política de privacidad", "política de cookies", "términos de uso", "saltar al contenido", "suscríbete a",
)

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, n_lines long, n_failed_lines long, kept_share double, clean_text string"
)


@dataclass(frozen=True)
class LineRules:
    """Thresholds of the line rules and of the document verdict."""

    min_words: int = 10
    max_repeat_percent: int = 20
    window: int = 5
    #: Symbols, and marks repeated in a row, for each word of a line.
    max_symbols_per_word: float = 0.25
    #: A line of at least so many words must end as a sentence does, unless it is the last of its paragraph or the
    #: next line goes on in lower case.
    sentence_words: int = 8
    #: Stand-alone separators among the words of a line.
    max_separator_share: float = 0.2
    #: Capitals among the cased letters of a line of at least so many letters.
    max_capital_share: float = 0.6
    capital_letters: int = 12
    #: Share of a document's word characters that must remain.
    min_kept_share: float = 0.7


_RUN = re.compile(r"[!?.,]{2,}")
_NOTICE = re.compile("|".join(map(re.escape, NOTICES)))


def repeated_words(words: list[bytes], window: int = 5) -> int:
    """Words that lie in a window of `window` words found twice or more in the text."""
    if len(words) <= window:
        return 0
    grams = list(zip(*(words[i:] for i in range(window)), strict=False))
    if len(set(grams)) == len(grams):
        return 0
    seen = Counter(grams)
    covered = end = 0
    for at, gram in enumerate(grams):
        if seen[gram] > 1:
            covered += at + window - max(at, end)
            end = at + window
    return covered


def duplicate_lines(lines: list[str]) -> int:
    """Lines with a word that equal an earlier line."""
    with_words = [x for x in lines if x.strip(BLANKS)]
    return len(with_words) - len(set(with_words))


def line_fails(line: str, rules: LineRules) -> str | None:
    """The first rule that a line with words fails, taken by itself: symbols, navigation, boilerplate, capitals or punctuation."""
    n = len(words_of(line))
    marks = sum(map(line.count, SYMBOLS))
    if "!!" in line or "??" in line or "..." in line or ",," in line:
        marks += len(_RUN.findall(line))
    separators = sum(line.count(f" {x} ") for x in SEPARATORS)
    if separators > 1 and separators > rules.max_separator_share * n:
        return "navigation"
    if marks > rules.max_symbols_per_word * n:
        return "symbols"
    lowered = line.lower()
    if _NOTICE.search(lowered):
        return "boilerplate"
    if lowered != line:
        capitals = sum(map(str.isupper, line))
        if capitals >= rules.capital_letters and capitals > rules.max_capital_share * sum(map(str.isalpha, line)):
            return "capitals"
    if n >= rules.sentence_words and line.rstrip(BLANKS)[-1] not in ENDINGS:
        return "punctuation"
    return None


def judge(text: str | None, rules: LineRules) -> tuple:
    """Base measures, verdict and cleaned text of one document."""
    text = text or ""
    words = words_of(text)
    lines = text.split("\n")
    word_chars = len(text) - sum(map(text.count, BLANKS))
    n_repeat = repeated_words(words, rules.window)
    failed = len(words) < rules.min_words or 100 * n_repeat > rules.max_repeat_percent * len(words)
    passed, bad = [], 0
    for at, line in enumerate(lines):
        if not line.strip(BLANKS):
            continue
        why = line_fails(line, rules)
        if why == "punctuation":
            after = lines[at + 1].strip(BLANKS) if at + 1 < len(lines) else ""
            if not after or after[0].islower():  # a paragraph may break off, and a sentence may go on
                why = None
        if why:
            bad += 1
        else:
            passed.append(line)
    clean = "\n".join(passed)
    share = (len(clean) - sum(map(clean.count, BLANKS))) / word_chars if word_chars else 0.0
    return (
        len(words), word_chars, sum(map(text.count, SYMBOLS)), duplicate_lines(lines), n_repeat, failed,
        not failed and share >= rules.min_kept_share, len(passed) + bad, bad, share, clean,
    )


def clean_lines(docs: DataFrame, rules: LineRules | None = None, with_text: bool = True) -> DataFrame:
    """Measures, verdict and cleaned text for each document (doc_id, text). One pass, no shuffle."""
    rules = rules or LineRules()
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    keep = names if with_text else names[:-1]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [judge(t, rules) for t in batch["text"]]
            out = pd.DataFrame(rows, columns=names[1:])
            out.insert(0, "doc_id", batch["doc_id"].astype("Int64"))
            yield out[keep]

    schema = ", ".join(x for x in SCHEMA.split(", ") if x.split()[0] in keep)
    return docs.select("doc_id", "text").mapInPandas(run, schema)
