"""The operators against brute force, exact round trips and held-out accuracy, with the odd inputs that tables hold."""

import hashlib
import html.parser
import itertools
import math
import random
import re
import time
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from crosspanel.llm import compression_quality, cover_tree, html_text, language_crf, minhash_forest, mixing, packing, ppm, quality_rules, registry, token_counts
from crosspanel.llm.common import pack_ints, pack_words, table, unpack_ints, unpack_words

SF = "/root/testdata/sf0.001"
ODD = [
    (1, None), (2, ""), (3, "   \n\t "), (None, "a text without an id, but with some words in it."), (4, "word"), (5, "é 日本語 \U0001f600 <|endoftext|> ▁x  y"),
    (6, "same text twice over here."), (7, "same text twice over here."), (7, "same text twice over here."), (8, "long " * 4000), (9, "x" * 9000), (10, "\x00\x01 nul"),
]


def odd(spark, rows=ODD):
    """Odd documents, with columns that clash with the operators' own."""
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumns({c: F.lit(7) for c in ("chunk", "score", "held_out", "shard", "set", "rank", "part", "n_tokens", "probability")})


def documents(spark):
    return table(spark, SF, "documents")


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def test_packed_columns():
    for values in ([], [0], [3, 1, 2**31 - 1], [-5, 2**40]):
        assert unpack_ints(pack_ints(values)).tolist() == values
    words = [b"", b"a", "é".encode() * 50]
    assert unpack_words(pack_words(words)) == words and unpack_words(pack_words([])) == []


# line-first rules


def brute_base(text):
    words = [w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", text or "")]
    grams = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {j for i in range(len(words) - 4) if grams[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if line.strip(" \t\n\x0b\x0c\r"):
            dup += line in seen
            seen.add(line)
    n = len(words)
    return n, sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), dup, len(covered), n < 10 or 100 * len(covered) > 20 * n


def test_quality_rules_base(spark):
    for docs in (odd(spark), documents(spark)):
        texts = {(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()}
        got = Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in rows_of(quality_rules.clean_lines(docs)))
        assert set(got) == {(i, *brute_base(t)) for i, t in texts} and sum(got.values()) == docs.count()


def test_quality_rules_verdict(spark):
    rules = quality_rules.LineRules()
    good = "This is a line of plain words that ends well.\n" "Another line follows, and it says something else.\nA third one closes the text here."
    for text, kept in ((good, True), (good.upper(), False), ("Home | About | News | Contact | Help | More\n" "one | two | three | four | five | six", False), (good.replace(" ", "$$$ "), False)):
        assert quality_rules.judge(text, rules)[6] is kept
    assert quality_rules.judge(good + "\nAll rights reserved by the owner.", rules)[-1] == good
    wrapped = "This is a long sentence that somebody has wrapped by hand\nafter some sixty characters, as mail programs and old\nweb pages used to do. It ends here.\n\nA second paragraph that just breaks off after quite a few words"
    assert quality_rules.judge(wrapped, rules)[6] and quality_rules.judge(wrapped + "\n", rules)[6] and quality_rules.judge(wrapped + "\n\n", rules)[6]
    listed = "\n".join(f"Entry number {i} of a list of links without any end mark" for i in "abcdefgh")
    assert not quality_rules.judge(listed, rules)[6]
    for notice in ("Alle Rechte vorbehalten.", "Tous droits réservés.", "Todos los derechos reservados.", "Copyright © 2020."):
        assert quality_rules.judge(good + "\n" + notice, rules)[-1] == good
    labelled = documents(spark).join(table(spark, SF, "labels"), "doc_id")
    found = quality_rules.clean_lines(labelled).select("doc_id", "kept", "base_failed").join(table(spark, SF, "labels"), "doc_id").where("not base_failed").toPandas()
    assert (found.kept == (found.quality == 1)).mean() > 0.95
    assert quality_rules.clean_lines(odd(spark).limit(0)).count() == 0


# prediction by partial matching


def brute_ppm(train, text, order):
    contexts = defaultdict(Counter)
    for t in train:
        s = ppm.END * order + t
        for i in range(order, len(s)):
            for k in range(order + 1):
                contexts[s[i - k : i]][s[i]] += 1
    s, total = ppm.END * order + text, 0.0
    for i in range(order, len(s)):
        gone = set()
        for k in range(order, -1, -1):
            after = {x: n for x, n in contexts.get(s[i - k : i], {}).items() if x not in gone}
            if not after:
                continue
            mass = sum(after.values())
            if s[i] in after:
                total += math.log10((2 * after[s[i]] - 1) / (2 * mass))
                break
            total += math.log10(len(after) / (2 * mass))
            gone |= set(after)
        else:
            total -= math.log10(ppm.ALPHABET - len(gone))
    return total


def test_ppm_scores(spark):
    rng = random.Random(1)
    docs = [(i, " ".join("".join(rng.choice("abC") for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(0, 25)))) for i in range(60)]
    df = odd(spark, docs + [(200, None), (None, "zebra"), (201, "abc abc"), (201, "abc abc")])
    settings = ppm.Settings(order=3, chunk_mb=1)
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    train = [ppm.tokens_of(t) for i, t in rows if not held(i)]
    counts = Counter(w for x in train for w in [*x, ppm.END])
    n, v = sum(counts.values()), len(counts)
    got = sorted(rows_of(ppm.score_documents(df, settings)), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0))
    want = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    assert len(got) == len(want)
    for r, (i, t) in zip(got, want, strict=True):
        tokens = [*ppm.tokens_of(t), ppm.END]
        assert (r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (i, held(i), len(tokens), sum(counts[w] > 0 for w in tokens), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens))
        assert r["score"] == pytest.approx(brute_ppm([ppm.coded(x) for x in train], ppm.coded(ppm.tokens_of(t)), 3), abs=1e-4)
    assert ppm.score_documents(df.limit(0)).count() == 0
    # with lists merged over several levels
    tree = sorted(rows_of(ppm.score_documents(df, ppm.Settings(order=3, chunk_mb=0.0003, fan_in=2))), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0))
    assert [{**r, "score": round(r["score"], 3)} for r in tree] == [{**r, "score": round(r["score"], 3)} for r in got]


# HTML


@pytest.mark.parametrize("page, text", [
    (None, ""), ("", ""), ("plain  text", "plain text"), ("a < b & c", "a < b & c"), ("<p>one<p>two", "one\n\ntwo"), ("x<script>var a='</p>';</script>y", "xy"),
    ("<div>a</div><div>b</div>", "a\nb"), ("<ul><li>a<li>b<ol start=3><li>c</ol></ul>", "- a\n- b\n  3. c"), ("a<br>b<br><br>c", "a\nb\n\nc"),
    ("<p hidden>no</p><p style='display: none'>no</p>yes", "yes"), ("<table><tr><th>Name<th>N<tr><td>alpha<td>1</table>", "Name   N\nalpha  1"),
    ("<pre>\n a  b\n</pre>", " a  b"), ("&lt;b&gt; &eacute;", "<b> é"), ("<title>t</title><h1>h</h1>", "h"), ("<!-- c -->v<!-- open", "v"),
])
def test_html(page, text):
    assert html_text.render(page) == text


def test_html_hides_by_attribute_names_only():
    shown = (
        '<p title="a hidden gem">text</p>', '<div class="nav hidden wide">text</div>', '<body data-note="use display: none">text', "<p data-style='display:none'>text</p>",
        "<p style='--x: a; color: red'>text</p>", "<svg><title>t</title><desc>d</desc><text>text</text></svg>", "<math><mi>text</mi></math>", "<symbol>text</symbol>",
    )
    for page in shown:
        assert html_text.render(page) == "text", page
    assert html_text.render("<svg><text>one</text><text>two</text><path d=''/></svg>") == "one two"
    for page in ("<p hidden>a</p>", "<p HIDDEN=''>a</p>", "<p class=x style='color:red; Display : None !important'>a</p>", "<p style=visibility:hidden>a</p>", "<dialog title='open'>a</dialog>"):
        assert html_text.render(page) == "", page


def test_html_keeps_all_visible_words(spark):
    deep = "<div>" * 3000 + "deep" + "</div>" * 3000
    assert html_text.render(deep) == "deep"
    df = spark.createDataFrame([(1, "u", "<p>a</p>", 9), (None, None, None, 9), (1, "u", "<p>a</p>", 9)], "page_id long, url string, html string, text int")
    assert sorted(r.n_chars for r in html_text.extract_text(df).collect()) == [0, 1, 1]
    for r in table(spark, SF, "pages").select("html").limit(60).collect():
        body = re.sub(r"(?s)<head.*?</head>|<script.*?</script>|<style.*?</style>|<!--.*?-->", " ", r.html)
        want = Counter(html.unescape(re.sub(r"<[^>]*>", " ", body)).split())
        got = Counter(w for w in html_text.render(r.html).split() if w != "-")
        assert not want - got


class SecondReader(html.parser.HTMLParser):
    """Words of a page outside invisible elements, by another parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.words, self.hidden = [], 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("head", "script", "style", "title", "noscript", "template")

    def handle_endtag(self, tag):
        self.hidden -= tag in ("head", "script", "style", "title", "noscript", "template") and self.hidden > 0

    def handle_data(self, data):
        self.words += [] if self.hidden else data.split()


def test_html_words_equal_a_second_parser(spark):
    marks = re.compile(r"-|\d+\.|[“”]")
    pages = [r.html for r in table(spark, "/root/testdata/sf0.01", "pages").select("html").collect()]
    plain = [x for x in pages if not re.search(r"hidden|display|visibility|<details|<dialog|<q>", x)]
    assert len(plain) > 50
    for page in plain:
        reader = SecondReader()
        reader.feed(page)
        reader.close()
        letters = lambda words: "".join(w for w in words if not marks.fullmatch(w))
        assert sorted(letters(html_text.render(page).split())) == sorted(letters(reader.words)), page


def test_html_takes_linear_time():
    n = 200_000
    pages = (
        "<a" * 1_000_000, "<!" * 1_000_000, '<a b=">"' * n, "<a b='" * n, "<a title='" * n + ">", "<" * n, "<script></script " * n, "<div>" * n + "</p>" * n, "&#" + "9" * 10_000 + ";",
        "<a><table><tr><td>" + "<b>" * n + "</a>" * n, "<table><tr><td>x" * 5000, "<ul><li>x" * 5000, "<table><tr><td>" + "y" * n + "<tr><td>a<td>b" * 5000,
    )
    for page in pages:
        began = time.process_time()
        html_text.render(page)
        assert time.process_time() - began < 15, page[:30]


@pytest.mark.parametrize("page, text", [
    ("<table><tr><td rowspan=2>A<td>b<tr><td>c</table>", "A  b\n   c"), ("<table><tr><td>a<td rowspan=3>b<td>c<tr><td>d<td>e<tr><td>f</table>", "a  b  c\nd     e\nf"),
    ("<table><tr><td><p>one<p>two<td><ul><li>x<li>y</ul></table>", "one  - x\n     - y\ntwo"), ("<table><tr><td><h1>T</h1><p>one</p><p>two</p></td></tr></table>", "T\n\none\n\ntwo"),
    ("<table><tr><td><table><tr><td>in<td>ner<tr><td>longer<td>z</table><td>right</table>", "in      ner  right\nlonger  z"),
    ("<table><caption>cap</caption><tr><th>a<th>b<tr><td colspan=2>long spanning cell<tr><td>1<td>2</table>after", "cap\na  b\nlong spanning cell\n1  2\n\nafter"),
    ("<table><tr><td>menu<td>" + "<p>line</p>" * 20 + "</table>", "menu  line" + "\n\n      line" * 19),
    ("<div style='visibility:hidden'>no<span style='visibility: visible'>yes</span></div>", "yes"), ("<p hidden style='display:block'>y</p>", "y"),
    ("<p style='display:none; display:block'>y</p>", "y"), ("<p style='display:none !important; display:block'>n</p>", ""), ("<table><tr style='display:none'><td>n<tr><td>y</table>", "y"),
    ('a <a href="x>y">z</a>', "a z"), ("<svg><p", "<p"), ("x<table", "x<table"), ("<ol start=0><li>a<li value=7>b<li>c</ol>", "0. a\n7. b\n8. c"),
])
def test_html_layout(page, text):
    assert html_text.render(page) == text


# packing


def test_packing(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for docs in (odd(spark), documents(spark)):
        got = packing.pack(docs, **registry.packing_vocabulary()).collect()
        want = Counter()
        for r in docs.select("doc_id", "text").collect():
            ids = np.array([*library.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")
            first = len(ids) % 2048 or 2048
            cuts = [0, *range(min(first, len(ids)), len(ids), 2048)]
            for k, (a, b) in enumerate(zip(cuts, [*cuts[1:], len(ids)], strict=True)):
                want[(-1 if r.doc_id is None else r.doc_id, k, a, b - a, zlib.crc32(ids[a:b].tobytes()))] += 1
        assert want == Counter((-1 if r.doc_id is None else r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got)
        ends = Counter()
        for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
            assert r.offset == ends[r.sequence_id]
            ends[r.sequence_id] += r.length
        assert max(ends.values()) <= 2048 and len(ends) <= 1.02 * math.ceil(sum(ends.values()) / 2048) + 1
    assert packing.pack(odd(spark).limit(0), **registry.packing_vocabulary()).count() == 0


def test_ranks_give_the_ids_of_the_library(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encode = packing.encoder(**registry.packing_vocabulary()).encode
    rng = random.Random(8)
    texts = [r.text or "" for r in table(spark, "/root/testdata/sf0.1", "documents").select("text").collect()]
    ranges = ((0, 0x250), (0x370, 0x600), (0x900, 0xE00), (0x2000, 0x2C00), (0x3000, 0xA000), (0xAC00, 0xD7A4), (0xE000, 0x10000), (0x1F000, 0x20000), (0, 0x80))
    for _ in range(20_000):
        text = "".join(chr(rng.randrange(*rng.choice(ranges))) for _ in range(rng.randint(0, 40)))
        texts.append(text.replace("a", rng.choice(("<|endoftext|>", "  ", "'s", "\r\n", "\u00a0", "123"))))
    for at in range(0, len(texts), 1000):
        some = texts[at : at + 1000]
        assert [x.ids for x in library.encode_batch(some, add_special_tokens=False)] == [encode(x, allowed_special="all") for x in some]


def test_swaps_never_lose_a_piece():
    rng = np.random.default_rng(5)
    for n in (1, 40, 900):
        lengths = Counter(np.clip(rng.lognormal(6.2, 0.7, n).astype(int), 1, 2048).tolist())
        bins = packing.best_fit(lengths, 2048)
        before = sum(bins.count.values())
        packing.improve(bins, packing.Settings())
        held = Counter()
        for pattern, k in bins.count.items():
            assert sum(pattern) <= 2048
            for x in pattern:
                held[x] += k
        assert held == lengths and sum(bins.count.values()) <= before
    # the search gains where lengths fit badly, and ends after its effort
    lengths = Counter(np.random.default_rng(5).integers(500, 900, 600).tolist())
    bins, few = packing.best_fit(lengths, 2048), packing.best_fit(lengths, 2048)
    start = sum(bins.count.values())
    packing.improve(bins, packing.Settings())
    packing.improve(few, packing.Settings(effort=50))
    assert sum(bins.count.values()) < start and sum(few.count.values()) <= start
    # pairs count in bins of very many pieces too: the giver's 7 goes for two 3s
    bins = packing.Bins(200)
    for p in ((1,) * 193 + (3, 3), (7, 90)):
        bins.add(tuple(sorted(p)), 1)
    assert packing._step(bins, (7, 90), [10]) is not None
    # best fit leaves three bins here; exchanges reach two
    bins = packing.Bins(10)
    for p in ((6, 3), (4, 4), (3,)):
        bins.add(p, 1)
    packing.improve(bins, packing.Settings(capacity=10))
    assert sum(bins.count.values()) == 2


# token counts


def test_token_counts(spark):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(2)
    more = [(100 + i, "".join(rng.choice(" a▁\nb<s>é") for _ in range(rng.randint(0, 40)))) for i in range(200)]
    docs = odd(spark, ODD + more)
    got = Counter((r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in rows_of(token_counts.count_tokens(docs, path, shards=5, chunk_words=40)))
    want = Counter()
    for i, t in ODD + more:
        n = len(model.encode(t or ""))
        want[(i, len((t or "").encode()), n, n > 4096)] += 1
    assert got == want
    assert token_counts.count_tokens(docs.limit(0), path).count() == 0


# near duplicates


def brute_links(rows, words=5, least=0.8):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append(frozenset(zip(*(w[i:] for i in range(words)), strict=False)) if len(w) >= words else frozenset([tuple(w)] if w else []))
    near = lambda a, b: a == b or (len(a & b) >= least * len(a | b) if a and b else False)
    links = [[j for j in range(len(rows)) if j != i and near(sets[i], sets[j])] for i in range(len(rows))]
    label = {}
    for i in range(len(rows)):
        if i in label:
            continue
        todo, group = [i], {i}
        while todo:
            for j in links[todo.pop()]:
                if j not in group:
                    group.add(j)
                    todo.append(j)
        least_id = min((rows[j][0] for j in group if rows[j][0] is not None), default=None)
        label.update(dict.fromkeys(group, least_id))
    return Counter((rows[i][0], label[i], len(links[i])) for i in range(len(rows)))


def test_near_duplicates(spark):
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("abcdefg") for _ in range(4)) for _ in range(400)]
    rows = list(ODD)
    for k in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(3, 120))]
        for _ in range(rng.randint(1, 40 if k == 0 else 5)):
            text = list(base)
            for _ in range(rng.randint(0, 3)):
                text[rng.randrange(len(text))] = rng.choice(vocabulary)
            rows.append((1000 + len(rows), " ".join(text)))
    docs = odd(spark, rows)
    want = brute_links(rows)
    for settings in (minhash_forest.Settings(), minhash_forest.Settings(block=8, verify_block=6)):
        got = Counter((r["doc_id"], r["class_id"], r["n_links"]) for r in rows_of(minhash_forest.similar_documents(docs, settings)))
        assert got == want
    assert minhash_forest.similar_documents(docs.limit(0)).count() == 0


def test_shared_shingles_and_prefix():
    rng = np.random.default_rng(6)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 50)).astype(np.uint64)) for _ in range(40)]
    want = [[len(np.intersect1d(a, b)) for b in sets] for a in sets]
    assert minhash_forest.shared_shingles(sets).astype(int).tolist() == want
    s = minhash_forest.Settings()
    k = s.shortest()
    assert 1 - (1 - 0.8**k) ** s.trees >= s.recall > 1 - (1 - 0.8 ** (k + 1)) ** s.trees


class Groups:
    """Stands for a table of groups, whose batches come as they are."""

    def __init__(self, batches):
        self.batches = batches

    def sortWithinPartitions(self, *keys):
        return self

    def mapInArrow(self, run, schema):
        return [row for batch in run(iter(self.batches)) for row in batch.to_pylist()]


def peak_of(work):
    """What `work` returns, and the MB that Python and numpy held meanwhile, at most."""
    tracemalloc.start()
    try:
        return work(), tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


@pytest.mark.parametrize("near, far", [(0, 0), (0, 1)])
def test_verification_of_a_full_block_takes_little_memory(near, far):
    settings, rng, n = minhash_forest.Settings(), random.Random(5), 1024
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 9))) for _ in range(5000)]
    base = [[rng.choice(words) for _ in range(500)] for _ in range(2)]
    texts = []
    for i in range(n):  # copies of two texts, of which every third has too many changes for a link
        text = list(base[i % 7 > 2])
        for _ in range(60 if i % 3 == 0 else 2):
            text[rng.randrange(500)] = rng.choice(words)
        texts.append(" ".join(text))
    sets = [minhash_forest.shingle_sets([t])[0] for t in texts]
    names, copies = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], [1 + i % 5 for i in range(n)]
    columns = {"component": [b"c"] * n, "set": names, "copies": copies, "text": texts, "near": [near] * n, "far": [far] * n, "side": [i % 2 for i in range(n)]}
    again = pa.table({k: v[:100] for k, v in columns.items()})  # rows that repeat a set count once
    groups = Groups([b for part in (pa.table(columns), again) for b in part.to_batches(max_chunksize=700)])
    found, most = peak_of(lambda: minhash_forest.verify(groups, settings))
    size = np.array([len(s) for s in sets])
    both = minhash_forest.shared_shingles(sets)
    linked = (both >= 0.8 * (size[:, None] + size[None] - both) - 1e-6) & ~np.eye(n, dtype=bool)
    if near != far:
        linked &= (np.arange(n) % 2)[:, None] != (np.arange(n) % 2)
    want = {name: k for name, k in zip(names, (linked @ np.array(copies)).tolist(), strict=True) if k}
    assert len(found) == len(want) > 600 and {r["set"]: r["links"] for r in found} == want
    assert most < 100, most


def test_sets_of_a_long_text_take_memory_of_its_words():
    rng = random.Random(8)
    words = [f"w{rng.randrange(10**6)}" for _ in range(300_000)]
    got, most = peak_of(lambda: minhash_forest.shingle_sets([" ".join(words), "a b", None])[0])
    small = [minhash_forest.shingle_sets([" ".join(words[i : i + 5])])[0] for i in (0, 32_766, 32_767, 32_768, 299_995)]
    assert len(got) > 299_000 and all(np.isin(x, got).all() for x in small)
    assert most < 60, most


def test_forest_shortens_prefixes_until_the_recall():
    settings = minhash_forest.Settings()
    rng = np.random.default_rng(13)
    base = rng.integers(0, 65536, 96, dtype=np.uint16)
    changed = lambda places: np.where(np.isin(np.arange(96), places), rng.integers(0, 65536, 96, dtype=np.uint16), base)
    others = np.setdiff1d(np.arange(96), np.arange(6))
    # a near twin by the whole path, a third that shares four minima only, and a stranger in the same subtree
    rows = np.array([base, changed(others[:3]), changed([4, 5, *others[:12]]), np.where(np.arange(96) < 4, base, rng.integers(0, 65536, 96, dtype=np.uint16))])
    ties = minhash_forest.tied(rows, 0, settings)
    reached = {0}
    for _ in range(3):
        reached |= {x for t in ties if set(t) & reached for x in t}
    assert reached == {0, 1, 2}
    # pairs within one side are another block's work
    assert minhash_forest.tied(rows[:3], 0, settings, np.array([0, 0, 0])) == [] and len(minhash_forest.tied(rows[:3], 0, settings, np.array([0, 1, 1]))) == 2
    same = np.repeat(base[None], 50, 0)
    assert len(minhash_forest.tied(same, 3, settings)) == 49


def test_forest_recall_against_the_exact_join(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    sets = minhash_forest.shingle_sets([t for _, t in rows])
    size = np.array([len(x) for x in sets], float)
    both = minhash_forest.shared_shingles(sets)
    linked = both >= 0.8 * (size[:, None] + size[None] - both) - 1e-6
    np.fill_diagonal(linked, False)
    got = {r["doc_id"]: r["n_links"] for r in rows_of(minhash_forest.similar_documents(docs))}
    want = dict(zip((i for i, _ in rows), linked.sum(1).tolist(), strict=True))
    assert sum(got.values()) >= 0.99 * sum(want.values()) > 100 and all(got[i] <= want[i] for i in got)


def test_distinct_documents_keep_every_text(spark):
    long = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen"
    rows = [(1, long), (1, "another text under the same id altogether"), (2, "a third text that stands alone here"), (None, long + " more"), (None, "without an id, and alone in what it says"), (3, long), (3, long), (4, None), (5, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(7) for c in ("set", "t1", "document", "component")})
    kept = minhash_forest.distinct_documents(docs)
    assert kept.columns == docs.columns
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter([rows[0], rows[1], rows[2], rows[4], rows[7]])
    assert minhash_forest.distinct_documents(docs.limit(0)).count() == 0


# mixing


def test_mixing(spark):
    docs = documents(spark)
    settings = mixing.Settings(keep_share=0.4)
    got = mixing.mix(docs, settings).toPandas()
    assert len(got) == docs.count() and got.probability.between(0, 1).all()
    tokens = got.n_tokens * got.probability
    for name, power in settings.targets.items():
        have = got.groupby(name).n_tokens.sum()
        want = have.clip(lower=1) ** power / (have.clip(lower=1) ** power).sum()
        assert (tokens.groupby(got[name]).sum() / tokens.sum() - want).abs().max() < 1e-6
    again = mixing.mix(docs, settings).toPandas()
    assert got.set_index("doc_id").sampled.equals(again.set_index("doc_id").sampled.loc[got.doc_id])
    kept = mixing.draw(docs, settings)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == set(got[got.sampled].doc_id)
    strange = odd(spark).withColumns({"source": F.lit(None).cast("string"), "lang": F.when(F.col("doc_id") > 5, "en"), "weight": F.lit(1), "m": F.lit(1)})
    assert mixing.mix(strange).count() == len(ODD) and set(mixing.draw(strange).columns) == set(strange.columns)
    assert mixing.mix(docs.limit(0)).count() == 0 and mixing.draw(docs.limit(0)).count() == 0


def test_mixing_draws_rows_without_an_id_by_their_text(spark):
    rows = [(None, f"text number {i} of many") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"source": F.lit("a"), "lang": F.lit("en")})
    drawn = mixing.mix(docs).where("sampled").count()
    assert 110 < drawn < 210 and mixing.draw(docs).count() == drawn


def brute_rake(cells, targets, total):
    """Raking by plain loops over dictionaries."""
    have = dict(cells)
    weight = {c: n * total / sum(have.values()) for c, n in have.items()}
    for _ in range(2000):
        for at, target in enumerate(targets):
            sums = Counter()
            for c, w in weight.items():
                sums[c[at]] += w
            goals = {v: target[v] * total for v in sums}
            held = Counter()
            for c, w in weight.items():
                held[c[at]] += w if w >= have[c] else 0.0
            for c, w in weight.items():
                v = c[at]
                if goals[v] <= sums[v]:
                    weight[c] = w * goals[v] / sums[v] if sums[v] else 0.0
                elif w < have[c]:
                    weight[c] = min(have[c], w * (goals[v] - held[v]) / (sums[v] - held[v]))
    return weight


def test_raking_equals_plain_loops(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(["longword"] * rng.randint(1, 40)), rng.choice("abc"), rng.choice("uv"), rng.choice("xyz")) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, topic string")
    targets = {"source": {"a": 0.5, "b": 0.3, "c": 0.2}, "lang": {"u": 0.4, "v": 0.6}, "topic": {"x": 0.3, "y": 0.3, "z": 0.4}}
    cells = Counter()
    for _, text, *dims in rows:
        cells[tuple(dims)] += len(text.split())
    want = brute_rake(cells, list(targets.values()), 0.4 * sum(cells.values()))
    for driver_cells in (1000, 0):
        got = mixing.mix(docs, mixing.Settings(targets=targets, driver_cells=driver_cells)).toPandas()
        for r in got.itertuples():
            cell = (r.source, r.lang, r.topic)
            assert r.probability == pytest.approx(want[cell] / cells[cell], rel=1e-3)


def test_raking_meets_marginals():
    import pandas as pd

    cells = pd.DataFrame([(a, b, 100.0 + 37 * i) for i, (a, b) in enumerate((x, y) for x in "pqr" for y in "uv")], columns=["source", "lang", "tokens"])
    weight = mixing.rake(cells, {"source": {"p": 0.5, "q": 0.3, "r": 0.2}, "lang": {"u": 0.4, "v": 0.6}}, 300.0)
    assert weight.sum() == pytest.approx(300)
    assert np.bincount([0, 0, 1, 1, 2, 2], weight) / 300 == pytest.approx([0.5, 0.3, 0.2], abs=1e-6)
    assert np.bincount([0, 1] * 3, weight) / 300 == pytest.approx([0.4, 0.6], abs=1e-6) and (weight <= cells.tokens).all()


def test_mixing_rakes_every_value(spark):
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("some words of equal texts").alias("text"), F.format_string("s%04d", "id").alias("source"), F.lit("en").alias("lang"))
    for cells in ({}, {"driver_cells": 100}):  # on the driver, and as a table
        got = mixing.mix(docs, mixing.Settings(**cells)).toPandas()
        assert len(got) == 2000 and got.probability.to_numpy() == pytest.approx(0.4)
        targets = {"source": {"s0003": 0.5, "s1999": 0.5}, "lang": 0.5, "topic": 0.0}
        got = mixing.mix(docs, mixing.Settings(targets=targets, keep_share=0.0005, **cells)).toPandas()
        assert dict(zip(got.source, got.probability, strict=True)) == pytest.approx({f"s{i:04d}": 0.5 * (i in (3, 1999)) for i in range(2000)})
        kept = mixing.draw(docs, mixing.Settings(targets=targets, keep_share=0.001, **cells)).collect()
        assert {r.source for r in kept} == {"s0003", "s1999"}


def test_mixing_as_a_table_equals_the_driver(spark):
    docs = documents(spark)
    one, two = (mixing.mix(docs, mixing.Settings(cycles=4, driver_cells=n)).toPandas().sort_values("doc_id") for n in (100_000, 0))
    assert one.probability.nunique() > 20 and one.doc_id.tolist() == two.doc_id.tolist()
    assert two.probability.to_numpy() == pytest.approx(one.probability.to_numpy()) and two.weight.to_numpy() == pytest.approx(one.weight.to_numpy())


# classifiers


def test_compression_quality(spark):
    docs, labels = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels")
    model = compression_quality.fit(docs, labels)
    found = compression_quality.classify(docs, model).join(labels, "doc_id").where("held_out").toPandas()
    assert (found.predicted == found.quality).mean() > 0.95
    got = compression_quality.classify(odd(spark), model).toPandas()
    assert len(got) == len(ODD) and got.score.between(0, 1).all()
    none = compression_quality.fit(docs, labels.where("quality = 1"))
    assert set(compression_quality.classify(odd(spark), none).toPandas().score) == {1.0}
    assert compression_quality.fit(docs.limit(0), labels).constant == 0.5
    assert compression_quality.classify(docs.limit(0), model).count() == 0


def test_compression_quality_of_few_and_odd_labels(spark):
    rng = random.Random(4)
    line = lambda letters: " ".join("".join(rng.choice(letters) for _ in range(6)) for _ in range(80))
    rows = [(i, line("abcdefgh" if i % 2 else "nopqrstu")) for i in range(80)] + [(1, line("abcdefgh")), (200, None), (None, "text")]
    labels = [(i, i % 2, 3) for i in range(80)] + [(3, 0, 3), (None, 1, 3), (5, None, 3), (7, 9, 3), (200, 1, 3), (0, 0, 3)]
    docs = odd(spark, rows).withColumn("quality", F.lit(3))
    model = compression_quality.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int, text int"), modulus=1, held_out=1)
    fresh = model.scores([line("abcdefgh") for _ in range(20)] + [line("nopqrstu") for _ in range(20)])
    assert fresh[:20].min() > 0.5 > fresh[20:].max()
    one = compression_quality.fit(docs, spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int"), modulus=1, held_out=1)
    assert np.isfinite(one.scores(["", line("abcdefgh")])).all()
    x = "ab" * 100_000
    assert len(compression_quality.excerpt(x, model.settings)) <= 64 * 512 and compression_quality.excerpt("abc", model.settings) == b"abc"


def test_language_crf(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    model = language_crf.fit(docs)
    found = language_crf.identify(docs, model).join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null").toPandas()
    assert (found.lang_pred == found.lang).mean() > 0.95
    got = {r["doc_id"]: r["lang_pred"] for r in rows_of(language_crf.identify(odd(spark, [(1, None), (2, ""), (3, "12 34 !!"), (4, "the")]), model))}
    assert [got[i] for i in (1, 2, 3)] == ["und"] * 3 and got[4] != "und"
    assert {r["lang_pred"] for r in rows_of(language_crf.identify(odd(spark), language_crf.fit(docs.limit(0))))} == {"und"}


def test_language_of_long_words(spark):
    rng = random.Random(5)
    word = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    texts = {"aa": "abcdefg", "bb": "nopqrst"}
    rows = [(" ".join(word(x, 6) for _ in range(40)), k) for k, x in texts.items() for _ in range(20)]
    model = language_crf.fit_model([x[0] for x in rows], [x[1] for x in rows])
    run = word("abcdefg", 16) + word("nopqrst", 480) + word("abcdefg", 16)
    langs, scores = language_crf.predict(model, [run, word("nopqrst", 300) + word("abcdefg", 150), word("abcdefg", 6)])
    assert langs == ["bb", "bb", "aa"] and scores[0] == pytest.approx(480 / 512, abs=0.05) and scores[1] == pytest.approx(2 / 3, abs=0.05)
    many = spark.createDataFrame([(i, f"w{i} text", f"l{i:03d}") for i in range(300)], "doc_id long, text string, lang string")
    small = language_crf.Settings(per_language=1, table_bits=6, rounds=1, batch=2)
    assert len(language_crf.fit(many, small, modulus=1, held_out=1).languages) == 300


def test_chained_marginals_are_exact():
    rng = np.random.default_rng(7)
    scores, moves = rng.normal(size=(300, 3)) * 2, rng.normal(size=(3, 3))
    ends = np.array([1, 65, 100, 237, 300])
    for segment in (1, 16, 64, 400):
        got = language_crf.chained_marginals(scores, ends, moves, segment)
        want = np.concatenate([language_crf.forward_backward(scores[a:b][None], moves)[0][0] for a, b in zip([0, *ends[:-1]], ends, strict=True)])
        assert np.allclose(got, want)


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(12)
    k, n = 3, 4
    scores, moves = rng.normal(size=(2, n, k)) * 2, rng.normal(size=(k, k)) * 1.5
    nodes, pairs = language_crf.forward_backward(scores, moves)
    for x in range(2):
        want_nodes, want_pairs = np.zeros((n, k)), np.zeros((n - 1, k, k))
        for path in itertools.product(range(k), repeat=n):
            weight = math.exp(sum(scores[x, t, i] for t, i in enumerate(path)) + sum(moves[a, b] for a, b in itertools.pairwise(path)))
            for t, i in enumerate(path):
                want_nodes[t, i] += weight
            for t, (a, b) in enumerate(itertools.pairwise(path)):
                want_pairs[t, a, b] += weight
        assert np.allclose(nodes[x], want_nodes / want_nodes[0].sum()) and np.allclose(pairs[x], want_pairs / want_pairs[0].sum())


def test_language_fitting_sample_is_bounded(spark):
    row = "a sentence of plain words that goes on and on "
    docs = spark.range(3000).select(F.lit(5).cast("long").alias("doc_id"), F.concat(F.lit(row), F.col("id").cast("string")).alias("text"), F.lit("en").alias("lang"))
    docs = docs.unionByName(spark.createDataFrame([(9, "ein Satz aus schlichten Worten " * 5000, "de"), (9, "x" * 50_000, "de"), (None, None, "de"), (3, "t", None)], "doc_id long, text string, lang string"))
    seen = {}
    fitted = language_crf.fit_model
    try:
        language_crf.fit_model = lambda texts, langs, settings: seen.update(texts=texts, langs=langs)
        language_crf.fit(docs, language_crf.Settings(per_language=64), modulus=1, held_out=1)
    finally:
        language_crf.fit_model = fitted
    counts = Counter(seen["langs"])
    assert counts["de"] == 2 and 40 <= counts["en"] <= 64 and max(map(len, seen["texts"])) <= 300 * language_crf.PART
    assert language_crf.fit(docs.limit(0)) is None and language_crf.identify(docs.limit(0), None).count() == 0


# exact search


def brute_top(rows, k=5):
    """(query_id, rank, vec_id, score) for every fiftieth id, by whole numbers."""
    whole = list(dict.fromkeys((i, tuple(math.floor(256 * v) for v in x)) for i, x in rows if i is not None and x and all(v is not None and math.isfinite(v) for v in x)))
    out = []
    for q in whole:
        if q[0] % 50 == 0:
            found = sorted((-sum(a * b for a, b in zip(q[1], x[1], strict=True)), x[0]) for x in whole if x != q and len(x[1]) == len(q[1]))[:k]
            out += [(q[0], r + 1, i, -s) for r, (s, i) in enumerate(found)]
    return sorted(out)


def test_cover_tree(spark):
    rng = np.random.default_rng(8)
    points = rng.normal(size=(400, 6))
    points[50:120] = points[3]
    rows = [(i, [float(v) for v in x]) for i, x in enumerate(points)]
    rows += [(400, None), (401, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (402, [float("nan")] * 6), (None, [1.0] * 6), (403, [0.5] * 3), (450, []), (500, [0.25] * 3), (403, [0.5] * 3)]
    rows += [(50, [2.0] * 6), (7, [3.0] * 6), (7, [3.0] * 6), (8, [1e6, -3e6, 2e6, 0.5, 1e5, 7.0]), (100, [2e6, 1e6, 0.25, -1e6, 3e5, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"block": F.lit(1), "score": F.lit(2), "own": F.lit(3)})
    for settings in (cover_tree.Settings(), cover_tree.Settings(block_rows=30, query_rows=4, sample_rows=20, pivots=5, leaf=4, fan_out=6), cover_tree.Settings(sample_rows=1)):
        got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in rows_of(cover_tree.top_k(df, lambda v: v % 50 == 0, settings)))
        assert got == brute_top(rows)
    assert cover_tree.top_k(df.limit(0), lambda v: v % 50 == 0).count() == 0
    long = spark.createDataFrame([(0, [3e12, 3e12]), (1, [1.0, 1.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="64 bits"):
        cover_tree.top_k(long, lambda v: v % 50 == 0).collect()


def clusters():
    rng = np.random.default_rng(9)
    centres = rng.normal(size=(40, 3)) * 1000
    return np.floor(np.repeat(centres, 100, 0) + rng.normal(size=(4000, 3)))


def test_cover_tree_prunes():
    rows, ids, own = clusters(), np.arange(4000), np.arange(4000)
    scores, _, have, scored = cover_tree.search(rows[::2], ids[::2], own[::2], np.full(2000, -np.inf), rows, ids, own, cover_tree.Settings())
    exact = rows[::2] @ rows.T
    exact[np.arange(2000), np.arange(0, 4000, 2)] = -np.inf
    assert have.all() and np.array_equal(scores, -np.sort(-exact, axis=1)[:, :5]) and scored < 0.5 * 2000 * 4000


def test_cover_tree_keeps_its_invariants():
    rows = clusters()
    tree = cover_tree.CoverTree(rows, cover_tree.Settings(leaf=8))
    inner = [i for i, c in enumerate(tree.children) if len(c)]
    assert len(inner) > 10
    for i in inner:
        below = tree.children[i]
        levels = {tree.level[c] for c in below}
        assert len(levels) == 1 and (level := levels.pop()) < tree.level[i]
        assert tree.centres[below[0]] == tree.centres[i]  # nesting
        away = np.linalg.norm(tree.centre[below][:, None] - tree.centre[below][None], axis=2)
        assert away[~np.eye(len(below), dtype=bool)].min() > cover_tree.BASE**level  # separation
        assert [tree.span[below[0]][0], tree.span[below[-1]][1]] == list(tree.span[i])
    for i, (begin, end) in enumerate(tree.span):
        away = np.linalg.norm(rows[tree.order[begin:end]] - tree.centre[i], axis=1)
        assert away.max() <= tree.radius[i] + 1e-9 and (i == 0 or tree.radius[i] <= cover_tree.BASE ** tree.level[i] + 1e-9)  # covering


# SQL twins


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = registry.QUERIES[name](spark, SF)
    columns = ", ".join(f'"{c}"' for c in sorted(got.columns))
    cell = lambda v: f"{v:.9f}" if isinstance(v, float) else str(v)
    want = con.sql(f"SELECT {columns} FROM ({registry.ORACLES[name]})").fetchall()
    assert sorted(tuple(map(cell, r)) for r in got.select(*sorted(got.columns)).collect()) == sorted(tuple(map(cell, r)) for r in want)
