"""Bayesian near-duplicates, word runs and source divergence: against brute force, with the odd inputs that tables hold."""

import hashlib
import random
import re
import time
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from crosspanel.llm import bayes_dedup, cover_tree, html_text, mixing, source_divergence, word_runs
from crosspanel.llm.common import only_wanted, sorted_out, stage, table
from tests.llm.test_operators import ODD, odd, rows_of

SF = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# near duplicates


def brute_components(rows, percent=85):
    """(doc_id, n_shingles, component_id, kept) of each row, by comparing all rows."""
    sets = []
    for _, text in rows:
        w = WORDS.findall((text or "").translate(FOLD))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                root[find(i)] = find(j)
    least = defaultdict(list)
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(i)].append(doc_id)
    ids = [min(least[find(i)]) if least[find(i)] and (sets[i] or rows[i][0] is not None) else None for i in range(len(rows))]
    return Counter((r[0], len(s), c, r[0] == c) for r, s, c in zip(rows, sets, ids, strict=True))


def near_copies(seed, n, words=120, edits=3):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(9000)}" for _ in range(words)]
    out = []
    for _ in range(n):
        own = list(base)
        for _ in range(rng.randrange(edits + 1)):
            own[rng.randrange(words)] = f"x{rng.randrange(9000)}"
        out.append(" ".join(own))
    return out


def chained(seed, n, words=200, step=6):
    """Each text is like the ones beside it, the first not like the last."""
    rng = random.Random(seed)
    long = [f"c{rng.randrange(10**6)}" for _ in range(words + n * step)]
    return [" ".join(long[i * step : i * step + words]) for i in range(n)]


@pytest.mark.parametrize("settings", [bayes_dedup.Settings(), bayes_dedup.Settings(block=8, verify_block=6, centres=2), bayes_dedup.Settings(block=5, verify_block=4, centres=0)])
def test_near_duplicates_equal_brute_force(spark, settings):
    texts = near_copies(1, 40) + chained(2, 25) + near_copies(3, 6, words=5, edits=1) + [t.upper() for t in near_copies(1, 3)]
    rows = [(i * 7 % 101, t) for i, t in enumerate(texts)] + [r for r in ODD if r[0] is not None or r[1]]
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in rows_of(bayes_dedup.near_duplicates(odd(spark, rows), settings)))
    assert got == brute_components(rows)


def test_near_duplicates_odd_rows(spark):
    nothing = bayes_dedup.near_duplicates(odd(spark).limit(0))
    assert nothing.count() == 0 and nothing.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    rows = [(None, ""), (None, "a b c d e f g"), (None, "a b c d e f g"), (4, ""), (5, None), (6, " \t "), (9, "A b c"), (8, "a B c")]
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in rows_of(bayes_dedup.near_duplicates(odd(spark, rows))))
    assert got == Counter({(None, 0, None, True): 1, (None, 3, None, True): 2, (4, 0, 4, True): 1, (5, 0, 5, True): 1, (6, 0, 6, True): 1, (9, 1, 8, False): 1, (8, 1, 8, True): 1})


def test_posterior_bounds():
    """A pair is given up only where the posterior of the threshold is under the miss probability, and similar pairs survive."""
    s = bayes_dedup.Settings()
    grid = np.linspace(0, 1, 200_001)[1:-1]
    for _, n, least in s.least_equal:
        for m, given_up in ((least - 1, True), (least, False)):
            logs = m * np.log(grid) + (n - m) * np.log1p(-grid)
            density = np.exp(logs - logs.max())
            assert (density[grid >= s.percent / 100].sum() / density.sum() < s.miss) == given_up
    rng, n = np.random.default_rng(3), s.bands * s.rows
    own = rng.integers(0, 2**16, n, dtype=np.uint16)
    others = np.where(rng.random((20_000, n)) < 0.85, own, rng.integers(0, 2**16, (20_000, n), dtype=np.uint16))
    assert bayes_dedup.survivors(own, others, s).mean() > 0.998
    apart = np.where(rng.random((20_000, n)) < 0.5, own, rng.integers(0, 2**16, (20_000, n), dtype=np.uint16))
    assert bayes_dedup.survivors(own, apart, s).mean() < 0.01


def test_large_groups_are_not_compared_pair_by_pair():
    """A bucket of near copies costs about its size; one in which nothing is alike is compared whole."""
    seen = []

    def hits(at, here):
        seen.append(len(here))
        return np.ones(len(here), bool)

    assert len(bayes_dedup.spanning(5000, hits, np.arange(5000), None)) == 4999 and sum(seen) == 4999
    rows = np.array([0, 0, 1, 1, 2])
    pairs = bayes_dedup.spanning(5, lambda at, here: np.ones(len(here), bool), rows, np.array([0, 0, 1, 1, 1]))
    assert {frozenset((rows[a], rows[b])) for a, b in pairs} == {frozenset((0, 1)), frozenset((0, 2))}


def test_only_wanted_keeps_all_wanted(spark):
    rows = spark.range(20_000).select("id", F.xxhash64("id").alias("key"), F.lit(1).alias("bits"), F.lit(2).alias("bucket"))
    wanted = rows.where("id % 100 = 0").select("key")
    for n_wanted, most_bits, others in ((200, 27, 400), (1_000_000, 27, 10), (1_000_000, 15, 400)):
        kept = only_wanted(rows, wanted, "key", n_wanted, most_bits)
        assert kept.columns == rows.columns and kept.join(wanted, "key").count() == 200
        assert kept.count() <= 200 + others
    few = sorted_out(rows, wanted, "key", 1, 15)
    assert few[0].count() + few[1].count() == 20_000 and few[1].join(wanted, "key").count() == 0
    assert only_wanted(rows, wanted.limit(0), "key", 0).count() == 0


# runs


def brute_runs(w, least=6, periods=4):
    out = {}
    for q in range(1, len(w) // periods + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(least, periods * q):
                out.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted(((s, n, q) for (s, n), q in out.items()), key=lambda r: (r[0], r[2]))


def brute_digest(doc_id, text):
    w = WORDS.findall(text or "")
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and w:
        a, n, own = h // 10 % len(w), len(w), list(w)
        p = 1 + (n - a) // (3 + h // 10 % 8)
        w = [own[i] if i < a else own[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(w)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None,) * 3
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    listed, kept = "".join("%d,%d,%d\n" % r for r in runs), " ".join(x for i, x in enumerate(w) if i not in gone)
    return doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, digest(listed), digest(kept)


def test_runs_equal_brute_force():
    rng = random.Random(5)
    for _ in range(400):
        texts = []
        for _ in range(rng.randint(1, 5)):
            n, k = rng.randint(0, 60), rng.randint(1, 4)
            w = [rng.choice("abcd"[:k]) for _ in range(n)]
            if n and rng.random() < 0.6:
                a, p = rng.randrange(n), rng.randint(1, 9)
                w = w[:a] + [w[a + (i - a) % min(p, n - a)] for i in range(a, n)]
            texts.append(" ".join(w))
        for rule in (word_runs.RunRule(), word_runs.RunRule(2, 2), word_runs.RunRule(9, 3)):
            got = word_runs.runs_of_texts(texts, rule)
            assert [r for _, r in got] == [brute_runs(t.split(), rule.least_words, rule.least_periods) for t in texts]


def test_known_runs():
    fib = ["a", "ab"]
    while len(fib[-1]) < 300:
        fib.append(fib[-1] + fib[-2])
    found = word_runs.runs_of_texts([" ".join(fib[-1])], word_runs.RunRule(2, 2))[0][1]
    assert found == brute_runs(list(fib[-1]), 2, 2) and len(found) > 250
    same = word_runs.runs_of_texts(["x " * 30_000 + "y"])[0][1]
    assert same == [(0, 30_000, 1)]
    words = [b"a", b"b"] * 4 + [b"c"]
    assert word_runs.collapse(words, word_runs.runs_of_texts([" ".join("ab" * 4 + "c")])[0][1]) == b"a b c"


def test_run_query_equals_brute_force(spark):
    texts = [*(" ".join(random.Random(i).choice("abcdefg") for _ in range(i % 90)) for i in range(300)), "ab cd  ef " * 40, "é\U0001f600 ü \xa0 " * 9, "z " * 20_000]
    rows = [(i, t) for i, t in enumerate(texts)] + [r for r in ODD if r[0] is not None]
    out = word_runs.run_digests(word_runs.detect_runs(word_runs.with_planted_periods(odd(spark, rows)), word_runs.RunRule(batch_words=40)))
    assert Counter(map(tuple, out.collect())) == Counter(brute_digest(*r) for r in rows)
    assert any(r.n_runs and zlib.crc32(str(r.doc_id).encode()) % 10 == 0 for r in out.collect())
    found = rows_of(word_runs.detect_runs(odd(spark)))
    assert len(found) == len(ODD) and {r["doc_id"] for r in found} == {r[0] for r in ODD}
    assert word_runs.detect_runs(odd(spark).limit(0)).count() == 0
    null = word_runs.run_digests(word_runs.detect_runs(word_runs.with_planted_periods(odd(spark, [(None, "a b " * 5), (1, None)])))).orderBy("doc_id").collect()
    assert (null[0].n_runs, null[0].length, null[0].exponent_milli, null[1].n_runs, null[1].start) == (1, 10, 5000, 0, None)


# source divergence


def brute_divergence(rows, least=30, top=50):
    term = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    docs = [(lang or "", source or "", term.findall((text or "").translate(FOLD))) for lang, source, text in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        held = Counter(t for d in own for t in set(d[2]))
        kept = sorted((t for t, n in held.items() if n >= least), key=str.encode)
        all_counts = Counter(t for d in own for t in d[2] if held[t] >= least)
        counts = {s: Counter(t for d in own if d[1] == s for t in d[2] if held[t] >= least) for s in {d[1] for d in own}}
        p = lambda c, t: 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept))
        for s, c in counts.items():
            pairs = [(other, sum(abs(p(c, t) - p(d, t)) for t in kept)) for other, d in counts.items() if other != s]
            terms = [(t, p(c, t) - p(all_counts, t)) for t in kept if c[t] and p(c, t) > p(all_counts, t)]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                ranked = sorted(found, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, s, part, item, v, i + 1) for i, (item, v) in enumerate(ranked)]
    return sorted(out)


def divergence_rows(n=400, n_sources=9):
    rng = random.Random(11)
    words = ["the", "The", "of", "été", "日本", "x-ray", "it's", "a1b2", "naïve", "\U0001f600", *(f"q{chr(97 + i)}" for i in range(26))]
    rows = []
    for _ in range(n):
        lang, source = rng.choice(["en", "en", "fr", None]), rng.choice([None, *(f"s{i}" for i in range(n_sources))])
        rows.append((lang, source, rng.choice(["", None, " ".join(rng.choice(words) for _ in range(rng.randrange(60)))] + [" ".join(rng.choice(words[: 4 + zlib.crc32((source or "").encode()) % 20]) for _ in range(40))] * 4)))
    return [*rows, ("de", "only", "not enough documents"), ("de", "none", "..."), ("it", "alone", None), ("en", "s1", "The the " * 30_000)]


@pytest.mark.parametrize("settings", [source_divergence.Settings(), source_divergence.Settings(chunk_terms=3, block_groups=2, held=50)])
def test_divergence_equals_brute_force(spark, settings):
    rows = divergence_rows()
    df = spark.createDataFrame(rows, "lang string, source string, text string").withColumns({c: F.lit(7) for c in ("doc_id", "term", "count", "chunk", "slot", "total", "rank", "own", "near")})
    got = sorted(map(tuple, source_divergence.divergence(df, settings).collect()))
    assert got == brute_divergence(rows)


def test_divergence_of_nothing(spark):
    assert source_divergence.divergence(table(spark, SF, "documents").limit(0)).count() == 0
    got = source_divergence.divergence(spark.createDataFrame([("en", "a", None), ("en", "b", "word"), ("fr", "c", "mot")], "lang string, source string, text string"))
    assert sorted(map(tuple, got.collect())) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]


def test_shares_are_exact(spark):
    counts, totals, n = [0, 1, 7, 10**13], [10**15 + 3, 10**12, 7, 10**13 + 9], 12_345
    want = [1 + 10**9 * (c + 5) // (t + 5 * n) for c, t in zip(counts, totals, strict=True)]
    assert source_divergence.shares(np.array(counts), np.array(totals), n).tolist() == want
    df = spark.createDataFrame(list(zip(counts, totals, strict=True)), "c long, t long")
    assert [r[0] for r in df.select(source_divergence.share(F.col("c"), F.col("t"), F.lit(n))).collect()] == want


# tables of pages


def grid_lines(rows):
    """A table by a plain grid: every slot filled one by one, widths by column."""
    grid, starts = {}, []
    for r, row in enumerate(rows):
        c, own = 0, []
        for text, across, down in row:
            while (r, c) in grid:
                c += 1
            own.append((c, across, text))
            for i in range(down):
                for j in range(across):
                    grid.setdefault((r + i, c + j), text)
            c += across
        starts.append(own)
    widths = defaultdict(int)
    for spanning in (False, True):
        for own in starts:
            for c, across, text in own:
                if (across > 1) is spanning and text:
                    have = sum(widths[i] + 2 for i in range(c, c + across) if widths[i]) - 2
                    if len(text) > have:
                        last = c + across - 1
                        widths[last] += max(1, len(text) - have) if widths[last] else max(1, len(text) - have - 2)
    left = lambda c: sum(widths[i] + 2 for i in range(c) if widths[i])
    out = []
    for own in starts:
        line = ""
        for c, _, text in own:
            if text:
                line = (line + "  " if line and len(line) + 2 > left(c) else line.ljust(left(c))) + text
        if line:
            out.append(line)
    return out


def test_tables_equal_a_plain_grid():
    rng = random.Random(6)
    for _ in range(400):
        rows = [[("x" * rng.choice([0, 1, 2, 3, 8]), rng.choice([1, 1, 1, 2, 3]), rng.choice([1, 1, 1, 2])) for _ in range(rng.randint(0, 5))] for _ in range(rng.randint(1, 6))]
        held, clash = set(), False  # without cells that overlap, of which HTML says nothing
        for r, row in enumerate(rows):
            c = 0
            for _, across, down in row:
                while (r, c) in held:
                    c += 1
                own = {(r + i, c + j) for i in range(down) for j in range(across)}
                clash |= bool(own & held)
                held |= own
                c += across
        if not clash:
            assert html_text._aligned([[([t] if t else [], a, d) for t, a, d in row] for row in rows], html_text.Layout(most_padding=10**6)) == grid_lines(rows)


@pytest.mark.parametrize("make", [
    lambda k: "<table><tr>" + "<td rowspan=1000 colspan=100>x" * (k // 70) + "<tr><td>y" * (k // 20) + "</table>",
    lambda k: "<table><tr>" + "".join(f"<td rowspan={2 + i * 7919 % 60000} colspan={1 + i % 1000}>x" for i in range(k // 76)) + "<tr><td>y" * (k // 20) + "</table>",
    lambda k: "<table>" + "".join(f"<tr><td rowspan={2 + i % 5} colspan={1 + i % 13}>a<td>b<td rowspan=3>c" for i in range(k // 55)) + "</table>",
    lambda k: "<table><tr>" + ("<td>" + "z" * 80) * (k // 168) + "<tr><td colspan=999><td>q" * (k // 50) + "</table>",
])
def test_spanning_cells_take_time_of_the_page(make):
    html_text.render(make(20_000))
    page = make(1_000_000)
    began = time.time()
    text = html_text.render(page)
    took = time.time() - began
    assert 800_000 < len(page) < 1_100_000 and took < 15, took  # some 2 seconds on a machine that does nothing else
    assert len(text) < 20 * len(page) and len(text.split()) >= page.count("<td") - page.count("colspan=999")


def test_long_cells_stay_aligned():
    page = "<table><tr><td>" + "<br>".join(f"line {i}" for i in range(13)) + "<td>side<tr><td>k<td>v</table>"
    assert html_text.render(page).split("\n") == ["line 0   side", *(f"line {i}" for i in range(1, 13)), "k        v"]
    words = " ".join(f"w{i}" for i in range(200))
    lines = html_text.render(f"<table><tr><td>{words}<td>side<tr><td>k<td>v</table>").split("\n")
    assert " ".join(x.split("  ")[0] for x in lines[:-1]) == words and all(len(x) <= 106 for x in lines) and lines[-1].index("v") == lines[0].index("side")
    assert html_text.render("<table><tr><td>" + "n" * 300 + "<td>b<tr><td>c<td>d</table>").split("\n")[1] == "c" + " " * 301 + "d"


# mixing: what cells cannot supply, and what goals cannot be met


def cells_of(spark, rows):
    """Documents of one word a token: (source, lang, tokens) each."""
    texts = [(i, " ".join(["word"] * n), a, b, "t") for i, (a, b, n) in enumerate(rows)]
    return spark.createDataFrame(texts, "doc_id long, text string, source string, lang string, topic string")


@pytest.mark.parametrize("driver_cells", [100_000, 0])
def test_mixing_fills_the_total_where_a_value_is_exhausted(spark, driver_cells):
    docs = cells_of(spark, [("a", "u", 100), ("b", "u", 900)])
    even = mixing.Settings(targets={"source": {"a": 0.5, "b": 0.5}, "lang": 1.0}, keep_share=0.4, driver_cells=driver_cells)
    got = {r.source: r.n_tokens * r.probability for r in mixing.mix(docs, even).collect()}
    assert got == pytest.approx({"a": 100, "b": 300})
    found = {(r.dimension, r.value): r for r in mixing.marginals(docs, even).collect()}
    assert found["source", "a"].goal == 0.5 and found["source", "a"].weight == pytest.approx(0.25) and found["source", "b"].miss == pytest.approx(0.25)
    assert found["lang", "u"].miss == pytest.approx(0) and found["source", "b"].tokens == 900
    # within a value: the cell (a, u) is exhausted, so (a, v) has to give more
    docs = cells_of(spark, [("a", "u", 20), ("a", "v", 480), ("b", "u", 480), ("b", "v", 20)])
    got = mixing.mix(docs, mixing.Settings(targets={"source": {"a": 0.5, "b": 0.5}, "lang": {"u": 0.52, "v": 0.48}}, keep_share=0.6, driver_cells=driver_cells, tolerance=1e-5)).toPandas()
    drawn = got.n_tokens * got.probability
    assert drawn.sum() == pytest.approx(600) and drawn.groupby(got.source).sum().tolist() == pytest.approx([300, 300], abs=1e-3) and drawn.groupby(got.lang).sum().tolist() == pytest.approx([312, 288], abs=1e-3)


@pytest.mark.parametrize("times, rare", [(1.0, 20.0), (1e6, 20.0), (1e6, 0.4)])
def test_raking_ends_near_its_limit_however_slowly_it_gets_there(times, rare):
    cells = pd.DataFrame({"source": list("aabb"), "lang": list("uvuv"), "tokens": times * np.array([rare, 480.0, 480.0, rare])})
    shares, total = {"source": {"a": 0.5, "b": 0.5}, "lang": {"u": 0.501, "v": 0.499}}, 0.6 * cells.tokens.sum()
    limit = mixing.rake(cells, shares, total, 20_000, 0.0)
    for tolerance in (1e-3, 1e-5, 1e-7):
        got = mixing.rake(cells, shares, total, 20_000, tolerance)
        assert (np.abs(got - limit) <= 2 * tolerance * np.maximum(limit, 1.0)).all(), (tolerance, got, limit)


@pytest.mark.parametrize("driver_cells", [100_000, 0])
def test_mixing_tells_what_it_misses(spark, driver_cells):
    docs = cells_of(spark, [("a", "u", 500), ("b", "v", 500)])
    torn = {"source": {"a": 0.5, "b": 0.5}, "lang": {"u": 0.1, "v": 0.9}}
    settings = mixing.Settings(targets=torn, keep_share=0.4, cycles=4, driver_cells=driver_cells)
    found = {(r.dimension, r.value): (r.goal, r.miss) for r in mixing.marginals(docs, settings).collect()}
    assert found["lang", "u"] == pytest.approx((0.1, 0.0)) and found["source", "a"] == pytest.approx((0.5, -0.4))
    with pytest.raises(ValueError, match="source"):
        mixing.mix(docs, mixing.Settings(targets=torn, keep_share=0.4, cycles=4, driver_cells=driver_cells, most_miss=0.01))
    fair = mixing.Settings(targets={"source": {"a": 0.3, "b": 0.7}, "lang": {"u": 0.3, "v": 0.7}}, keep_share=0.4, driver_cells=driver_cells, most_miss=1e-6)
    assert mixing.mix(docs, fair).count() == 2
    assert mixing.marginals(docs.limit(0), settings).count() == 0


def test_goals_are_filled_by_shares():
    goals = mixing.capped_goals(np.array([1.0, 1.0, 2.0, 0.0]), np.array([10.0, 100.0, 1000.0, 50.0]), 400.0)
    assert goals.tolist() == pytest.approx([10, 100, 290, 0])
    assert mixing.capped_goals(np.array([1.0, 1.0]), np.array([10.0, 20.0]), 100.0).tolist() == [10, 20]
    assert mixing.capped_goals(np.array([0.0, 0.0]), np.array([10.0, 20.0]), 8.0).tolist() == [4, 4]


# cover trees on vectors that nothing tells apart


@pytest.mark.parametrize("n, d", [(2000, 64), (600, 200)])
def test_no_leaf_is_large_and_invariants_hold_in_many_dimensions(n, d):
    rng = np.random.default_rng(n)
    rows = rng.normal(size=(n, d))
    rows = np.floor(256 * rows / np.linalg.norm(rows, axis=1)[:, None])
    rows[100:500] = rows[7]
    settings = cover_tree.Settings(leaf=32)
    tree = cover_tree.CoverTree(rows, settings)
    assert sorted(tree.order.tolist()) == list(range(n))
    for i, ((begin, end), below) in enumerate(zip(tree.span, tree.children, strict=True)):
        away = np.linalg.norm(rows[tree.order[begin:end]] - tree.centre[i], axis=1)
        assert away.max() <= tree.radius[i] + 1e-9 and (i == 0 or tree.radius[i] <= cover_tree.BASE ** tree.level[i] + 1e-6)
        if not len(below):
            assert end - begin <= settings.leaf or tree.radius[i] == 0
            continue
        level = {tree.level[c] for c in below}.pop()
        apart = np.linalg.norm(tree.centre[below][:, None] - tree.centre[below][None], axis=2)[~np.eye(len(below), dtype=bool)]
        assert level < tree.level[i] and tree.centres[below[0]] == tree.centres[i] and apart.min() > cover_tree.BASE**level


def test_search_holds_little_memory():
    rng = np.random.default_rng(0)
    rows, ids = np.floor(256 * rng.normal(size=(4096, 64)) / 8), np.arange(4096)
    tracemalloc.start()
    scores, _, have, _ = cover_tree.search(rows, ids, ids, np.full(4096, -np.inf), rows, ids, ids, cover_tree.Settings())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    exact = rows @ rows.T
    np.fill_diagonal(exact, -np.inf)
    assert have.all() and np.array_equal(scores, -np.sort(-exact, axis=1)[:, :5]) and peak < 60e6


def test_rows_go_only_to_groups_that_reach_their_pivot(spark):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(6, 4)) * 50
    points = [(i, (centres[i % 6] + rng.normal(size=4)).tolist()) for i in range(900)]
    df = spark.createDataFrame(points, "vec_id long, embedding array<double>")
    x = np.floor(256 * np.array([p[1] for p in points]))
    scores = (x @ x.T).astype(np.int64)
    settings = cover_tree.Settings(block_rows=100, query_rows=7, sample_rows=60, pivots=6, leaf=16)
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in cover_tree.top_k(df, lambda v: v % 9 == 0, settings).collect()}
    for q in range(0, 900, 9):
        best = sorted((-int(s), i) for i, s in enumerate(scores[q]) if i != q)[:5]
        assert [got[q, k + 1] for k in range(5)] == [(i, -s) for s, i in best]


def test_stage_is_unique(spark):
    assert stage(spark.range(3), "twice").count() == stage(spark.range(3), "twice").count() == 3
