"""DuckDB twins of the operators that SQL can express: whole results, worked out another way."""

from __future__ import annotations

from crosspanel.llm import quality_rules
from crosspanel.llm.quality_rules import ENDINGS, NOTICES, SEPARATORS, SYMBOLS

#: Words, and the characters between them, as patterns.
_WORD, _BLANK = r"[^\x20\x09-\x0D]+", r"[\x20\x09-\x0D]"


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _count(part: str, of: str) -> str:
    return f"(length({of}) - length(replace({of}, {_text(part)}, ''))) // {len(part)}"


def quality_rules_sql() -> str:
    """Base measures and the line-first verdict of every document."""
    r = quality_rules.LineRules()
    symbols = " + ".join(_count(x, "line") for x in SYMBOLS)
    all_symbols = " + ".join(_count(x, "text") for x in SYMBOLS)
    separators = " + ".join(_count(f" {x} ", "line") for x in SEPARATORS)
    notices = " OR ".join(f"contains(lower(line), {_text(x)})" for x in NOTICES)
    bare = f"regexp_replace({{}}, '{_BLANK}', '', 'g')"
    return rf"""WITH d AS (SELECT row_number() OVER () rid, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_WORD}') w FROM documents),
g AS (SELECT rid, p, array_to_string(w[p:p + {r.window - 1}], ' ') gram FROM (SELECT rid, w, unnest(range(1, len(w) - {r.window - 2})) p FROM d)),
again AS (SELECT rid, count(DISTINCT i) n FROM (SELECT rid, unnest(range(p, p + {r.window})) i FROM (SELECT *, count(*) OVER (PARTITION BY rid, gram) c FROM g) WHERE c > 1) GROUP BY rid),
l0 AS (SELECT rid, unnest(string_split(text, chr(10))) line, generate_subscripts(string_split(text, chr(10)), 1) i FROM d),
l1 AS (SELECT *, {bare.format("line")} own, lead(line) OVER (PARTITION BY rid ORDER BY i) after FROM l0),
l2 AS (SELECT *, len(regexp_extract_all(line, '{_WORD}')) n, regexp_replace(coalesce(after, ''), '^{_BLANK}+', '') following, {symbols}
  + CASE WHEN contains(line, '!!') OR contains(line, '??') OR contains(line, '...') OR contains(line, ',,') THEN len(regexp_extract_all(line, '[!?.,]{{2,}}')) ELSE 0 END marks,
  {separators} seps, len(regexp_extract_all(line, '\p{{Lu}}')) caps, len(regexp_extract_all(line, '\p{{L}}')) letters FROM l1 WHERE own <> ''),
l3 AS (SELECT *, CASE WHEN seps > 1 AND seps > {r.max_separator_share} * n THEN true WHEN marks > {r.max_symbols_per_word} * n THEN true WHEN {notices} THEN true
  WHEN caps >= {r.capital_letters} AND caps > {r.max_capital_share} * letters THEN true
  WHEN n >= {r.sentence_words} AND NOT contains({_text(ENDINGS)}, right(own, 1)) AND following <> '' AND NOT regexp_matches(following, '^\p{{Ll}}') THEN true ELSE false END bad FROM l2),
v AS (SELECT rid, count(*) n_lines, count(*) FILTER (bad) n_failed_lines, coalesce(sum(length(own)) FILTER (NOT bad), 0) left_chars, count(*) - count(DISTINCT line) dup FROM l3 GROUP BY rid),
m AS (SELECT doc_id, CAST(len(w) AS BIGINT) n_words, CAST(length({bare.format("text")}) AS BIGINT) word_chars, CAST({all_symbols} AS BIGINT) n_symbols, CAST(coalesce(dup, 0) AS BIGINT) n_dup_lines,
  CAST(coalesce(again.n, 0) AS BIGINT) n_repeat_words, CAST(coalesce(n_lines, 0) AS BIGINT) n_lines, CAST(coalesce(n_failed_lines, 0) AS BIGINT) n_failed_lines, coalesce(left_chars, 0) left_chars
  FROM d LEFT JOIN v USING (rid) LEFT JOIN again USING (rid)),
b AS (SELECT *, n_words < {r.min_words} OR 100 * n_repeat_words > {r.max_repeat_percent} * n_words AS base_failed, CASE WHEN word_chars > 0 THEN CAST(left_chars AS DOUBLE) / word_chars ELSE 0.0 END kept_share FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND kept_share >= {r.min_kept_share} AS kept, n_lines, n_failed_lines, kept_share FROM b"""


#: Classes and links by the exact join of all shingles. The query finds its pairs by signatures, with a stated recall.
SIMILAR_DOCUMENTS = f"""WITH RECURSIVE
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') w FROM documents),
s AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
  WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) g FROM d),
k AS MATERIALIZED (SELECT row_number() OVER () id, g, len(g) size, min(doc_id) first_id, count(*) copies FROM s GROUP BY g),
x AS MATERIALIZED (SELECT id, unnest(g) gram FROM k),
p AS (SELECT a.id u, b.id v, count(*) c FROM x a JOIN x b ON a.gram = b.gram AND a.id <> b.id GROUP BY a.id, b.id),
l AS MATERIALIZED (SELECT u, v FROM p JOIN k a ON a.id = u JOIN k b ON b.id = v WHERE 5 * c >= 4 * (a.size + b.size - c)),
r(u, root) AS (SELECT id, id FROM k UNION SELECT l.v, r.root FROM r JOIN l ON l.u = r.u),
c AS (SELECT r.u id, min(k.first_id) class_id FROM r JOIN k ON k.id = r.root GROUP BY r.u),
n AS (SELECT l.u id, sum(k.copies) links FROM l JOIN k ON k.id = l.v GROUP BY l.u)
SELECT s.doc_id, c.class_id, CAST(coalesce(n.links, 0) + k.copies - 1 AS BIGINT) AS n_links FROM s JOIN k ON k.g = s.g JOIN c ON c.id = k.id LEFT JOIN n ON n.id = k.id"""


TOP_K = """WITH v AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) x FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id query_id, q.x own, c.vec_id, CAST(list_dot_product(q.x, c.x) AS BIGINT) score FROM v q JOIN v c ON len(q.x) = len(c.x) AND (q.vec_id <> c.vec_id OR q.x <> c.x) WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id, own ORDER BY score DESC, vec_id) rank FROM s) WHERE rank <= 5"""


_FOLDED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Components of the exact join of all shingles at 85 hundredths; empty sets stay alone.
NEAR_DUPLICATES = f"""WITH RECURSIVE
d AS (SELECT doc_id, regexp_extract_all({_FOLDED}, '{_WORD}') w FROM documents),
s AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
  WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) g FROM d),
k AS MATERIALIZED (SELECT row_number() OVER () id, g, len(g) size, min(doc_id) first_id FROM s WHERE len(g) > 0 GROUP BY g),
x AS MATERIALIZED (SELECT id, unnest(g) gram FROM k),
p AS (SELECT a.id u, b.id v, count(*) c FROM x a JOIN x b ON a.gram = b.gram AND a.id <> b.id GROUP BY a.id, b.id),
l AS MATERIALIZED (SELECT u, v FROM p JOIN k a ON a.id = u JOIN k b ON b.id = v WHERE 100 * c >= 85 * (a.size + b.size - c)),
r(u, root) AS (SELECT id, id FROM k UNION SELECT l.v, r.root FROM r JOIN l ON l.u = r.u),
c AS (SELECT r.u id, min(k.first_id) component_id FROM r JOIN k ON k.id = r.root GROUP BY r.u),
o AS (SELECT s.doc_id, len(s.g) n, CASE WHEN k.id IS NULL THEN s.doc_id ELSE c.component_id END component_id FROM s LEFT JOIN k ON k.g = s.g LEFT JOIN c ON c.id = k.id)
SELECT doc_id, CAST(n AS BIGINT) AS n_shingles, component_id, doc_id IS NOT DISTINCT FROM component_id AS kept FROM o"""


#: Runs by comparing all pairs of equal words of a document; crc32 by its eight shifts a byte.
WORD_RUNS = rf"""WITH
d AS (SELECT row_number() OVER () rid, doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') w, list_reduce(flatten(list_transform(range(1, len(CAST(doc_id AS VARCHAR)) + 1),
  lambda i: [CAST(ascii(CAST(doc_id AS VARCHAR)[i]) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1])), lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END, 4294967295) c FROM documents),
h AS (SELECT *, len(w) n, xor(c, 4294967295) h, xor(c, 4294967295) // 10 g FROM d),
a AS (SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN g % n ELSE n END a FROM h),
e AS (SELECT rid, doc_id, n, CASE WHEN a < n THEN list_transform(range(0, n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END]) ELSE w END w FROM a),
x AS MATERIALIZED (SELECT rid, n, unnest(w) word, generate_subscripts(w, 1) - 1 i FROM e),
p AS (SELECT a.rid, a.i, b.i - a.i q FROM x a JOIN x b ON a.rid = b.rid AND a.word = b.word AND b.i > a.i AND 4 * (b.i - a.i) <= a.n),
s AS (SELECT rid, min(i) AS start, q, count(*) + q AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY rid, q ORDER BY i) stretch FROM p) GROUP BY rid, q, stretch HAVING count(*) + q >= greatest(6, 4 * q)),
r AS MATERIALIZED (SELECT rid, start, length, min(q) AS period FROM s GROUP BY rid, start, length),
f AS (SELECT rid, count(*) n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) listed,
  first({{'start': start, 'length': length, 'period': period}} ORDER BY length DESC, start, period) best FROM r GROUP BY rid),
gone AS (SELECT DISTINCT rid, unnest(range(start + period, start + length)) i FROM r),
k AS (SELECT x.rid, string_agg(x.word, ' ' ORDER BY x.i) kept FROM x LEFT JOIN gone ON gone.rid = x.rid AND gone.i = x.i WHERE gone.rid IS NULL GROUP BY x.rid)
SELECT doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(best.start AS BIGINT) AS start, CAST(best.length AS BIGINT) AS length, CAST(best.period AS BIGINT) AS period,
  CAST(1000 * best.length // best.period AS BIGINT) AS exponent_milli, sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256
FROM e LEFT JOIN f USING (rid) LEFT JOIN k USING (rid)"""


#: Shares of all kept terms for all groups, pair by pair.
SOURCE_DIVERGENCE = rf"""WITH
d AS (SELECT row_number() OVER () rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all({_FOLDED}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') t FROM documents),
w AS MATERIALIZED (SELECT rid, lang, source, unnest(t) term FROM d),
kept AS MATERIALIZED (SELECT lang, term, count(*) c FROM w GROUP BY lang, term HAVING count(DISTINCT rid) >= 30),
v AS (SELECT lang, count(*) n_terms, sum(c) total FROM kept GROUP BY lang),
gc AS (SELECT w.lang, w.source, w.term, count(*) c FROM w JOIN kept USING (lang, term) GROUP BY w.lang, w.source, w.term),
g AS (SELECT DISTINCT lang, source FROM d),
gn AS (SELECT g.lang, g.source, coalesce(sum(c), 0) total FROM g LEFT JOIN gc USING (lang, source) GROUP BY g.lang, g.source),
p AS MATERIALIZED (SELECT gn.lang, gn.source, kept.term, coalesce(gc.c, 0) c, 1 + (CAST(1000000000 AS HUGEINT) * (coalesce(gc.c, 0) + 5)) // (gn.total + 5 * v.n_terms) p,
  1 + (CAST(1000000000 AS HUGEINT) * (kept.c + 5)) // (v.total + 5 * v.n_terms) q FROM gn JOIN kept USING (lang) JOIN v USING (lang) LEFT JOIN gc ON gc.lang = gn.lang AND gc.source = gn.source AND gc.term = kept.term),
pv AS (SELECT a.lang, a.source, b.source item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
pair AS (SELECT a.lang, a.source, 'pair' part, b.source item, CAST(coalesce(pv.value, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pv ON pv.lang = a.lang AND pv.source = a.source AND pv.item = b.source),
term AS (SELECT lang, source, 'term' part, term item, CAST(p - q AS BIGINT) AS value FROM p WHERE c > 0 AND p > q),
o AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pair UNION ALL SELECT * FROM term))
SELECT lang, source, part, item, value, CAST(rank AS INTEGER) AS rank FROM o WHERE part = 'pair' OR rank <= 50"""
