"""DuckDB SQL for the training-data queries that SQL can express.

Not expressible: op2, op6 and op10 (hash families DuckDB lacks) and op7 (its trained models); those are
tested against brute force in ``tests/llm``.
"""

from __future__ import annotations

from . import licenses

SQL: dict[str, str] = {}

WORD = r"[^\x20\x09-\x0D]+"

# ---------------------------------------------------------------- op1: base counts, then the certified cut-offs
_RULES = ("symbols", "repeats", "dup_lines", "uppercase", "monotony")
_CUTS = (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.15, 0.1, 0.05, 0.02)
SQL["op1_quality_rules"] = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, unnest(regexp_extract_all(t, '{WORD}')) AS w, generate_subscripts(regexp_extract_all(t, '{WORD}'), 1) AS p FROM d),
g AS (SELECT rid, p, w || ' ' || lead(w, 1) OVER o || ' ' || lead(w, 2) OVER o || ' ' || lead(w, 3) OVER o || ' ' ||
             lead(w, 4) OVER o || ' ' || lead(w, 5) OVER o || ' ' || lead(w, 6) OVER o || ' ' || lead(w, 7) OVER o AS g
      FROM w WINDOW o AS (PARTITION BY rid ORDER BY p)),
twice AS (SELECT rid, p FROM (SELECT rid, p, count(*) OVER (PARTITION BY rid, g) AS c FROM g WHERE g IS NOT NULL) WHERE c > 1),
covered AS (SELECT rid, count(DISTINCT p + k) AS n FROM twice, range(0, 8) r(k) GROUP BY rid),
words AS (SELECT rid, count(*) AS n_words, count(DISTINCT w) AS n_distinct FROM w GROUP BY rid),
lines AS (SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup_lines
          FROM (SELECT rid, unnest(string_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY rid),
f AS (SELECT d.rid, doc_id, lang, coalesce(n_words, 0) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
             length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
             length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS n_upper, coalesce(n_lines, 0) AS n_lines,
             coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n_distinct, 0) AS n_distinct, coalesce(covered.n, 0) AS n_repeat_words
      FROM d LEFT JOIN words USING (rid) LEFT JOIN lines USING (rid) LEFT JOIN covered USING (rid)),
s AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
             [coalesce(n_symbols / nullif(word_chars, 0), 0), coalesce(n_repeat_words / nullif(n_words, 0), 0),
              coalesce(n_dup_lines / nullif(n_lines, 0), 0), coalesce(n_upper / nullif(word_chars, 0), 0),
              coalesce((n_words - n_distinct) / nullif(n_words, 0), 0)] AS sc FROM f),
good AS (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id HAVING min(quality) = 1),
held AS (SELECT s.lang, s.sc FROM s JOIN good USING (doc_id)),
tests AS (SELECT lang, r, i, c, count(*) AS n, count(*) FILTER (WHERE sc[r] > c) AS k
          FROM held, range(1, {len(_RULES) + 1}) x(r),
               (SELECT unnest({list(_CUTS)}) AS c, unnest(range(1, {len(_CUTS) + 1})) AS i) GROUP BY lang, r, i, c),
terms AS (SELECT lang, r, i, sum(exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln(0.02 / 5) + (n - j) * ln(1 - 0.02 / 5))) AS p
          FROM (SELECT lang, r, i, n, unnest(range(0, k + 1)) AS j FROM tests WHERE k < n * (0.02 / 5)) GROUP BY lang, r, i),
passed AS (SELECT t.lang, t.r, t.i, t.c, coalesce(p <= 0.05 / (5 * greatest((SELECT count(*) FROM (SELECT DISTINCT lang FROM held)), 1)), false) AS ok
           FROM tests t LEFT JOIN terms ON t.lang IS NOT DISTINCT FROM terms.lang AND t.r = terms.r AND t.i = terms.i),
cuts AS (SELECT lang, r, min(c) AS cut FROM (SELECT *, bool_and(ok) OVER (PARTITION BY lang, r ORDER BY i) AS o FROM passed) WHERE o GROUP BY lang, r),
hits AS (SELECT rid, string_agg(({list(_RULES)})[r], ',' ORDER BY r) AS rejected_by
         FROM s JOIN cuts ON s.lang IS NOT DISTINCT FROM cuts.lang WHERE sc[r] > cut GROUP BY rid)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND rejected_by IS NULL AS kept, coalesce(rejected_by, '') AS rejected_by
FROM s LEFT JOIN hits USING (rid)"""

# ---------------------------------------------------------------- op3: both replicas compared record by record
SQL["op3_warc_fixity"] = r"""
WITH p AS (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS a FROM pages),
b AS (SELECT *, CASE WHEN page_id % 499 = 11 THEN NULL WHEN page_id % 503 = 7 THEN '#' || substr(a, 2)
                     WHEN page_id % 509 = 13 THEN left(a, length(a) - 1) ELSE a END AS b FROM p),
r AS (SELECT page_id, page_id // 500 AS file, a, b,
             strlen('WARC/1.0' || 'WARC-Type: resource' || 'WARC-Record-ID: <urn:page:' || page_id || '>' || 'WARC-Target-URI: ' || url ||
                    'Content-Type: text/html' || 'Content-Length: ' || strlen(a)) + 2 * 9 + strlen(a) AS length_a,
             strlen('WARC/1.0' || 'WARC-Type: resource' || 'WARC-Record-ID: <urn:page:' || page_id || '>' || 'WARC-Target-URI: ' || url ||
                    'Content-Type: text/html' || 'Content-Length: ' || strlen(b)) + 2 * 9 + strlen(b) AS length_b FROM b),
o AS (SELECT *, sum(length_a) OVER (PARTITION BY file ORDER BY page_id) - length_a AS "offset" FROM r)
SELECT file, CAST("offset" AS BIGINT) AS "offset", page_id,
       CASE WHEN b IS NULL THEN 'missing' WHEN length_a <> length_b THEN 'resized' ELSE 'changed' END AS status, length_a, length_b
FROM o WHERE a IS DISTINCT FROM b"""

# ---------------------------------------------------------------- op4: the digests straight from the rows
SQL["op4_chat_format"] = r"""
WITH rows_ AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
               UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
c AS (SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
             coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
             list(role ORDER BY turn, role, text) AS roles, bool_and(role IN ('user', 'assistant', 'system')) AS usual,
             sum(length(replace(replace(replace(role || text, '\', '\s'), '<', '\l'), '>', '\g')) + length('<turn >') + length('</turn>') + 1) AS chars
      FROM rows_ GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
       CAST(chars AS BIGINT) AS formatted_chars,
       CASE WHEN roles = ['user', 'assistant'] THEN 'prompt' WHEN roles = ['system', 'user', 'assistant'] THEN 'instruction'
            WHEN usual AND ((conv_id % 2) + 2) % 2 = 1 THEN 'from_value' ELSE 'messages' END AS layout
FROM c"""


# ---------------------------------------------------------------- op5: normalised units joined to the known texts
def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _norm(col: str) -> str:
    out = rf"regexp_replace(lower({col}), '(?m)^[ \t]*(?:copyright\b|\(c\)|©|all rights reserved)[^\n]*$', '', 'g')"
    for old, new in licenses.EQUIVALENT:
        out = f"replace({out}, {_quoted(old)}, {_quoted(new)})"
    return rf"regexp_replace({out}, '[^a-z0-9\n\x{{80}}-\x{{10FFFF}}]+|[\x{{A0}}©\x{{2010}}-\x{{2015}}\x{{2018}}-\x{{201F}}\x{{2022}}\x{{2026}}]+', ' ', 'g')"


SQL["op5_license_scan"] = rf"""
WITH known AS (SELECT license, {_norm('text')} AS t FROM (VALUES {', '.join(f'({_quoted(a)}, {_quoted(b)})' for a, b in licenses.known_rows())}) v(license, text)),
k AS (SELECT DISTINCT license, trim(regexp_replace(t, '[ \n]+', ' ', 'g')) AS u FROM known),
d AS (SELECT doc_id, {_norm("coalesce(text, '')")} AS t FROM documents),
u AS (SELECT doc_id, 'document' AS scope, t AS u FROM d
      UNION ALL SELECT doc_id, 'line', unnest(string_split(t, chr(10))) FROM d
      UNION ALL SELECT doc_id, 'block', unnest(string_split_regex(t, '\n(?: *\n)+')) FROM d),
n AS (SELECT doc_id, scope, trim(regexp_replace(regexp_replace(u, ' +', ' ', 'g'), '[ \n]+', ' ', 'g')) AS u FROM u)
SELECT doc_id, scope, license, count(*) AS n FROM n JOIN k USING (u) WHERE u <> '' GROUP BY ALL"""

# ---------------------------------------------------------------- op8: bisection in a recursive CTE, then running totals
SQL["op8_source_mix"] = rf"""
WITH RECURSIVE n AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS BIGINT) AS n FROM documents),
tok AS (SELECT source, sum(n) AS tokens FROM n GROUP BY source HAVING sum(n) > 0),
tot AS (SELECT sum(tokens) AS total, count(*) AS k FROM tok),
p AS (SELECT source, tokens, tokens / total AS p FROM tok, tot),
lim AS (SELECT sum(-p * ln(p)) + 0.5 * (ln(count(*)) - sum(-p * ln(p))) AS target, min(p) AS least FROM p),
bis AS (SELECT 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi, 0 AS i
        UNION ALL
        SELECT CASE WHEN ok THEN lo ELSE mid END, CASE WHEN ok THEN mid ELSE hi END, i + 1 FROM (
          SELECT lo, hi, (lo + hi) / 2 AS mid, i,
                 (SELECT ln(sum(pow(p, (lo + hi) / 2))) - (lo + hi) / 2 * sum(pow(p, (lo + hi) / 2) * ln(p)) / sum(pow(p, (lo + hi) / 2)) FROM p)
                   <= (SELECT target FROM lim)
                 AND (SELECT pow(min(p), (lo + hi) / 2 - 1) / sum(pow(p, (lo + hi) / 2)) * 2.0 FROM p) <= 4.0 AS ok
          FROM bis WHERE i < 50)),
a AS (SELECT hi AS a FROM bis ORDER BY i DESC LIMIT 1),
plan AS (SELECT source, CAST(tokens AS BIGINT) AS tokens,
                CAST(floor(pow(p, a) / (SELECT sum(pow(p, a.a)) FROM p, a) * 2.0 * total) AS BIGINT) AS target FROM p, a, tot),
rows_ AS (SELECT doc_id, n.source, n, tokens, target, unnest(range(0, target // tokens + 1)) AS epoch
          FROM n JOIN plan ON n.source IS NOT DISTINCT FROM plan.source),
h AS (SELECT *, md5('17:' || epoch || ':' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM rows_),
placed AS (SELECT *, epoch * tokens + sum(n) OVER (PARTITION BY source, epoch ORDER BY h, doc_id, n ROWS UNBOUNDED PRECEDING) AS fin FROM h)
SELECT doc_id, source, CAST(epoch AS INTEGER) AS epoch, CAST(least((fin - n) * 64 // target, 63) AS INTEGER) AS block,
       md5('17:' || h) AS slot, n AS n_tokens
FROM placed WHERE fin <= target"""

# ---------------------------------------------------------------- op9: containment of every item's shingles
_TOKENS = r"regexp_extract_all(regexp_replace(lower(coalesce(text, '')), '[.,;:!?\"''()\[\]]', '', 'g'), '" + WORD + "')"
_GRAMS = ("CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) "
          "WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END")
SQL["op9_decontamination"] = f"""
WITH i AS (SELECT DISTINCT item_id, text FROM benchmark),
iw AS (SELECT row_number() OVER () AS rid, item_id, {_TOKENS} AS w FROM i),
ig AS (SELECT DISTINCT rid, item_id, unnest({_GRAMS}) AS g FROM iw),
isz AS (SELECT rid, count(*) AS n_shingles FROM ig GROUP BY rid),
dw AS (SELECT row_number() OVER () AS did, doc_id, {_TOKENS} AS w FROM documents),
dg AS (SELECT DISTINCT did, doc_id, unnest({_GRAMS}) AS g FROM dw),
m AS (SELECT did, rid, any_value(doc_id) AS doc_id, any_value(item_id) AS item_id, count(*) AS n_shared FROM dg JOIN ig USING (g) GROUP BY did, rid)
SELECT doc_id, item_id, n_shared, n_shingles, n_shared / n_shingles AS containment
FROM m JOIN isz USING (rid) WHERE n_shared >= 0.8 * n_shingles"""


# ---------------------------------------------------------------- op11: every document scored for every item
_TERMS = (r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
          r"'[0-9A-Za-z\x{80}-\x{10FFFF}]+')")
SQL["op11_lexical_search"] = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_TERMS} AS w FROM documents),
t AS (SELECT rid, unnest(w) AS w FROM d),
s AS (SELECT count(DISTINCT rid) AS n_docs, count(*) AS n_terms FROM t),
tf AS (SELECT rid, w, count(*) AS tf FROM t GROUP BY ALL),
m AS (SELECT rid, doc_id, 100 - 75 + (75 * len(w) * n_docs) // n_terms AS m FROM d, s WHERE len(w) > 0),
wt AS (SELECT w, CAST(floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS wt FROM tf, s GROUP BY w),
i AS (SELECT DISTINCT item_id, text FROM benchmark),
iw AS (SELECT iid, item_id, w, count(*) AS c FROM (SELECT iid, item_id, unnest(w) AS w FROM (
         SELECT row_number() OVER () AS iid, item_id, {_TERMS} AS w FROM i)) GROUP BY ALL),
sc AS (SELECT iid, item_id, rid, doc_id, CAST(sum(c * wt * ((1000000000 * tf) // (1000 * tf + 8 * m))) AS BIGINT) AS score
       FROM iw JOIN wt USING (w) JOIN tf USING (w) JOIN m USING (rid) GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER o AS INTEGER) AS rank, doc_id, score FROM sc WHERE score > 0
WINDOW o AS (PARTITION BY iid ORDER BY score DESC, doc_id NULLS LAST) QUALIFY rank <= 10"""

# ---------------------------------------------------------------- op12: rebuilt conversations and their distinct prefixes
SQL["op12_prefix_trie"] = r"""
WITH t AS (SELECT conv_id AS c, turn, length(coalesce(text, '')) AS chars,
                  sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS g FROM conversations WHERE conv_id IS NOT NULL),
n AS (SELECT c, chars, g, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, g) AS pos FROM t),
crc AS (SELECT c, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda ch: ord(ch)::BIGINT)),
          lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))) AS r FROM (SELECT DISTINCT c FROM n)),
ids AS (SELECT c, c - c % 100 AS base, xor(r, 4294967295) % 6 AS h FROM crc),
turns AS (SELECT ids.c, n.pos, n.g, n.chars FROM ids JOIN n ON n.c = ids.base WHERE n.pos <= h
          UNION ALL SELECT ids.c, n.pos, n.g, n.chars FROM ids JOIN n ON n.c = ids.c WHERE n.pos > h),
seq AS (SELECT c, list(g ORDER BY pos) AS p, list(chars ORDER BY pos) AS l FROM turns GROUP BY c
        UNION ALL SELECT c, [], [] FROM ids WHERE c NOT IN (SELECT c FROM turns)),
pre AS (SELECT c, p, l, unnest(range(0, len(p) + 1)) AS d FROM seq),
node AS (SELECT p[1:d] AS path, d, min(c) AS conv_id, count(*) AS n, coalesce(any_value(l[d]), 0) AS chars,
                coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE d = len(p)), '') AS ends FROM pre GROUP BY ALL),
kid AS (SELECT path[1:d - 1] AS path, d - 1 AS d, count(*) AS k FROM node WHERE d > 0 GROUP BY ALL),
full_ AS (SELECT node.*, coalesce(k, 0) AS k, par.conv_id AS parent FROM node LEFT JOIN kid ON kid.path = node.path AND kid.d = node.d
          LEFT JOIN node par ON par.d = node.d - 1 AND par.path = node.path[1:node.d - 1]),
sub AS (SELECT a.path, a.d, sum((b.n - 1) * b.chars) AS saved, count(*) FILTER (WHERE b.k = 0) AS leaves
        FROM node a JOIN full_ b ON b.d >= a.d AND b.path[1:a.d] = a.path GROUP BY a.path, a.d)
SELECT conv_id, full_.d AS depth, parent AS parent_conv_id, n AS n_convs, k AS n_children, leaves AS n_leaves,
       CAST(saved AS BIGINT) AS saved_tokens, sha256(ends) AS ends_sha256
FROM full_ JOIN sub ON sub.path = full_.path AND sub.d = full_.d"""

# ---------------------------------------------------------------- op13: groups of equal normalised texts
SQL["op13_exact_dedup"] = r"""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
FROM d"""


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
