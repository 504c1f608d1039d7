"""DuckDB oracle SQL for the registered queries.

Each statement is an independent formulation of the same result on the pre-registered views
(global windows and ``string_agg ... ORDER BY`` where the Spark side avoids them). RE2 has no
look-arounds, so word-boundary rules are written with a captured neighbour character that is put
back (applied twice where neighbouring matches can share that character); the inner-dot rule
walks the characters of the string.
"""

from __future__ import annotations

from ..functions import constants as K
from ..functions import tdist
from ..functions.text import PY_LINE_BREAK, PY_SPACE, longest_first

NOT_WORD = r"[^\p{L}\p{N}_]"
JAVA_SPACE = r"[\t\n\x{0b}\f\r ]"


# ----------------------------------------------------------------------------- helpers
def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def lst(words) -> str:
    return "[" + ", ".join(q(w) for w in words) + "]"


def py_split(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, {q(PY_SPACE + '+')}), lambda w: w <> '')"


def space_tokens(x: str) -> str:
    return f"list_filter(string_split({x}, ' '), lambda w: w <> '')"


def squeeze(x: str) -> str:
    return f"array_to_string({space_tokens(x)}, ' ')"


def drop_words(x: str, *lists) -> str:
    banned = []
    for wl in lists:
        for w in wl:
            if w not in banned:
                banned.append(w)
    return f"array_to_string(list_filter(string_split({x}, ' '), lambda w: w <> '' AND NOT list_contains({lst(banned)}, w)), ' ')"


def rr(x: str, pat: str, rep: str = "") -> str:
    return f"regexp_replace({x}, {q(pat)}, {q(rep)}, 'g')"


def replace_all(x: str, frags, by: str = "") -> str:
    for f in frags:
        x = f"replace({x}, {q(f)}, {q(by)})"
    return x


def let(x: str, body: str) -> str:
    """``body`` uses ``v``; ``x`` is evaluated once."""
    return f"list_transform([{x}], lambda v: {body})[1]"


def unicode_words(x: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({x}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"


def word_boundary_twice(x: str, core: str, flags: str = "") -> str:
    pat = f"{flags}(^|{NOT_WORD}){core}({NOT_WORD}|$)"
    return rr(rr(x, pat, r"\1\2"), pat, r"\1\2")


# ----------------------------------------------------------------------------- cleaning steps
def keywords(x: str) -> str:
    s = f"translate(replace(lower({x}), '-', ' '), {q(K.PUNCTUATION)}, '')"
    s = f"array_to_string(list_filter({py_split(s)}, lambda w: NOT list_contains({lst(K.UNITS_T1)}, w)), ' ')"
    s = rr(s, r"\p{Nd}+")
    s = f"array_to_string(list_filter(string_split({s}, ' '), lambda w: length(w) > 1), ' ')"
    s = rr(s, "[^A-Za-z0-9]+", " ")
    for a, b in K.TOKENIZER_SPLITS:
        if (a, b) == ("wan", "na"):
            s = rr(s, rf"\b({a})({b}) ", r"\1 \2 ")
        else:
            s = rr(s, rf"\b({a})({b})\b", r"\1 \2")
    stop = K.stopwords(keep=K.KEEP_T1)
    return f"array_to_string(list_filter(string_split({s}, ' '), lambda w: length(w) > 1 AND NOT list_contains({lst(stop)}, w)), ' ')"


def clean_report(x: str) -> str:
    s = replace_all(f"lower({x})", K.REPORT_FRAGMENTS_T2)
    s = f"translate({s}, chr(10) || chr(9), '  ')"
    s = rr(s, r"(?s)[\(\[].*?[\)\]]")
    s = rr(s, r"[/(){}\[\]\|@,;]", " ")
    s = rr(s, r"[^0-9a-z #+_]")
    s = drop_words(s, K.UNITS_T2, K.QUANTS, K.stopwords(keep=K.KEEP_T2))
    s = replace_all(s, longest_first(K.QUANT_PHRASES), " ")
    s = rr(s, "[0-9]")
    return squeeze(s)


def remove_measurements(x: str) -> str:
    units = "|".join(longest_first(K.MEASUREMENT_UNITS))
    return word_boundary_twice(x, rf"\p{{Nd}}+(?:\.\p{{Nd}}+)?\s*(?:{units})")


def remove_time_info(x: str) -> str:
    months = "|".join(K.MONTHS)
    s = word_boundary_twice(x, f"(?:{months})", "(?i)")
    s = rr(s, r"\p{Nd}{1,2}[/:]\p{Nd}{1,2}[/:]\p{Nd}{4}|\p{Nd}{4}-\p{Nd}{2}-\p{Nd}{2}")
    s = rr(s, r"\p{Nd}{1,2}:\p{Nd}{2}(?:am|pm|AM|PM)?")
    return word_boundary_twice(s, "(?:am|pm|AM|PM)")


def inner_dots(x: str) -> str:
    body = ("array_to_string(list_filter(list_transform(cs, lambda c, i: CASE WHEN c = '.' AND i > 1 AND i < len(cs) "
            "AND regexp_matches(cs[i - 1], '[a-zA-Z]') AND regexp_matches(cs[i + 1], '[.,a-zA-Z]') THEN NULL ELSE c END), "
            "lambda c: c IS NOT NULL), '')")
    return f"list_transform([string_split({x}, '')], lambda cs: {body})[1]"


def nondiagnostic(x: str) -> str:
    s = remove_time_info(remove_measurements(x))
    s = f"translate({s}, chr(10) || chr(9), '  ')"
    s = rr(s, r"(?s)[\(\[].*?[\)\]]")
    s = rr(s, r"[^.,a-zA-Z ]")
    s = inner_dots(s)
    s = f"translate(lower({s}), ',', ' ')"
    s = drop_words(s, K.UNITS_T3, K.QUANTS, K.stopwords(extra=K.EXTRA_STOP_T3))
    s = replace_all(s, longest_first(K.QUANT_PHRASES), " ")
    s = let(s, "CASE WHEN instr(v, 'history') > 0 THEN trim(substr(v, instr(v, 'history') + 7)) ELSE v END")
    s = rr(s, r"(physician|contact information).*?(fax|oh|ohio)")
    s = rr(s, r"heart vascular institute.*?ohio")
    s = rr(s, r"\b[a-z]\b")
    return squeeze(s)


def sentences(x: str) -> str:
    s = rr(x, rf"([.!?]){JAVA_SPACE}+", r"\1" + "\x01")
    s = rr(s, r"\n+", "\x01")
    blank = f"trim(regexp_replace(w, {q(PY_SPACE)}, ' ', 'g')) = ''"
    return f"list_filter(string_split({s}, chr(1)), lambda w: NOT ({blank}))"


def history_sections(x: str) -> str:
    pat = "(?i)" + K.HISTORY_HEADER_PATTERN
    return let(f"regexp_split_to_array({x}, {q(pat)})",
               "CASE WHEN len(v) > 1 THEN array_to_string(list_filter(v[2:], lambda w: w <> ''), ' ') ELSE v[1] END")


SECTION_HEADER = r"(?:^|[^\p{L}\p{N}_])([A-Z][A-Z ]*):"


def sentence_token_lists(x: str) -> str:
    return f"list_transform({sentences(x)}, lambda s: {space_tokens(rr('lower(s)', PY_SPACE + '+', ' '))})"


def procedure_after(x: str) -> str:
    marker = K.PROCEDURE_AFTER_MARKER
    tail = q("(?s)(?:" + marker.replace("(?i)", "") + ")(.*)")
    return (f"array_to_string(list_transform(list_filter(regexp_split_to_array({x}, '\\*+'), "
            f"lambda p: regexp_matches(p, {q(marker)})), lambda p: regexp_extract(p, {tail}, 1, 'i')), chr(10))")


def remove_sections(x: str, names=None) -> str:
    drop = lst(K.SECTIONS_TO_REMOVE if names is None else names)
    return let(f"regexp_split_to_array({x}, {q(SECTION_HEADER)})",
               f"array_to_string(list_filter(list_concat([{py_strip('v[1]')}], list_transform(list_filter("
               f"list_zip(regexp_extract_all({x}, {q(SECTION_HEADER)}, 1), v[2:]), lambda e: NOT list_contains({drop}, {py_strip('e[1]')})), "
               f"lambda e: {py_strip('e[1]')} || ': ' || {py_strip('e[2]')})), lambda w: w <> ''), ' ')")


def py_strip(x: str) -> str:
    return rr(x, f"^{PY_SPACE}+|{PY_SPACE}+$")


def first_integer(x: str) -> str:
    return f"nullif(regexp_extract({x}, '(\\p{{Nd}}+)', 1), '')"


# ----------------------------------------------------------------------------- evaluation CTEs
def long_cte(epoch: int = 0) -> str:
    parts = []
    for lab, mult in (("quality", 7919), ("toxic", 104729)):
        parts.append(f"SELECT doc_id AS row_id, '{lab}' AS label, CAST({lab} AS INTEGER) AS y_true, "
                     f"CAST(((doc_id * {mult} + {epoch} * 37) % 1000) AS DOUBLE) / 1000.0 AS score FROM labels")
    return " UNION ALL ".join(parts)


def cum_cte(src: str) -> str:
    return (f"SELECT label, score, pos, neg, "
            f"SUM(pos) OVER (PARTITION BY label ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tp, "
            f"SUM(neg) OVER (PARTITION BY label ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS fp, "
            f"SUM(pos) OVER (PARTITION BY label) AS P, SUM(neg) OVER (PARTITION BY label) AS N "
            f"FROM (SELECT label, score, SUM(y_true) AS pos, SUM(1 - y_true) AS neg FROM {src} GROUP BY label, score)")


CURVE = ("SELECT label, score AS threshold, CASE WHEN tp + fp = 0 THEN NULL ELSE tp::DOUBLE / (tp + fp) END AS precision, "
         "CASE WHEN P = 0 THEN NULL ELSE tp::DOUBLE / P END AS recall, tp, fp FROM cum WHERE tp - pos < P")
AUC = ("SELECT label, CASE WHEN P * N = 0 THEN NULL ELSE SUM(neg * ((tp - pos) + pos / 2.0)) / (P::DOUBLE * N) END AS auc "
       "FROM cum GROUP BY label, P, N")
AP = ("SELECT label, CASE WHEN P > 0 THEN SUM((pos::DOUBLE / P) * (tp::DOUBLE / (tp + fp))) END AS ap "
      "FROM cum GROUP BY label, P")
THR = ("SELECT label, FIRST(threshold ORDER BY abs(precision - recall), threshold) AS threshold FROM curve "
       "WHERE precision IS NOT NULL AND recall IS NOT NULL GROUP BY label")


def counts(src: str, pred: str) -> str:
    return (f"SELECT label, SUM(CASE WHEN {pred} = 1 AND y_true = 1 THEN 1 ELSE 0 END) AS tp, "
            f"SUM(CASE WHEN {pred} = 1 AND y_true = 0 THEN 1 ELSE 0 END) AS fp, "
            f"SUM(CASE WHEN {pred} = 0 AND y_true = 1 THEN 1 ELSE 0 END) AS fn, "
            f"SUM(CASE WHEN {pred} = 0 AND y_true = 0 THEN 1 ELSE 0 END) AS tn FROM {src} GROUP BY label")


PRF = ("SELECT label, tp, fp, fn, tn, CASE WHEN tp + fp = 0 THEN NULL ELSE tp::DOUBLE / (tp + fp) END AS precision, "
       "CASE WHEN tp + fn = 0 THEN NULL ELSE tp::DOUBLE / (tp + fn) END AS recall FROM cnt")
F1 = ("CASE WHEN precision IS NULL OR recall IS NULL OR precision + recall = 0 THEN NULL "
      "ELSE 2.0 * precision * recall / (precision + recall) END")


def report_ctes(epoch: int = 0, average: str = "micro", auc: str = "roc") -> str:
    rank = AUC if auc == "roc" else AP.replace(" AS ap ", " AS auc ")
    pooled = "pooled" if average == "micro" else "long"
    return (f"long AS ({long_cte(epoch)}), pooled AS (SELECT * FROM long UNION ALL SELECT row_id, '__pooled__', y_true, score FROM long), "
            f"cum AS ({cum_cte(pooled)}), rank AS ({rank}), "
            f"curve AS ({CURVE.replace('FROM cum WHERE', 'FROM cum WHERE label <> ' + q('__pooled__') + ' AND')}), "
            f"thr AS ({THR}), pred AS (SELECT long.*, CASE WHEN score > thr.threshold THEN 1 ELSE 0 END AS p "
            f"FROM long LEFT JOIN thr USING (label)), cnt AS ({counts('pred', 'p')}), prf AS ({PRF}), "
            f"per AS (SELECT prf.label, rank.auc, thr.threshold, precision, recall, {F1} AS f1 FROM prf "
            f"LEFT JOIN rank USING (label) LEFT JOIN thr USING (label)), "
            f"avg AS ({averaged(average)}), "
            f"avg_auc AS ({avg_auc(average)}), "
            f"report AS (SELECT label, auc, threshold, precision, recall, f1 FROM per UNION ALL "
            f"SELECT avg.average, avg_auc.auc, NULL, avg.precision, avg.recall, avg.f1 FROM avg, avg_auc)")


def averaged(average: str, src: str = "cnt") -> str:
    if average == "micro":
        return (f"SELECT 'micro' AS average, COALESCE(CASE WHEN SUM(tp) + SUM(fp) = 0 THEN NULL ELSE SUM(tp)::DOUBLE / (SUM(tp) + SUM(fp)) END, 0.0) AS precision, "
                f"COALESCE(CASE WHEN SUM(tp) + SUM(fn) = 0 THEN NULL ELSE SUM(tp)::DOUBLE / (SUM(tp) + SUM(fn)) END, 0.0) AS recall, "
                f"COALESCE(CASE WHEN SUM(tp) = 0 THEN NULL ELSE 2.0 * SUM(tp) / (2.0 * SUM(tp) + SUM(fp) + SUM(fn)) END, 0.0) AS f1 FROM {src}")
    per = (f"SELECT COALESCE(CASE WHEN tp + fp = 0 THEN NULL ELSE tp::DOUBLE / (tp + fp) END, 0.0) AS precision, "
           f"COALESCE(CASE WHEN tp + fn = 0 THEN NULL ELSE tp::DOUBLE / (tp + fn) END, 0.0) AS recall, "
           f"COALESCE(CASE WHEN tp = 0 THEN NULL ELSE 2.0 * tp / (2.0 * tp + fp + fn) END, 0.0) AS f1, tp + fn AS support FROM {src}")
    if average == "macro":
        return f"SELECT 'macro' AS average, AVG(precision) AS precision, AVG(recall) AS recall, AVG(f1) AS f1 FROM ({per})"
    return ("SELECT 'weighted' AS average, SUM(precision * support) / SUM(support) AS precision, "
            f"SUM(recall * support) / SUM(support) AS recall, SUM(f1 * support) / SUM(support) AS f1 FROM ({per})")


def avg_auc(average: str) -> str:
    if average == "micro":
        return "SELECT auc FROM rank WHERE label = '__pooled__'"
    if average == "macro":
        return "SELECT AVG(auc) AS auc FROM rank"
    return ("SELECT SUM(rank.auc * (cnt.tp + cnt.fn)) / SUM(cnt.tp + cnt.fn) AS auc FROM rank JOIN cnt USING (label)")


def r6(x: str) -> str:
    return f"round(CAST({x} AS DOUBLE), 6)"


def bce_expr(p: str = "score", y: str = "y_true") -> str:
    lnp = f"CASE WHEN {p} <= 0 THEN -100.0 ELSE greatest(ln({p}), -100.0) END"
    ln1p = f"CASE WHEN 1.0 - {p} <= 0 THEN -100.0 ELSE greatest(ln(1.0 - {p}), -100.0) END"
    return f"-({y} * {lnp} + (1 - {y}) * {ln1p})"


def history_sql(epochs: int = 3) -> str:
    parts = []
    for e in range(epochs):
        parts.append(
            f"(WITH {report_ctes(e)} "
            f"SELECT 'run0' AS run_id, CAST({e} AS BIGINT) AS epoch, 'test' AS split, label, metric, value FROM ("
            + " UNION ALL ".join(f"SELECT label, '{m}' AS metric, {m} AS value FROM report"
                                 for m in ("auc", "precision", "recall", "f1"))
            + ") "
            f"UNION ALL SELECT 'run0', CAST({e} AS BIGINT), 'test', 'all', 'loss', AVG({bce_expr()}) FROM long)")
    return " UNION ALL ".join(parts)


# ----------------------------------------------------------------------------- statements
CODES = ["AF", "AO", "NF", "NO", "RF", "RO"]  # fixed values of the test design (TPC-H flag pairs)


def code_pivot() -> str:
    cols = ", ".join(f"COALESCE(SUM(CASE WHEN code = '{c}' THEN l_quantity END), 0) AS CPT_{c}" for c in CODES)
    return f"SELECT l_orderkey, {cols} FROM (SELECT *, l_returnflag || l_linestatus AS code FROM lineitem) GROUP BY l_orderkey"


def split_rank(table: str, key: str) -> str:
    return (f"SELECT *, row_number() OVER (ORDER BY md5('42:' || CAST({key} AS VARCHAR)), {key}) - 1 AS rn, "
            f"count(*) OVER () AS n FROM {table}")


def t_critical_sql(dof: str) -> str:
    tab = "[" + ", ".join(repr(v) + "::DOUBLE" for v in tdist.t_table(0.95)) + "]"
    z, g1, g2, g3 = tdist.cornish_fisher_terms(0.95)
    v = f"CAST({dof} AS DOUBLE)"
    approx = f"({z!r} + {g1!r} / {v} + {g2!r} / ({v} * {v}) + {g3!r} / ({v} * {v} * {v}))"
    return f"CASE WHEN {dof} < 1 THEN NULL WHEN {dof} <= {tdist.TABLE_DOF} THEN {tab}[{dof}] ELSE {approx} END"


def _abbrev_sql() -> str:
    from .queries import ABBREVIATIONS

    def cnt(c):
        return f"((length(text) - length(replace(text, {q(c)}, ''))) // length({q(c)}))"

    whens = []
    for k in sorted(ABBREVIATIONS):
        cands = ABBREVIATIONS[k]
        best = q(cands[0])
        # first candidate wins ties; a later one only with a strictly larger count
        for i in range(1, len(cands)):
            prev = cands[:i]
            cond = " AND ".join(f"{cnt(cands[i])} > {cnt(p)}" for p in prev)
            best = f"CASE WHEN {cond} THEN {q(cands[i])} ELSE {best} END"
        whens.append(f"WHEN t = {q(k)} THEN {best}")
    return (f"SELECT doc_id, array_to_string(list_transform(string_split(text, ' '), lambda t: CASE {' '.join(whens)} "
            f"ELSE t END), ' ') AS expanded FROM documents")


def oracle_sql() -> dict[str, str]:
    o: dict[str, str] = {}
    o["s1_note_scan"] = "SELECT conv_id, turn, role, text FROM conversations WHERE text IS NOT NULL AND role IN ('user', 'assistant')"
    o["s2_multi_source"] = ("SELECT 'document' AS note_type, doc_id AS note_key, CAST(0 AS BIGINT) AS line, text FROM documents "
                            "UNION ALL SELECT 'dialog', conv_id, turn, text FROM conversations "
                            "WHERE text IS NOT NULL AND role IN ('user', 'assistant')")
    o["s3_registry_scan"] = "SELECT doc_id, CAST(quality AS BIGINT) AS quality, CAST(toxic AS BIGINT) AS toxic FROM labels"
    cpt = ", ".join(f"{r6('CPT_' + c)} AS CPT_{c}" for c in CODES)
    o["s4_code_features"] = (f"SELECT f.l_orderkey, strftime(o.o_orderdate, '%Y-%m-%d') AS order_date, {cpt} "
                             f"FROM ({code_pivot()}) f JOIN orders o ON f.l_orderkey = o.o_orderkey")
    o["s4b_code_totals"] = (f"SELECT l_orderkey, l_returnflag || l_linestatus AS code, {r6('SUM(l_quantity)')} AS value FROM lineitem "
                            "GROUP BY l_orderkey, l_returnflag || l_linestatus")
    o["s3b_tolerant_scan"] = (
        "WITH l AS (SELECT doc_id, CAST(quality AS BIGINT) AS quality, CAST(toxic AS BIGINT) AS toxic, "
        "CASE WHEN doc_id % 7 = 3 THEN 'type' WHEN doc_id % 11 = 5 THEN 'few' WHEN doc_id % 13 = 1 THEN 'many' END AS broken FROM labels), "
        "r AS (SELECT doc_id, CASE WHEN broken = 'type' THEN NULL ELSE quality END AS quality, CASE WHEN broken = 'few' THEN NULL ELSE toxic END AS toxic, "
        "CASE broken WHEN 'type' THEN doc_id || ',oops,' || coalesce(toxic::VARCHAR, '') WHEN 'few' THEN doc_id || ',' || coalesce(quality::VARCHAR, '') "
        "WHEN 'many' THEN doc_id || ',' || coalesce(quality::VARCHAR, '') || ',' || coalesce(toxic::VARCHAR, '') || ',more' END AS rejected_line FROM l) "
        "SELECT *, count(*) OVER () AS n_rows, count(rejected_line) OVER () AS n_rejects FROM r")
    o["s4c_code_vectors"] = (
        "WITH t AS (SELECT l_orderkey, p_brand AS code, SUM(l_quantity) AS value FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_brand IS NOT NULL GROUP BY ALL), "
        "c AS (SELECT code, row_number() OVER (ORDER BY code) - 1 AS code_id, count(*) OVER () AS n_codes FROM (SELECT DISTINCT code FROM t)) "
        "SELECT l_orderkey, n_codes, row_number() OVER (PARTITION BY l_orderkey ORDER BY code_id) - 1 AS pos, code_id, "
        f"{r6('value')} AS value FROM t JOIN c ON t.code = c.code WHERE value <> 0")
    o["s5_split_export"] = (f"SELECT doc_id, lang FROM ({split_rank('documents', 'doc_id')}) "
                            "WHERE rn >= floor((((1.0::DOUBLE - 0.8::DOUBLE) / 2.0::DOUBLE) + 0.8::DOUBLE) * n)")
    o["s6_results_table"] = (f"WITH {report_ctes()} SELECT label, {r6('auc')} AS valid_auc, {r6('f1')} AS valid_f1, "
                             f"{r6('precision')} AS valid_precision, {r6('recall')} AS valid_recall FROM report")
    o["s7_prediction_dump"] = (f"WITH {report_ctes()} SELECT 'run0' AS run_id, CAST(0 AS BIGINT) AS epoch, row_id, label, "
                               f"y_true, p AS y_pred FROM pred")
    o["s8_frequency_table"] = (f"SELECT token, CAST(count(*) AS BIGINT) AS n FROM (SELECT unnest({unicode_words('text')}) AS token "
                               f"FROM documents) GROUP BY token")
    o["s9_metric_history"] = f"SELECT run_id, epoch, split, label, metric, {r6('value')} AS value FROM ({history_sql()})"

    o["p1_select_by_prefix"] = "SELECT p_partkey, p_brand, p_type, CAST(p_size AS BIGINT) AS p_size, p_retailprice FROM part"
    o["p2_drop_nulls"] = ("SELECT d.doc_id, lang, n_chars, CAST(quality AS BIGINT) AS quality, CAST(toxic AS BIGINT) AS toxic "
                          "FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE lang IS NOT NULL AND "
                          "n_chars IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL")
    o["p3_regex_filter"] = "SELECT doc_id, lang, source FROM documents WHERE regexp_matches(text, '(?i)nicht|the sh')"
    o["p4_min_words"] = f"SELECT conv_id, turn FROM conversations WHERE len({py_split('text')}) > 5"
    o["p5_empty_to_null"] = ("SELECT doc_id, digits FROM (SELECT doc_id, regexp_replace(text, '[^0-9]', '', 'g') AS digits "
                             "FROM documents) WHERE digits <> ''")
    o["p6_label_cast_fill"] = ("SELECT d.doc_id, CAST(COALESCE(quality, 0) AS BIGINT) AS quality, CAST(COALESCE(toxic, 0) AS BIGINT) "
                               "AS toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id")
    o["p7_lenient_cast"] = ("SELECT event_id, COALESCE(TRY_CAST(trim(regexp_extract(props, ':\\s*([^}]*)\\}', 1)) AS BIGINT), 0) AS k, "
                            "COALESCE(TRY_CAST(event_type AS BIGINT), 0) AS type_as_int FROM events")
    o["p8_first_line"] = "SELECT conv_id, role, text FROM conversations WHERE turn = 0"
    o["p9_str2bool"] = ("SELECT o_orderkey, CAST(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS BIGINT) AS status_flag, "
                        "CAST(CASE WHEN starts_with(o_orderpriority, '1') THEN 1 ELSE 0 END AS BIGINT) AS urgent_flag "
                        "FROM orders WHERE o_orderstatus IN ('F', 'O')")
    o["p10_drop_nan_literal"] = ("SELECT event_id, tag FROM (SELECT event_id, CASE WHEN value > 50 THEN 'nan' ELSE event_type END "
                                 "AS tag FROM events) WHERE tag IS NOT NULL AND tag <> 'nan'")

    o["j1_notes_registry"] = ("SELECT d.doc_id, CAST(quality AS BIGINT) AS quality, CAST(toxic AS BIGINT) AS toxic, lang, source, "
                              "n_chars FROM documents d JOIN labels l ON d.doc_id = l.doc_id")
    o["j2_join_dropping"] = (f"SELECT c.c_custkey AS custkey, o_orderkey, {r6('o_totalprice')} AS o_totalprice, c_name, "
                             f"c_mktsegment, CAST(c_nationkey AS BIGINT) AS c_nationkey FROM orders o JOIN customer c "
                             f"ON o.o_custkey = c.c_custkey")
    o["j3_join_dedup"] = (f"SELECT orderkey, o_custkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey, "
                          f"{r6('l_quantity')} AS l_quantity FROM (SELECT o.o_orderkey AS orderkey, o_custkey, l_linenumber, "
                          f"l_partkey, l_quantity, row_number() OVER (PARTITION BY o.o_orderkey ORDER BY l_linenumber, "
                          f"o_custkey, l_partkey, l_quantity) AS rn FROM orders o JOIN lineitem l ON o.o_orderkey = l.l_orderkey) "
                          f"WHERE rn = 1")
    o["j4_small_dimension"] = ("SELECT c_custkey, CAST(c_nationkey AS BIGINT) AS nationkey, n_name, CAST(n_regionkey AS BIGINT) "
                               "AS n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey")
    o["j5_split_features"] = (f"SELECT s.o_orderkey AS l_orderkey, CASE WHEN rn < floor(0.8::DOUBLE * n) THEN 'train' ELSE 'test' END "
                              f"AS split, o_orderpriority, {cpt} FROM ({split_rank('orders', 'o_orderkey')}) s "
                              f"JOIN ({code_pivot()}) f ON s.o_orderkey = f.l_orderkey")
    o["j6_abbrev_expand"] = _abbrev_sql()
    gram = lambda t, k, p: (f"SELECT {k}, i AS {p}, array_to_string(w[i + 1:i + 8], ' ') AS g FROM (SELECT {k}, w, "  # noqa: E731
                            f"unnest(range(0, len(w) - 7)) AS i FROM (SELECT {k}, {py_split('text')} AS w FROM {t}) "
                            f"WHERE len(w) >= 8)")
    o["j7_longest_shared_passage"] = (
        f"WITH ga AS ({gram('documents', 'doc_id', 'pa')}), gb AS ({gram('benchmark', 'item_id', 'pb')}), "
        "hits AS (SELECT doc_id, item_id, pa, pb - pa AS d FROM ga JOIN gb USING (g)), "
        "isl AS (SELECT *, pa - row_number() OVER (PARTITION BY doc_id, item_id, d ORDER BY pa) AS island FROM hits), "
        "runs AS (SELECT doc_id, item_id, min(pa) AS start_a, min(pa) + d AS start_b, count(*) + 7 AS size "
        "FROM isl GROUP BY doc_id, item_id, d, island), "
        "best AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY size DESC, start_a, start_b) AS rn FROM runs) "
        "SELECT doc_id, item_id, CAST(start_a AS BIGINT) AS start_a, CAST(start_b AS BIGINT) AS start_b, "
        "CAST(size AS BIGINT) AS size FROM best WHERE rn = 1")

    o["a1_keyed_dedup"] = ("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id "
                           "ORDER BY ts, event_id, event_type) AS rn FROM events) WHERE rn = 1")
    o["a2_note_concat"] = ("SELECT conv_id, role, string_agg(text, chr(10) ORDER BY turn) AS concat_text FROM "
                           "(SELECT conv_id, role, turn, min(text) AS text FROM conversations WHERE conv_id IS NOT NULL "
                           "AND role IS NOT NULL AND text IS NOT NULL GROUP BY conv_id, role, turn) GROUP BY conv_id, role")
    o["a3_sort_group_concat"] = ("SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS concat_text FROM conversations "
                                 "WHERE conv_id IS NOT NULL AND turn IS NOT NULL AND role IS NOT NULL AND text IS NOT NULL "
                                 "GROUP BY conv_id")
    o["a4_grouped_text_concat"] = (f"SELECT lang, CAST(doc_id // 1000 AS BIGINT) AS chunk, string_agg(kw, ' ' ORDER BY doc_id) "
                                   f"AS corpus_text FROM (SELECT lang, doc_id, {keywords('text')} AS kw FROM documents) "
                                   f"GROUP BY lang, doc_id // 1000")
    o["a5_token_frequency"] = (f"SELECT token, CAST(count(*) AS BIGINT) AS n FROM (SELECT unnest({unicode_words('text')}) AS token "
                               f"FROM documents) GROUP BY token")
    o["a6_top_terms"] = (f"SELECT token, CAST(count(*) AS BIGINT) AS n FROM (SELECT unnest({unicode_words('text')}) AS token "
                         f"FROM documents) WHERE NOT list_contains({lst(K.NLTK_ENGLISH_STOPWORDS)}, token) GROUP BY token "
                         f"ORDER BY n DESC, token LIMIT 100")
    o["a7_word_counts"] = (f"SELECT doc_id, CAST(len({py_split('text')}) AS BIGINT) AS n_words, "
                           f"CAST(len(list_distinct({py_split('text')})) AS BIGINT) AS n_distinct_words FROM documents")
    o["a7b_word_counts_keywords"] = (f"SELECT doc_id, CAST(len({py_split('kw')}) AS BIGINT) AS n_words, "
                                     f"CAST(len(list_distinct({py_split('kw')})) AS BIGINT) AS n_distinct_words "
                                     f"FROM (SELECT doc_id, {keywords('text')} AS kw FROM documents)")
    o["a8_rare_mask"] = ("WITH s AS (SELECT role, count(*)::DOUBLE / SUM(count(*)) OVER () AS share FROM conversations "
                         "WHERE role IS NOT NULL GROUP BY role) SELECT conv_id, turn, CASE WHEN role IS NULL THEN NULL "
                         "WHEN role IN (SELECT role FROM s WHERE share >= 0.05) THEN role ELSE 'NULL' END AS role FROM conversations")
    prios = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]  # fixed values of the test design
    hot = ", ".join(f"CAST(CASE WHEN o_orderpriority = {q(p)} THEN 1 ELSE 0 END AS BIGINT) AS \"o_orderpriority_{p.replace('-', '_')}\""
                    for p in prios)
    o["a9_one_hot"] = f"SELECT o_orderkey, {hot} FROM orders"
    o["a10_label_prevalence"] = (
        "WITH r AS (SELECT 'quality' AS label, SUM(CASE WHEN quality = 1 THEN 1 ELSE 0 END)::DOUBLE / count(*) AS pos_rate FROM labels "
        "UNION ALL SELECT 'toxic', SUM(CASE WHEN toxic = 1 THEN 1 ELSE 0 END)::DOUBLE / count(*) FROM labels) "
        f"SELECT label, {r6('pos_rate')} AS pos_rate, CAST(SUM(CASE WHEN pos_rate > 0.2 THEN 1 ELSE 0 END) OVER () AS BIGINT) AS n_passing, "
        f"CAST(CASE WHEN pos_rate > 0.2 AND NOT list_contains({lst(K.IGNORED_LABELS)}, label) THEN 1 ELSE 0 END AS BIGINT) AS kept FROM r")
    o["a11_class_weights"] = ("SELECT CAST(label AS BIGINT) AS class, CAST(count(*) AS BIGINT) AS n, "
                              "round((1.0 / count(*)) / SUM(1.0 / count(*)) OVER (), 6) AS weight FROM embeddings "
                              "WHERE label IS NOT NULL GROUP BY label")
    lw = []
    for lab in ("quality", "toxic"):
        lw.append(f"SELECT '{lab}' AS label, 'null' AS how, count(*) AS n, SUM(CASE WHEN {lab} IS NULL THEN 1 ELSE 0 END) AS c FROM j")
        lw.append(f"SELECT '{lab}', 'positive', count(*), SUM(CASE WHEN {lab} = 1 THEN 1 ELSE 0 END) FROM j")
    o["a12_loss_weights"] = (
        "WITH j AS (SELECT d.doc_id, quality, toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id), "
        f"c AS ({' UNION ALL '.join(lw)}), s AS (SELECT label, how, CASE WHEN COALESCE(c, 0) = 0 THEN floor(sqrt(n)) ELSE c END::DOUBLE / n AS share FROM c) "
        f"SELECT label, how, {r6('0.05 + 0.9 * CASE WHEN how = ' + q('null') + ' THEN share ELSE 1.0 - share END')} AS weight FROM s")
    o["a13_subgroup_summary"] = (
        f"WITH b AS (SELECT l.doc_id, quality, toxic, CAST(n_chars AS DOUBLE) AS n_chars, CAST(len({py_split('text')}) AS DOUBLE) AS n_words, "
        "('0x' || substr(md5('42:' || CAST(l.doc_id AS VARCHAR)), 1, 8))::BIGINT AS slot "
        "FROM labels l JOIN documents d ON l.doc_id = d.doc_id), "
        "u AS (SELECT doc_id, slot, 'quality' AS flag, n_chars, n_words FROM b WHERE quality = 1 "
        "UNION ALL SELECT doc_id, slot, 'toxic', n_chars, n_words FROM b WHERE toxic = 1), "
        "v AS (SELECT slot, flag, 'n_chars' AS outcome, n_chars AS value FROM u UNION ALL SELECT slot, flag, 'n_words', n_words FROM u), "
        "f AS (SELECT unnest([1.0::DOUBLE, 0.5::DOUBLE, 0.1::DOUBLE]) AS fraction) "
        f"SELECT fraction, flag, outcome, CAST(count(value) AS BIGINT) AS n, {r6('avg(value)')} AS mean, {r6('stddev_samp(value)')} AS std "
        "FROM v, f WHERE slot < fraction * 4294967296.0 GROUP BY fraction, flag, outcome")
    o["a14_mean_ci"] = (
        "WITH g AS (SELECT lang, avg(CAST(n_chars AS DOUBLE)) AS mean, stddev_samp(CAST(n_chars AS DOUBLE)) AS std, count(n_chars) AS n "
        "FROM documents WHERE n_chars IS NOT NULL AND NOT isnan(CAST(n_chars AS DOUBLE)) GROUP BY lang), "
        f"h AS (SELECT *, {t_critical_sql('n - 1')} * std / sqrt(n) AS half_width FROM g) "
        f"SELECT lang, CAST(n AS BIGINT) AS n, {r6('mean')} AS mean, {r6('std')} AS std, {r6('half_width')} AS half_width, "
        f"{r6('mean - half_width')} AS ci_lower, {r6('mean + half_width')} AS ci_upper FROM h")
    o["a15_best_per_label"] = (f"SELECT run_id, label, metric, {r6('max(COALESCE(CASE WHEN isnan(value) THEN 0.0 ELSE value END, 0.0))')} "
                               f"AS best_value FROM ({history_sql()}) WHERE split = 'test' GROUP BY run_id, label, metric")
    o["a16_best_epoch"] = (f"SELECT run_id, FIRST(epoch ORDER BY value, epoch) AS best_epoch, {r6('min(value)')} AS best_loss "
                           f"FROM ({history_sql()}) WHERE metric = 'loss' AND split = 'test' AND label = 'all' GROUP BY run_id")

    o["r1_random_split"] = ("SELECT doc_id, CASE WHEN rn < floor(0.8::DOUBLE * n) THEN 'train' "
                            "WHEN rn < floor((((1.0::DOUBLE - 0.8::DOUBLE) / 2.0::DOUBLE) + 0.8::DOUBLE) * n) THEN 'validation' "
                            f"ELSE 'test' END AS split FROM ({split_rank('documents', 'doc_id')})")
    o["r2_cohort_split"] = (
        "WITH c AS (SELECT doc_id, CASE WHEN source <> 'src0' THEN 'train' ELSE 'test' END AS side FROM documents "
        "WHERE lang = 'en' AND source IS NOT NULL), "
        "t AS (SELECT doc_id, row_number() OVER (ORDER BY md5('42:' || CAST(doc_id AS VARCHAR)), doc_id) - 1 AS rn, count(*) OVER () AS n "
        "FROM c WHERE side = 'train') "
        "SELECT c.doc_id, CASE WHEN t.rn IS NOT NULL AND t.rn < round_even(0.15::DOUBLE * t.n, 0) THEN 'validation' ELSE c.side END AS split "
        "FROM c LEFT JOIN t ON c.doc_id = t.doc_id")
    o["r3_exact_sample"] = f"SELECT doc_id, lang FROM ({split_rank('documents', 'doc_id')}) WHERE rn < floor(0.1::DOUBLE * n)"

    o["r3b_hash_sample"] = ("SELECT doc_id, lang FROM documents WHERE "
                            "('0x' || substr(md5('42:' || CAST(doc_id AS VARCHAR)), 1, 8))::BIGINT < 0.1::DOUBLE * 4294967296.0")
    o["t1_keywords"] = f"SELECT doc_id, {keywords('text')} AS keywords FROM documents"
    o["t1b_keywords_lemma"] = (
        f"WITH k AS (SELECT doc_id, {keywords('text')} AS kw FROM documents), "
        "v AS (SELECT DISTINCT unnest(string_split(kw, ' ')) AS w FROM k), "
        "r AS (SELECT w, e, left(w, length(w) - length(e)) AS lemma FROM v, (SELECT unnest(['ing', 'ed', 'es', 'en']) AS e) WHERE suffix(w, e)), "
        "l AS (SELECT w, arg_max(lemma, length(e)) AS lemma FROM r WHERE lemma IN (SELECT w FROM v WHERE w <> '') GROUP BY w), "
        "t AS (SELECT doc_id, unnest(string_split(kw, ' ')) AS w, generate_subscripts(string_split(kw, ' '), 1) AS p FROM k) "
        "SELECT doc_id, string_agg(coalesce(l.lemma, t.w), ' ' ORDER BY p) AS keywords FROM t LEFT JOIN l ON l.w = t.w GROUP BY doc_id")
    o["t2_clean_report"] = f"SELECT doc_id, {clean_report('text')} AS cleaned FROM documents"
    o["t3_nondiagnostic"] = f"SELECT doc_id, {nondiagnostic('text')} AS cleaned FROM documents"
    mtext = ("'EF ' || CAST(l_quantity AS VARCHAR) || ' cm on ' || strftime(l_shipdate, '%Y-%m-%d') || ', gave ' || "
             "CAST(l_linenumber AS VARCHAR) || ' mg and 3 stents'")
    o["t4_measurements"] = (f"SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, {remove_measurements(mtext)} AS cleaned "
                            f"FROM lineitem")
    ttext = ("event_type || ' seen in ' || strftime(ts, '%B') || ' on ' || strftime(ts, '%d/%m/%Y') || ' at ' || "
             "strftime(ts, '%H:%M') || ' pm, Mayo examined'")
    o["t5_time_info"] = f"SELECT event_id, {remove_time_info(ttext)} AS cleaned FROM events"
    o["t6_dr_names"] = ("SELECT c_custkey, regexp_replace('Seen by Dr. ' || c_name || ' and dr.  ' || c_mktsegment, "
                        "'(?i)dr\\.\\s+[A-Z][a-z]+', '', 'g') AS cleaned FROM customer")
    o["t7_strip_punctuation"] = (f"SELECT doc_id, array_to_string(list_transform({sentences('text')}, lambda s: "
                                 f"translate(s, {q(K.PUNCTUATION)}, '')), chr(10)) AS cleaned FROM documents")
    strip = rr("lower(text)", f"^{PY_SPACE}+|{PY_SPACE}+$")
    o["t8_line_table"] = (f"SELECT doc_id, CAST(unnest(range(len(l))) AS BIGINT) AS line_no, unnest(l) AS line FROM "
                          f"(SELECT doc_id, list_filter(regexp_split_to_array({strip}, {q(PY_LINE_BREAK)}), lambda w: w <> '') AS l "
                          f"FROM documents)")
    o["t9_cut_words"] = (f"SELECT doc_id, CASE WHEN len({py_split('text')}) <= 100 THEN text ELSE "
                         f"array_to_string(list_slice({py_split('text')}, 1, 100), ' ') END AS cut FROM documents")
    o["t10_sentence_table"] = (
        f"WITH s AS (SELECT doc_id, unnest(l) AS s, unnest(range(len(l))) AS pos FROM (SELECT doc_id, {sentences('text')} AS l "
        f"FROM documents)), g AS (SELECT *, SUM(CASE WHEN pos = 0 OR len({py_split('s')}) >= 3 THEN 1 ELSE 0 END) OVER "
        "(PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 AS grp FROM s) "
        "SELECT doc_id, CAST(grp AS BIGINT) AS sent_no, string_agg(s, ' ' ORDER BY pos) AS sentence FROM g GROUP BY doc_id, grp")
    stext = ("'DATE: ' || source || ' LANGUAGE: ' || lang || ' NOTE: ' || text || ' SURGEON: ' || source || "
             "' FINDINGS: ' || CAST(n_chars AS VARCHAR)")
    o["t11_section_table"] = (
        f"SELECT doc_id, sec_no, {py_strip('h1')} AS header, {py_strip('b1')} AS body FROM (SELECT doc_id, "
        f"CAST(unnest(range(len(h))) AS BIGINT) AS sec_no, unnest(h) AS h1, unnest(b) AS b1 FROM "
        f"(SELECT doc_id, regexp_extract_all(t, {q(SECTION_HEADER)}, 1) AS h, regexp_split_to_array(t, {q(SECTION_HEADER)})[2:] AS b "
        f"FROM (SELECT doc_id, {stext} AS t FROM documents)))")
    htext = "CASE WHEN lang = 'en' THEN 'Reason for visit. Past Medical History: ' || text ELSE text END"
    o["t12_history_filter"] = f"SELECT doc_id, {history_sections(htext)} AS history FROM documents"
    ptext = ("CASE WHEN lang = 'de' THEN 'Name of Operation: ' || text || ' #: Procedure type: ' || source ELSE "
             "'Indication: ' || lang || ' PROCEDURE: ' || text || ' FINDINGS: ok ** Operative Report: ' || source || ' DISPOSITION: home' END")
    marker = K.PROCEDURE_AFTER_MARKER
    start = {"p": f"(?s)^.*?(?:{K.PROCEDURE_PRIMARY_STARTS})(.*)$", "s": f"(?s)^.*?(?:{K.PROCEDURE_SECONDARY_STARTS})(.*)$"}
    span_end = r"(?s)^(.*?)(?:(?i:\b\w+:)|\*+|#:|\z)"
    strip_span = rr("span", f"^{PY_SPACE}+|{PY_SPACE}+$")
    o["t13_procedure_section"] = (
        f"WITH RECURSIVE t AS (SELECT doc_id, x, regexp_matches(x, {q(K.PROCEDURE_PRIMARY_STARTS)}) AS prim FROM "
        f"(SELECT doc_id, {ptext} AS x FROM documents)), "
        "r AS (SELECT doc_id, prim, 0 AS i, x AS rest, CAST(NULL AS VARCHAR) AS span FROM t UNION ALL "
        "SELECT doc_id, prim, i + 1, substr(tail, length(sp) + 1), sp FROM (SELECT doc_id, prim, i, tail, "
        f"regexp_extract(tail, {q(span_end)}, 1) AS sp FROM (SELECT doc_id, prim, i, CASE WHEN prim THEN regexp_extract(rest, {q(start['p'])}, 1) "
        f"ELSE regexp_extract(rest, {q(start['s'])}, 1) END AS tail FROM r WHERE (prim AND regexp_matches(rest, {q(K.PROCEDURE_PRIMARY_STARTS)})) "
        f"OR (NOT prim AND regexp_matches(rest, {q(K.PROCEDURE_SECONDARY_STARTS)}))))), "
        f"c AS (SELECT doc_id, i, {strip_span} AS span FROM r WHERE i > 0) "
        "SELECT t.doc_id, COALESCE(string_agg(c.span, ' ' ORDER BY i) FILTER (WHERE c.span <> ''), '') AS procedure "
        "FROM t LEFT JOIN c ON t.doc_id = c.doc_id GROUP BY t.doc_id")
    o["t14_procedure_after"] = (
        f"SELECT doc_id, array_to_string(list_transform(list_filter(regexp_split_to_array({ptext}, '\\*+'), "
        f"lambda p: regexp_matches(p, {q(marker)})), lambda p: regexp_extract(p, {q('(?s)(?:' + marker.replace('(?i)', '') + ')(.*)')}, 1, 'i')), chr(10)) "
        f"AS procedure FROM documents")
    o["t15_remove_sections"] = f"SELECT doc_id, {remove_sections('t')} AS report FROM (SELECT doc_id, {stext} AS t FROM documents)"
    o["t16_dict_column"] = ("SELECT key, CAST(count(*) AS BIGINT) AS n, round(SUM(TRY_CAST(value AS DOUBLE)), 6) AS total FROM "
                            "(SELECT k AS key, json_extract_string(j, '$.\"' || k || '\"') AS value FROM (SELECT j, unnest(json_keys(j)) AS k "
                            "FROM (SELECT replace(replace(props, '''', '\"'), 'u\"', '\"') AS j FROM events))) GROUP BY key")
    ltext = "'[''' || lang || ''', ''' || source || ''', '''']'"
    o["t17_list_column"] = (f"SELECT item, CAST(count(*) AS BIGINT) AS n FROM (SELECT unnest(list_filter(list_transform(string_split("
                            f"regexp_replace({ltext}, '^[\\]\\[]+|[\\]\\[]+$', '', 'g'), ', '), lambda x: replace(x, '''', '')), "
                            f"lambda x: x <> '')) AS item FROM documents) GROUP BY item")
    o["t18_first_integer"] = ("SELECT brand_no, CAST(count(*) AS BIGINT) AS n, round(avg(p_retailprice), 6) AS avg_price FROM "
                              "(SELECT nullif(regexp_extract(p_brand, '(\\p{Nd}+)', 1), '') AS brand_no, p_retailprice FROM part) "
                              "GROUP BY brand_no")
    o["t19_flatten"] = (f"SELECT doc_id, CAST(unnest(range(len(f))) AS BIGINT) AS pos, unnest(f) AS item FROM "
                        f"(SELECT doc_id, flatten({sentence_token_lists('text')}) AS f FROM documents)")
    o["t20_cleaning_chain"] = (f"SELECT doc_id, cleaned FROM (SELECT doc_id, {nondiagnostic(history_sections(htext))} AS cleaned "
                               f"FROM documents) WHERE cleaned <> ''")

    o["t20b_cleaning_report"] = (
        f"WITH c0 AS (SELECT lang, {htext} AS a FROM documents), c1 AS (SELECT *, {history_sections('a')} AS b FROM c0), "
        f"c2 AS (SELECT lang, a, b, {remove_time_info('b')} AS c FROM c1), c3 AS (SELECT *, {nondiagnostic('c')} AS d FROM c2), "
        "s AS (SELECT lang, 0 AS step_no, 'history' AS step, a AS x, b AS y FROM c3 UNION ALL SELECT lang, 1, 'time_info', b, c FROM c3 "
        "UNION ALL SELECT lang, 2, 'nondiagnostic', c, d FROM c3) "
        "SELECT lang, CAST(step_no AS BIGINT) AS step_no, step, count(*) AS n_rows, CAST(SUM(CASE WHEN x <> y THEN 1 ELSE 0 END) AS BIGINT) AS n_changed, "
        "CAST(SUM(CASE WHEN x <> '' AND y = '' THEN 1 ELSE 0 END) AS BIGINT) AS n_emptied, CAST(SUM(length(x)) AS BIGINT) AS chars_before, "
        "CAST(SUM(length(y)) AS BIGINT) AS chars_after FROM s GROUP BY lang, step_no, step")

    words = unicode_words("text")
    o["k1_vocab_encode"] = (
        f"WITH w AS (SELECT doc_id, list_slice({words}, 1, 510) AS ws FROM documents), "
        f"vocab AS (SELECT token, token_id FROM (SELECT token, row_number() OVER (ORDER BY n DESC, token) + 3 AS token_id FROM "
        f"(SELECT token, count(*) AS n FROM (SELECT unnest({words}) AS token FROM documents) GROUP BY token))), "
        "t AS (SELECT doc_id, unnest(ws) AS token, unnest(range(len(ws))) AS pos FROM w), "
        "ids AS (SELECT w.doc_id, COALESCE(list(COALESCE(v.token_id, 0) ORDER BY t.pos) FILTER (WHERE t.pos IS NOT NULL), []) AS ids "
        "FROM w LEFT JOIN t ON w.doc_id = t.doc_id LEFT JOIN vocab v ON t.token = v.token GROUP BY w.doc_id) "
        "SELECT doc_id, array_to_string(list_resize(list_concat([2], ids, [3]), 512, 1), ',') AS input_ids, "
        "array_to_string(list_resize(list_transform(range(len(ids) + 2), lambda x: 1), 512, 0), ',') AS attention_mask FROM ids")
    vocab = (f"vocab AS (SELECT token, row_number() OVER (ORDER BY n DESC, token) + 3 AS token_id FROM (SELECT token, count(*) AS n "
             f"FROM (SELECT unnest({words}) AS token FROM documents) GROUP BY token))")
    stripped = f"translate(s, {q(K.PUNCTUATION)}, '')"
    o["k2_flatten_ids"] = (
        f"WITH {vocab}, s0 AS (SELECT doc_id, unnest(l) AS s, unnest(range(len(l))) AS pos FROM (SELECT doc_id, {sentences('text')} AS l "
        f"FROM documents)), g AS (SELECT *, SUM(CASE WHEN pos = 0 OR len({py_split('s')}) >= 3 THEN 1 ELSE 0 END) OVER "
        "(PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS grp FROM s0), "
        "m AS (SELECT doc_id, grp, string_agg(s, ' ' ORDER BY pos) AS s FROM g GROUP BY doc_id, grp), "
        f"w AS (SELECT doc_id, grp, {space_tokens(rr(f'lower({stripped})', PY_SPACE + '+', ' '))} AS ws FROM m), "
        "t AS (SELECT doc_id, grp, unnest(ws) AS token, unnest(range(len(ws))) AS pos FROM w "
        "UNION ALL SELECT doc_id, grp, NULL, 1000000000 FROM w), "
        "i AS (SELECT doc_id, grp, pos, CASE WHEN t.token IS NULL THEN 3 ELSE COALESCE(v.token_id, 0) END AS id FROM t LEFT JOIN vocab v ON t.token = v.token), "
        "f AS (SELECT doc_id, list_concat([2], list(id ORDER BY grp, pos)) AS k FROM i GROUP BY doc_id) "
        "SELECT doc_id, array_to_string(CASE WHEN len(k) >= 512 THEN list_concat(k[1:511], [3]) ELSE list_resize(k, 512, 1) END, ',') "
        "AS input_ids, array_to_string(CASE WHEN len(k) >= 512 THEN list_resize([1], 512, 1) ELSE "
        "list_resize(list_transform(k, lambda x: 1), 512, 0) END, ',') AS attention_mask FROM f")
    o["k3_pack_blocks"] = (
        f"WITH {vocab}, w AS (SELECT doc_id, unnest(ws) AS token, unnest(range(len(ws))) AS pos FROM (SELECT doc_id, {words} AS ws FROM documents)), "
        "t AS (SELECT doc_id, pos, token_id AS id FROM w JOIN vocab USING (token)), "
        "r AS (SELECT id, row_number() OVER (ORDER BY doc_id, pos) - 1 AS rn, count(*) OVER () AS total FROM t) "
        "SELECT CAST(rn // 512 AS BIGINT) AS block_id, string_agg(CAST(id AS VARCHAR), ',' ORDER BY rn) AS input_ids, "
        "CAST(count(*) AS BIGINT) AS n_labels FROM r WHERE rn // 512 < total // 512 GROUP BY rn // 512")
    o["k4_label_matrix"] = "SELECT doc_id, CAST(quality AS VARCHAR) || ',' || CAST(toxic AS VARCHAR) AS labels FROM labels"
    o["k5_sentence_tokens"] = (f"SELECT doc_id, CAST(len(tl) AS BIGINT) AS n_sentences, array_to_string(list_transform(tl, lambda t: "
                               f"array_to_string(t, ' ')), chr(10)) AS tokens FROM (SELECT doc_id, {sentence_token_lists('text')} AS tl "
                               f"FROM documents)")

    o["k5b_keyword_tokens"] = (f"SELECT doc_id, CAST(1 AS BIGINT) AS n_sentences, CAST(len({space_tokens('kw')}) AS BIGINT) AS n_tokens, "
                               f"array_to_string({space_tokens('kw')}, ' ') AS tokens FROM (SELECT doc_id, {keywords('text')} AS kw FROM documents)")
    o["e1_cohort_build"] = (
        "WITH n AS (SELECT conv_id, role, string_agg(text, chr(10) ORDER BY turn) AS t FROM conversations "
        "WHERE text IS NOT NULL AND role IN ('user', 'assistant') AND conv_id IS NOT NULL GROUP BY conv_id, role), "
        "j AS (SELECT n.conv_id, role, CAST(COALESCE(CAST(quality AS INTEGER), 0) AS BIGINT) AS quality, "
        f"CAST(COALESCE(CAST(toxic AS INTEGER), 0) AS BIGINT) AS toxic, {nondiagnostic(history_sections('t'))} AS text "
        "FROM n JOIN labels l ON n.conv_id = l.doc_id), "
        "k AS (SELECT * FROM j WHERE text <> ''), "
        "u AS (SELECT conv_id, row_number() OVER (ORDER BY md5('42:' || CAST(conv_id AS VARCHAR)), conv_id) - 1 AS rn, "
        "count(*) OVER () AS n FROM (SELECT DISTINCT conv_id FROM k)) "
        "SELECT k.conv_id, role, quality, toxic, text, CASE WHEN rn < floor(0.8::DOUBLE * n) THEN 'train' "
        "WHEN rn < floor((((1.0::DOUBLE - 0.8::DOUBLE) / 2.0::DOUBLE) + 0.8::DOUBLE) * n) THEN 'validation' ELSE 'test' END AS split "
        "FROM k JOIN u ON k.conv_id = u.conv_id")
    o["e1b_first_line"] = (
        "WITH n AS (SELECT conv_id // 2 AS surgery_id, conv_id, role, text FROM conversations WHERE turn = 0 AND text IS NOT NULL), "
        "f AS (SELECT *, row_number() OVER (PARTITION BY surgery_id ORDER BY conv_id, role, text) AS rn FROM n) "
        "SELECT surgery_id, conv_id, role, quality, text FROM (SELECT surgery_id, conv_id, role, "
        f"CAST(COALESCE(quality, 0) AS BIGINT) AS quality, {nondiagnostic('text')} AS text FROM f JOIN labels l ON surgery_id = l.doc_id "
        "WHERE rn = 1) WHERE text <> ''")
    o["e1c_raw_registry"] = (
        "WITH n AS (SELECT conv_id // 2 AS surgery_id, conv_id, role, string_agg(text, chr(10) ORDER BY turn) AS t FROM conversations "
        "WHERE text IS NOT NULL AND conv_id IS NOT NULL AND role IS NOT NULL GROUP BY conv_id, role), "
        "reg AS (SELECT doc_id, CASE WHEN doc_id % 29 = 3 THEN 'odd' || doc_id WHEN doc_id % 3 = 0 THEN 'low' ELSE 'high' END AS grade FROM documents), "
        "j AS (SELECT * FROM (SELECT n.*, grade, row_number() OVER (PARTITION BY surgery_id ORDER BY conv_id, role) AS rn "
        "FROM n JOIN reg ON surgery_id = doc_id) WHERE rn = 1), "
        "sh AS (SELECT grade AS g, count(*)::DOUBLE / SUM(count(*)) OVER () AS share FROM j GROUP BY grade), "
        "m AS (SELECT j.*, CASE WHEN share >= 0.03 THEN grade ELSE 'NULL' END AS masked FROM j JOIN sh ON grade = g), "
        "v AS (SELECT DISTINCT masked AS val FROM m), "
        f"c AS (SELECT surgery_id, conv_id, role, masked, {nondiagnostic('t')} AS text FROM m) "
        "SELECT surgery_id, conv_id, role, md5(text) AS text_md5, 'grade_' || val AS label, CAST(CASE WHEN masked = val THEN 1 ELSE 0 END AS BIGINT) AS value "
        "FROM c, v WHERE text <> ''")
    o["e1d_version_split"] = (
        "WITH n AS (SELECT conv_id, role, string_agg(text, chr(10) ORDER BY turn) AS t FROM conversations "
        "WHERE text IS NOT NULL AND role IN ('user', 'assistant') AND conv_id IS NOT NULL GROUP BY conv_id, role), "
        "j AS (SELECT n.conv_id, role, CAST(COALESCE(quality, 0) AS BIGINT) AS quality, CAST(COALESCE(toxic, 0) AS BIGINT) AS toxic, "
        f"{nondiagnostic('t')} AS text FROM n JOIN labels l ON n.conv_id = l.doc_id), "
        "k AS (SELECT j.*, CASE WHEN source = 'src0' THEN 'test' ELSE 'train' END AS side FROM j JOIN documents d ON j.conv_id = d.doc_id "
        "WHERE j.text <> '' AND d.lang = 'en' AND source IS NOT NULL), "
        "u AS (SELECT conv_id, row_number() OVER (ORDER BY md5('42:' || CAST(conv_id AS VARCHAR)), conv_id) - 1 AS rn, count(*) OVER () AS n "
        "FROM (SELECT DISTINCT conv_id FROM k WHERE side = 'train')) "
        "SELECT k.conv_id, role, quality, toxic, text, CASE WHEN u.rn < round_even(0.15::DOUBLE * u.n, 0) THEN 'validation' ELSE side END AS split "
        "FROM k LEFT JOIN u ON k.conv_id = u.conv_id AND side = 'train'")
    base = f"long AS ({long_cte()})"
    o["m4_pr_curve"] = (f"WITH {base}, cum AS ({cum_cte('long')}), curve AS ({CURVE}) SELECT label, {r6('threshold')} AS threshold, "
                        f"{r6('precision')} AS precision, {r6('recall')} AS recall, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp FROM curve")
    fixed = f"cnt AS ({counts('(SELECT *, CASE WHEN score >= 0.5 THEN 1 ELSE 0 END AS p FROM long)', 'p')})"
    o["m5_prf_fixed"] = (f"WITH {base}, {fixed}, prf AS ({PRF}) SELECT label, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, "
                         f"CAST(fn AS BIGINT) AS fn, CAST(tn AS BIGINT) AS tn, {r6('precision')} AS precision, {r6('recall')} AS recall, "
                         f"{r6(F1)} AS f1 FROM prf")
    o["m6_averaged_prf"] = (f"WITH {base}, {fixed} SELECT average, {r6('precision')} AS precision, {r6('recall')} AS recall, "
                            f"{r6('f1')} AS f1 FROM ({averaged('micro')} UNION ALL {averaged('macro')} UNION ALL {averaged('weighted')})")
    o["m7_optimal_threshold"] = (f"WITH {base}, cum AS ({cum_cte('long')}), curve AS ({CURVE}), thr AS ({THR}) "
                                 f"SELECT thr.label, {r6('thr.threshold')} AS threshold, CAST(SUM(CASE WHEN score > thr.threshold THEN 1 "
                                 f"ELSE 0 END) AS BIGINT) AS n_positive_pred FROM thr JOIN long ON thr.label = long.label GROUP BY thr.label, thr.threshold")
    pooled = f"pooled AS (SELECT * FROM long UNION ALL SELECT row_id, 'micro', y_true, score FROM long)"
    o["m8_roc_auc"] = f"WITH {base}, {pooled}, cum AS ({cum_cte('pooled')}), r AS ({AUC}) SELECT label, {r6('auc')} AS auc FROM r"
    focal = ("-pow(1.0 - least(greatest(CASE WHEN y_true >= 0.5 THEN score ELSE 1.0 - score END, 0.0001), 0.9999), 2.0) * "
             "ln(least(greatest(CASE WHEN y_true >= 0.5 THEN score ELSE 1.0 - score END, 0.0001), 0.9999))")
    o["m9_losses"] = (f"WITH {base}, per AS (SELECT label, avg({bce_expr()}) AS bce, avg({focal}) AS focal FROM long GROUP BY label) "
                      f"SELECT label, {r6('bce')} AS bce, {r6('focal')} AS focal FROM per UNION ALL "
                      f"SELECT 'all', {r6(f'(SELECT avg({bce_expr()}) FROM long)')}, {r6('SUM(focal)')} FROM per")
    o["m10_average_precision"] = f"WITH {base}, {pooled}, cum AS ({cum_cte('pooled')}), r AS ({AP}) SELECT label, {r6('ap')} AS ap FROM r"
    rep_cols = f"label, {r6('auc')} AS auc, {r6('threshold')} AS threshold, {r6('precision')} AS precision, {r6('recall')} AS recall, {r6('f1')} AS f1"
    o["m11_evaluation_report"] = f"WITH {report_ctes()} SELECT {rep_cols} FROM report"
    o["m11b_report_pr_macro"] = f"WITH {report_ctes(average='macro', auc='pr')} SELECT {rep_cols} FROM report"
    probs = ("long AS (SELECT row_id, label, y_true, 1.0 / (1.0 + exp(-((score - 0.5) * 8.0))) AS score FROM "
             f"({long_cte()}))")
    o["m12_logits_report"] = (
        f"WITH {probs}, {fixed}, mic AS ({averaged('micro')}), "
        "pooled AS (SELECT * FROM long UNION ALL SELECT row_id, '__pooled__', y_true, score FROM long), "
        f"cum AS ({cum_cte('pooled')}), rank AS ({AUC}), "
        f"curve AS ({CURVE.replace('FROM cum WHERE', 'FROM cum WHERE label <> ' + q('__pooled__') + ' AND')}), thr AS ({THR}), "
        "pred AS (SELECT long.*, CASE WHEN score > thr.threshold THEN 1 ELSE 0 END AS p2 FROM long LEFT JOIN thr USING (label)), "
        f"cnt2 AS ({counts('pred', 'p2')}), prf AS ({PRF.replace('FROM cnt', 'FROM cnt2')}) "
        f"SELECT 'f1_micro' AS metric, 'all' AS label, {r6('f1')} AS value FROM mic UNION ALL "
        f"SELECT 'precision_micro', 'all', {r6('precision')} FROM mic UNION ALL SELECT 'recall_micro', 'all', {r6('recall')} FROM mic "
        f"UNION ALL SELECT CASE WHEN label = '__pooled__' THEN 'roc_auc_micro' ELSE 'auc' END, CASE WHEN label = '__pooled__' "
        f"THEN 'all' ELSE label END, {r6('auc')} FROM rank UNION ALL SELECT 'f1', label, {r6('COALESCE(' + F1 + ', 0.0)')} FROM prf")
    o["m3b_predicted_names"] = (f"WITH {base} SELECT row_id AS doc_id, COALESCE(string_agg(label, ',' ORDER BY label) FILTER (WHERE score >= 0.5), '') "
                                "AS predicted FROM long GROUP BY row_id")
    o["m14b_linear_attribution"] = (
        f"WITH d AS (SELECT d.doc_id, quality, toxic, {unicode_words('text')} AS ws FROM documents d JOIN labels l ON d.doc_id = l.doc_id), "
        "t AS (SELECT quality, toxic, unnest(ws) AS token FROM d), "
        "n AS (SELECT count(*)::DOUBLE AS n, SUM(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS nq, SUM(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS nt FROM d), "
        "s AS (SELECT token, count(*) AS s, SUM(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS sq, SUM(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS st FROM t GROUP BY token) "
        f"SELECT 'quality' AS label, token, {r6('(length(token) - 4) * (sq - nq * s / n)')} + 0.0 AS attribution FROM s, n "
        f"UNION ALL SELECT 'toxic', token, {r6('(length(token) - 4) * (st - nt * s / n)')} + 0.0 FROM s, n")
    kind = ("CASE WHEN score >= 0.5 AND y_true = 0 THEN 'fp' WHEN score < 0.5 AND y_true = 1 THEN 'fn' "
            "WHEN score >= 0.5 AND y_true = 1 THEN 'tp' ELSE 'tn' END")
    o["m15_error_types"] = f"WITH {base} SELECT row_id, label, {kind} AS outcome, text FROM long JOIN documents ON row_id = doc_id"
    o["m15b_error_types_wide"] = (f"WITH {base}, e AS (SELECT row_id, label, {kind} AS k FROM long) SELECT row_id, "
                                  "max(CASE WHEN label = 'quality' THEN k END) AS quality, max(CASE WHEN label = 'toxic' THEN k END) AS toxic, "
                                  "text FROM e JOIN documents ON row_id = doc_id GROUP BY row_id, text")
    return o
