"""Text cleaning steps as Catalyst column expressions.

Every function takes and returns a ``Column``; nothing here runs Python per row, so a chain of
steps stays inside one whole-stage-codegen projection. Word-level steps split on a separator,
filter the array with a higher-order function and join it back.

Regex dialect: Java. Word boundaries that must follow Unicode rules (as the original's Python
``re`` does) are written as explicit look-arounds on ``[\\p{L}\\p{N}_]`` instead of ``\\b``.
Negated ASCII classes are spelled ``\\p{Alnum}`` and ``\\p{Alpha}`` (the same characters): a negated union of ranges takes
ten times as long. A look-ahead for the first character keeps the costlier look-behinds and alternations to few places.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as K

# characters Python's str.split()/strip() treat as whitespace
PY_SPACE = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
# line boundaries of Python's str.splitlines()
PY_LINE_BREAK = r"\r\n|[\n\r\x{0b}\x{0c}\x{1c}\x{1d}\x{1e}\x{85}\x{2028}\x{2029}]"
WORD_CHAR = r"[\p{L}\p{N}_]"
NOT_AFTER_WORD = rf"(?<!{WORD_CHAR})"
NOT_BEFORE_WORD = rf"(?!{WORD_CHAR})"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and pass it to ``body`` (a lambda over a one-element array), so a
    long cleaning chain referenced several times is not copied into the expression tree."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _arr(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


# the same characters spelled out, for translate(): every one becomes a plain space
PY_SPACE_CHARS = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(chr(c) for c in range(0x2000, 0x200b))
                  + "\u2028\u2029\u202f\u205f\u3000")


# the same without the plain space: one range passes over printable ASCII, which the union of ranges is slow to reject
OTHER_SPACE = rf"[^ -~](?<={PY_SPACE})"
NOT_PY_SPACE = "[^" + PY_SPACE[1:]


def plain_spaces(col) -> Column:
    """Every whitespace character as a plain space."""
    return F.regexp_replace(_c(col), OTHER_SPACE, " ")


def begins_like(words: list[str], any_case: bool = False) -> str:
    """A look-ahead that every one of ``words`` passes: one character class for each of their first three places."""
    places = zip(*(w[:3] for w in words))  # as many as the shortest word has
    return "(?=" + "".join(f"[{''.join(sorted({v for c in p for v in ((c.lower(), c.upper()) if any_case else c)}))}]" for p in places) + ")"


def py_split(col) -> Column:
    """Python ``str.split()``: whitespace runs, no empty tokens. Whitespace is mapped to spaces
    with ``translate`` (no regex) and the text split on the single space."""
    ws = F.translate(_c(col), PY_SPACE_CHARS, " " * len(PY_SPACE_CHARS))
    return F.filter(F.split(ws, " "), lambda x: x != "")


def py_strip(col) -> Column:
    """Python ``str.strip()``: leading and trailing whitespace of any kind."""
    return F.regexp_replace(_c(col), rf"^{PY_SPACE}+|{PY_SPACE}+$", "")


def space_tokens(col) -> Column:
    """Split on single spaces and drop empty tokens (text already reduced to ' ' as whitespace)."""
    return F.filter(F.split(_c(col), " "), lambda x: x != "")


def squeeze(col) -> Column:
    """``' '.join(text.split())`` for text whose only whitespace is the space."""
    return F.array_join(space_tokens(col), " ")


def drop_words(col, *word_lists: list[str], min_len: int = 1) -> Column:
    """Drop space-separated words found in any list (and words shorter than ``min_len``)."""
    banned = []
    for wl in word_lists:
        for w in wl:
            if w not in banned:
                banned.append(w)
    def keep(x):
        # IN over many literals is planned as a hash-set lookup (InSet), not a linear scan
        cond = ~x.isin(["", *banned])
        return (F.length(x) >= F.lit(min_len)) & cond if min_len > 1 else cond

    return F.array_join(F.filter(F.split(_c(col), " "), keep), " ")


def replace_all_literal(col, fragments: list[str], by: str = "") -> Column:
    out = _c(col)
    for frag in fragments:
        out = F.replace(out, F.lit(frag), F.lit(by))
    return out


def longest_first(items: list[str]) -> list[str]:
    return sorted(items, key=lambda s: (-len(s), s))


# ---------------------------------------------------------------- T1 keywords
def keywords(col, lemma: dict[str, str] | None = None) -> Column:
    """Lower-case keyword string (units, digits, 1-char tokens, symbols, stopwords removed).

    ``lemma`` optionally maps a word to its lemma (the original used a WordNet verb lemmatiser,
    which is not available here); it is applied as a literal map, so keep it bounded.
    """
    # one translate(): whitespace to spaces, punctuation to nothing
    s = F.translate(F.replace(F.lower(_c(col)), F.lit("-"), F.lit(" ")), PY_SPACE_CHARS + K.PUNCTUATION, " " * len(PY_SPACE_CHARS))
    s = F.array_join(F.filter(F.split(s, " "), lambda x: ~x.isin(["", *K.UNITS_T1])), " ")
    s = F.regexp_replace(s, r"\p{Nd}+", "")
    s = F.array_join(F.filter(F.split(s, " "), lambda x: F.length(x) > 1), " ")
    # runs of other characters become a space; spaces themselves need no match (tokens are
    # re-split on spaces below, so the token list is the same as with [^A-Za-z0-9]+)
    s = F.regexp_replace(s, r"[^\p{Alnum} ]+", " ")
    # the word tokenizer's contraction splits in one regex pass (``wanna`` only before another
    # word); a group that did not take part in the match is replaced by nothing
    alts, firsts, seconds = [], [], []
    for i, (a, b) in enumerate(K.TOKENIZER_SPLITS):
        tail = "(?= )" if (a, b) == ("wan", "na") else r"\b"
        alts.append(rf"\b({a})({b}){tail}")
        firsts.append(f"${2 * i + 1}")
        seconds.append(f"${2 * i + 2}")
    begin = begins_like([a for a, _ in K.TOKENIZER_SPLITS])
    s = F.regexp_replace(s, rf"{begin}(?:{'|'.join(alts)})", "".join(firsts) + " " + "".join(seconds))
    stop = K.stopwords(keep=K.KEEP_T1)
    toks = F.filter(F.split(s, " "), lambda x: (F.length(x) > 1) & ~x.isin(stop))
    if lemma:
        m = F.create_map(*[F.lit(v) for kv in sorted(lemma.items()) for v in kv])
        toks = F.transform(toks, lambda x: F.coalesce(F.element_at(m, x), x))
    return F.array_join(toks, " ")


# ---------------------------------------------------------------- T2 report cleaner
def clean_report(col) -> Column:
    """Lower-case report reduced to ``[0-9a-z #+_]`` words without units, quantities, stopwords."""
    s = replace_all_literal(F.lower(_c(col)), K.REPORT_FRAGMENTS_T2)
    s = F.translate(s, "\n\t", "  ")
    s = F.regexp_replace(s, r"(?s)[\(\[].*?[\)\]]", "")
    s = F.regexp_replace(s, r"[/(){}\[\]\|@,;]", " ")
    s = F.regexp_replace(s, r"[^0-9a-z #+_]", "")
    s = drop_words(s, K.UNITS_T2, K.QUANTS, K.stopwords(keep=K.KEEP_T2))
    s = replace_all_literal(s, longest_first(K.QUANT_PHRASES), " ")
    s = F.regexp_replace(s, "[0-9]", "")
    return squeeze(s)


# ---------------------------------------------------------------- T4 / T5 / T6
def measurement_pattern() -> str:
    units = "|".join(longest_first(K.MEASUREMENT_UNITS))
    return rf"{NOT_AFTER_WORD}\p{{Nd}}+(?:\.\p{{Nd}}+)?\s*(?:{units}){NOT_BEFORE_WORD}"


def remove_measurements(col) -> Column:
    """T4: drop a number followed by a unit (whole units only: ``3 stents`` stays)."""
    return F.regexp_replace(_c(col), r"(?=\p{Nd})" + measurement_pattern(), "")


def remove_time_info(col) -> Column:
    """T5: drop month names (whole words, any case), dates, clock times and am/pm words."""
    months = "|".join(K.MONTHS)
    s = F.regexp_replace(_c(col), rf"{begins_like(K.MONTHS, any_case=True)}{NOT_AFTER_WORD}(?i:{months}){NOT_BEFORE_WORD}", "")
    s = F.regexp_replace(s, r"(?=\p{Nd})(?:\p{Nd}{1,2}[/:]\p{Nd}{1,2}[/:]\p{Nd}{4}|\p{Nd}{4}-\p{Nd}{2}-\p{Nd}{2})", "")
    s = F.regexp_replace(s, r"\p{Nd}{1,2}:\p{Nd}{2}(?:am|pm|AM|PM)?", "")
    return F.regexp_replace(s, rf"(?=[aApP][mM]){NOT_AFTER_WORD}(?:am|pm|AM|PM){NOT_BEFORE_WORD}", "")


def remove_dr_names(col) -> Column:
    """Drop ``Dr. Name`` (case-insensitive)."""
    return F.regexp_replace(_c(col), r"(?i)dr\.\s+[A-Z][a-z]+", "")


# ---------------------------------------------------------------- T3 non-diagnostic filter
def nondiagnostic(col, keep: list[str] | None = None, remove_names: bool = False) -> Column:
    """Keep diagnostic words only (measurements, times, brackets, symbols, stopwords,
    contact blocks and everything before the first ``history`` removed).

    ``keep`` words are taken out of the stopword list (the original drops negations).
    """
    s = remove_time_info(remove_measurements(col))
    s = replace_all_literal(s, ["\n", "\t"], " ")
    s = F.regexp_replace(s, r"(?s)[\(\[].*?[\)\]]", "")
    s = F.regexp_replace(s, r"[^.,\p{Alpha} ]+", "")
    s = F.regexp_replace(s, r"\.(?=[.,a-zA-Z])(?<=[a-zA-Z]\.)", "")
    if remove_names:
        s = remove_dr_names(s)
    s = F.replace(F.lower(s), F.lit(","), F.lit(" "))
    s = drop_words(s, K.UNITS_T3, K.QUANTS, K.stopwords(keep=keep, extra=K.EXTRA_STOP_T3))
    phrases = rf"{begins_like(K.QUANT_PHRASES)}(?:{'|'.join(K.QUANT_PHRASES)})"
    s = let(s, lambda v: F.when(v.rlike(phrases), replace_all_literal(v, longest_first(K.QUANT_PHRASES), " ")).otherwise(v))
    s = let(s, lambda v: F.when(F.instr(v, "history") > 0,
                                F.trim(F.substring(v, F.instr(v, "history") + F.lit(7), F.lit(1 << 30))))
            .otherwise(v))
    s = let(s, lambda v: F.when(v.rlike("physician") | v.rlike("contact information"), F.regexp_replace(
        v, r"(?:physician|contact information).*?(?:fax|oh|ohio)", "")).otherwise(v))
    s = F.regexp_replace(s, r"heart vascular institute.*?ohio", "")
    s = F.regexp_replace(s, r"\b[a-z]\b", "")
    return squeeze(s)


# ---------------------------------------------------------------- T7 / T9
def no_punctuation(col) -> Column:
    """A text without ASCII punctuation (``constants.PUNCTUATION``)."""
    return F.regexp_replace(_c(col), r"\p{Punct}+", "")


def strip_punctuation(arr_col) -> Column:
    """Remove ASCII punctuation from every string of an array column."""
    return F.transform(_c(arr_col), no_punctuation)


def cut_words(col, max_len: int) -> Column:
    """First ``max_len`` whitespace words (text unchanged when it is not longer)."""
    return let(_c(col), lambda v: F.when(F.size(py_split(v)) <= max_len, v)
               .otherwise(F.array_join(F.slice(py_split(v), 1, max_len), " ")))


def word_count(col) -> Column:
    return F.size(py_split(col))


# ---------------------------------------------------------------- T12 / T13 / T14
def history_sections(col) -> Column:
    """Text after the first history header with header words removed; unchanged if none."""
    pat = "(?=[PHIACphiac][AaCcIiMmOoPpRrSsXx])(?i)" + K.HISTORY_HEADER_PATTERN  # the first two letters of all headers

    def pick(parts):
        after = F.filter(F.slice(parts, 2, 1 << 30), lambda x: x != "")
        return F.when(F.size(parts) > 1, F.array_join(after, " ")).otherwise(F.element_at(parts, 1))

    # no header: split returns the whole text as its only part
    return let(F.split(_c(col), pat), pick)


def procedure_section(col) -> Column:
    """Every span from a procedure start word up to the next ``word:``, star run or ``#:``.

    Secondary start words are used only when a text has no primary start word.
    Spans are trimmed and joined by one space; no start word gives ``''``.
    """
    end = r"(?=(?i:\b\w+:)|\*+|#:|\z)"
    prim = rf"(?s)(?:{K.PROCEDURE_PRIMARY_STARTS})(.*?){end}"
    sec = rf"(?s)(?:{K.PROCEDURE_SECONDARY_STARTS})(.*?){end}"
    def spans(v):
        sp = F.when(v.rlike(K.PROCEDURE_PRIMARY_STARTS), F.regexp_extract_all(v, F.lit(prim), 1)) \
            .otherwise(F.regexp_extract_all(v, F.lit(sec), 1))
        return F.array_join(F.filter(F.transform(sp, lambda x: py_strip(x)), lambda x: x != ""), " ")

    return let(_c(col), spans)


def procedure_after(col) -> Column:
    """In a ``*``-separated multi-report, the text after ``procedure:`` / ``operative report``
    of every sub-report that has one, joined by newlines."""
    reports = F.split(_c(col), r"\*+")
    pieces = F.transform(reports, lambda r: F.split(r, K.PROCEDURE_AFTER_MARKER, 2))
    found = F.filter(pieces, lambda p: F.size(p) > 1)
    return F.array_join(F.transform(found, lambda p: F.element_at(p, 2)), "\n")


# ---------------------------------------------------------------- T16 / T17 / T18
def parse_dict_string(col) -> Column:
    """``{'k': 1}``-style text to ``MAP<STRING,STRING>``."""
    js = F.replace(F.replace(_c(col), F.lit("'"), F.lit('"')), F.lit('u"'), F.lit('"'))
    return F.from_json(js, "map<string,string>")


def parse_list_string(col, remove_empty: bool = True, bracketed: bool = True) -> Column:
    """``['a', 'b']`` (or space-separated) text to ``ARRAY<STRING>``."""
    if bracketed:
        inner = F.regexp_replace(_c(col), r"^[\]\[]+|[\]\[]+$", "")
        items = F.transform(F.split(inner, ", "), lambda x: F.replace(x, F.lit("'"), F.lit("")))
    else:
        items = F.split(_c(col), " ")
    return F.filter(items, lambda x: x != "") if remove_empty else items


def first_integer(col) -> Column:
    """First run of digits, kept as a string (NULL when there is none)."""
    return F.nullif(F.regexp_extract(_c(col), r"(\p{Nd}+)", 1), F.lit(""))


# ---------------------------------------------------------------- lines / sentences
def lines(col) -> Column:
    """T8 helper: lower-cased, stripped, split into non-empty lines."""
    s = F.regexp_replace(F.lower(_c(col)), rf"^{PY_SPACE}+|{PY_SPACE}+$", "")
    return F.filter(F.split(s, PY_LINE_BREAK), lambda x: x != "")


SENTENCE_BREAK = r"(?<=[.!?])\s+|\n+"


def is_blank(x: Column) -> Column:
    """True when a string holds only (Python) whitespace."""
    return ~x.rlike(NOT_PY_SPACE)


def sentences(col) -> Column:
    """T10 helper: split on sentence terminators followed by whitespace, or on newlines; pieces
    holding only whitespace are dropped."""
    return F.filter(F.split(_c(col), SENTENCE_BREAK), lambda x: ~is_blank(x))


def unicode_words(col, first: int | None = None) -> Column:
    """Lower-cased letter/digit runs (the corpus tokeniser for frequencies and vocabularies); with ``first`` only so many
    words, and the text is split no further."""
    # a piece may be empty at the start, the last one is the rest
    w = F.filter(F.split(F.lower(_c(col)), r"[^\p{L}\p{N}]+", first + 2 if first else -1), lambda x: x != "")
    return F.slice(w, 1, first) if first else w
