"""Row-level text tables: lines, sentences, sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.text import NOT_PY_SPACE, PY_SPACE, keywords, let, lines, plain_spaces, py_strip, sentences, space_tokens

SECTION_HEADER = r"(?:^|[^\p{L}\p{N}_])([A-Z][A-Z ]*):"


def line_table(df: DataFrame, key: str, text_col: str) -> DataFrame:
    """(key, line_no, line) -- lower-cased, stripped, non-empty lines; line_no from 0."""
    return df.select(key, F.posexplode_outer(lines(text_col)).alias("line_no", "line")) \
             .filter(F.col("line_no").isNotNull()).withColumn("line_no", F.col("line_no").cast("bigint"))


def merged_sentences(col, min_len: int = 3) -> Column:
    """T10 helper: the sentences of a text; one with fewer than ``min_len`` words is appended to its
    predecessor (a run of short sentences joins the same predecessor), the first is never merged."""
    # as many words from the start on, read no further; nothing to go back to, so a long word costs its length once
    words = rf"\A{PY_SPACE}*+(?:{NOT_PY_SPACE}++{PY_SPACE}++){{{max(min_len - 1, 0)}}}{NOT_PY_SPACE}"

    def long_enough(x):
        return x.rlike(words) if min_len > 0 else F.lit(True)

    def merge(s):
        first = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | long_enough(F.get(s, i)))
        parts = let(first, lambda f: F.transform(f, lambda b, j: F.array_join(
            F.slice(s, b + 1, F.coalesce(F.get(f, j + 1), F.size(s)) - b), " ")))
        return F.when(F.size(s) > 0, parts).otherwise(F.array().cast("array<string>"))

    return let(sentences(col), merge)


def sentence_table(df: DataFrame, key: str, text_col: str, min_len: int = 3) -> DataFrame:
    """(key, sent_no, sentence), merged inside the row: no exchange."""
    return df.select(key, F.posexplode_outer(merged_sentences(text_col, min_len)).alias("sent_no", "sentence")) \
             .filter(F.col("sent_no").isNotNull()).withColumn("sent_no", F.col("sent_no").cast("bigint"))


def section_table(df: DataFrame, key: str, text_col: str, header_pattern: str = SECTION_HEADER) -> DataFrame:
    """(key, sec_no, header, body). Headers are capital-letter runs before ``:``; a body is the
    text up to the next header (trimmed). Duplicate headers stay separate rows."""
    headers = F.regexp_extract_all(F.col(text_col), F.lit(header_pattern), 1)
    bodies = F.slice(F.split(F.col(text_col), header_pattern), 2, 1 << 30)
    z = F.arrays_zip(headers.alias("h"), bodies.alias("b"))
    return (df.select(key, F.posexplode_outer(z).alias("sec_no", "_z")).filter(F.col("sec_no").isNotNull())
            .select(key, F.col("sec_no").cast("bigint").alias("sec_no"), py_strip(F.col("_z.h")).alias("header"),
                    py_strip(F.col("_z.b")).alias("body")))


def remove_sections(df: DataFrame, key: str, text_col: str, names: list[str] | None = None,
                    out_col: str = "report") -> DataFrame:
    """Drop the named sections (header and body) and rebuild the report from the rest as
    ``HEADER: body`` pieces in their original order; text before the first header is kept."""
    drop = names if names is not None else K.SECTIONS_TO_REMOVE

    def rebuild(t):
        def from_parts(parts):
            pre = py_strip(F.element_at(parts, 1))
            headers = F.regexp_extract_all(t, F.lit(SECTION_HEADER), 1)
            z = F.arrays_zip(headers.alias("h"), F.slice(parts, 2, 1 << 30).alias("b"))
            kept = F.filter(z, lambda e: ~py_strip(e["h"]).isin(drop))
            pieces = F.transform(kept, lambda e: F.concat(py_strip(e["h"]), F.lit(": "), py_strip(e["b"])))
            return F.array_join(F.filter(F.concat(F.array(pre), pieces), lambda x: x != ""), " ")
        return let(F.split(t, SECTION_HEADER), from_parts)

    return df.withColumn(out_col, let(F.col(text_col), rebuild))


def flatten_to_rows(df: DataFrame, key: str, nested_col: str) -> DataFrame:
    """Nested array -> one row per element with the key and its position."""
    return df.select(key, F.posexplode_outer(F.flatten(F.col(nested_col))).alias("pos", "item")) \
             .filter(F.col("pos").isNotNull()).withColumn("pos", F.col("pos").cast("bigint"))


def sentence_tokens(df: DataFrame, key: str, text_col: str, preprocess: bool = False) -> DataFrame:
    """K5: per document the sentences as word lists -> ``ARRAY<ARRAY<STRING>>`` column ``tokens``.

    With ``preprocess`` the text is first keyword-normalised (T1), as the original tokenizer does;
    that text keeps no sentence punctuation, so it is one sentence of keyword tokens."""
    if preprocess:
        return df.select(key, F.array(space_tokens(keywords(text_col))).alias("tokens"))
    return df.select(key, word_lists(sentences(text_col)).alias("tokens"))


def word_lists(sentence_col: Column) -> Column:
    """The lower-cased whitespace words of every sentence of an array."""
    return F.transform(sentence_col, lambda s: space_tokens(plain_spaces(F.lower(s))))
