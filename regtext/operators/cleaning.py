"""Configurable cleaning chains over a text column, and a report of what each step does."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..session import materialize
from .prep import empty_to_null

STEPS = {
    "keywords": X.keywords,
    "clean_report": X.clean_report,
    "nondiagnostic": X.nondiagnostic,
    "history": X.history_sections,
    "procedure": X.procedure_section,
    "procedure_after": X.procedure_after,
    "measurements": X.remove_measurements,
    "time_info": X.remove_time_info,
    "dr_names": X.remove_dr_names,
}


def chain(col, steps: list[str]) -> Column:
    """The steps applied one after the other, as one expression."""
    c = F.col(col) if isinstance(col, str) else col
    for s in steps:
        c = STEPS[s](c)
    return c


def clean(df: DataFrame, steps: list[str], text_col: str = "text", out_col: str | None = None, drop_empty: bool = True) -> DataFrame:
    """Clean ``text_col`` into ``out_col`` (in place by default); texts that end up empty are dropped."""
    out = df.withColumn(out_col or text_col, chain(text_col, steps))
    return empty_to_null(out, out_col or text_col) if drop_empty else out


def cleaning_report(df: DataFrame, steps: list[str], by: list[str] | None = None, text_col: str = "text") -> DataFrame:
    """What every step of a chain did, per ``by`` group: (by.., step_no, step, n_rows, n_changed, n_emptied,
    chars_before, chars_after). NULL texts are left out. The chain runs once per row; a row hands one
    small struct per step to a single aggregate."""
    by = list(by or [])
    names = [f"_t{i}" for i in range(len(steps) + 1)]
    rows = df.filter(F.col(text_col).isNotNull()).select(*by, F.col(text_col).alias(names[0]))
    for i, s in enumerate(steps):
        rows = rows.withColumn(names[i + 1], STEPS[s](F.col(names[i])))
    deltas = F.array(*[F.struct(
        F.lit(i).cast("bigint").alias("step_no"), F.lit(s).alias("step"),
        (F.col(names[i]) != F.col(names[i + 1])).cast("bigint").alias("c"),
        ((F.col(names[i]) != "") & (F.col(names[i + 1]) == "")).cast("bigint").alias("e"),
        F.length(names[i]).cast("bigint").alias("b"), F.length(names[i + 1]).cast("bigint").alias("a")) for i, s in enumerate(steps)])
    long = rows.select(*by, F.inline(deltas))
    return long.groupBy(*by, "step_no", "step").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("c").alias("n_changed"), F.sum("e").alias("n_emptied"),
        F.sum("b").alias("chars_before"), F.sum("a").alias("chars_after"))


# ---------------------------------------------------------------- T1 with a lemma table
def attested_lemmas(words: DataFrame, endings: dict[str, tuple[str, ...]]) -> DataFrame:
    """A lemma table ``(word, word_class, lemma)`` off a corpus' own vocabulary ``words(word)``: a word that ends in one of
    the ``endings`` of a class has what stands before it as lemma, if the corpus has that as a word too. Of several
    endings that fit, the longest counts."""
    rules = F.array(*[F.struct(F.lit(c).alias("word_class"), F.lit(e).alias("ending")) for c, es in endings.items() for e in es])
    cut = words.select("word", F.inline(rules)).filter(F.col("word").endswith(F.col("ending"))) \
        .withColumn("lemma", F.expr("left(word, length(word) - length(ending))"))
    known = cut.join(words.select(F.col("word").alias("lemma")), "lemma")
    return known.groupBy("word", "word_class").agg(F.max_by("lemma", F.length("ending")).alias("lemma"))


def distinct_words(df: DataFrame, col: str) -> DataFrame:
    """``(word)``: every space-separated token of ``col`` once, written as a table (a row gives each of its words once)."""
    return materialize(df.select(F.explode(F.array_distinct(F.split(col, " "))).alias("word")).filter("word != ''").distinct(), "words")


def lemmatise(df: DataFrame, key: str, col: str, lemmas: DataFrame, word_class: str | None = None, words: DataFrame | None = None) -> DataFrame:
    """Replace every space-separated token of ``col`` by its lemma in ``lemmas(word, word_class, lemma)`` (of one class, or
    of any; a word with several lemmas takes the smallest; a missing lemma leaves the word). NULL texts stay NULL.

    The lemma table is first cut down to the words that the corpus has (``distinct_words``, or ``words`` where the caller
    has them) and that change, and written: the optimiser knows its size before it deals any token. The distinct tokens of
    a row meet it in a join, only those that change come back, as a map that the row looks its tokens up in."""
    rules = lemmas.filter(F.col("word_class") == word_class) if word_class is not None else lemmas
    rules = rules.filter(F.col("lemma").isNotNull() & (F.col("lemma") != F.col("word"))).groupBy("word").agg(F.min("lemma").alias("lemma"))
    used = materialize(rules.join(distinct_words(df, col) if words is None else words, "word", "left_semi"), "lemmas")
    text = F.xxhash64(col)
    tokens = df.select(F.col(key).alias("_k"), text.alias("_h"), F.explode(F.array_distinct(F.split(col, " "))).alias("word"))
    found = tokens.join(used, "word").groupBy("_k", "_h").agg(F.map_from_entries(F.collect_set(F.struct("word", "lemma"))).alias("_m"))
    out = df.join(found, F.col(key).eqNullSafe(F.col("_k")) & (text == F.col("_h")), "left")
    new = F.array_join(F.transform(F.split(col, " "), lambda x: F.coalesce(F.try_element_at("_m", x), x)), " ")
    return out.select(*[F.when(F.col("_m").isNull(), F.col(col)).otherwise(new).alias(c) if c == col else F.col(c) for c in df.columns])


def keywords_with_lemmas(df: DataFrame, key: str, text_col: str, lemmas: DataFrame, word_class: str | None = "verb", out_col: str = "keywords") -> DataFrame:
    """T1 whole: the keyword string of ``text_col`` with its words reduced to their lemmas."""
    return lemmatise(df.withColumn(out_col, X.keywords(text_col)), key, out_col, lemmas, word_class)
