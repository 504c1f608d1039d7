"""The flagship query: one note per row, cleaned and counted (A2 -> T2 -> A7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.text import clean_report
from ..operators.prep import ordered_concat
from ..operators.stats import word_counts
from .tables import table


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    notes = ordered_concat(table(spark, sf_dir, "conversations"), ["conv_id", "role"], "turn", "text")
    cleaned = notes.select("conv_id", "role", clean_report("concat_text").alias("cleaned"))
    return word_counts(cleaned, "cleaned").select("conv_id", "role", "cleaned", "n_words", "n_distinct_words")
