"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# the contract's word: a run of characters other than ASCII whitespace
SPACE_CHARS = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"

# stands for a NULL id inside joins; ids are surrogate keys and never reach the smallest long
NULL_ID = -(1 << 63)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def fresh(taken: list[str], base: str) -> str:
    """A column name that clashes with none of ``taken`` (Spark compares names without case)."""
    low = {t.lower() for t in taken}
    while base.lower() in low:
        base += "_"
    return base


def bind(value: Column, fn) -> Column:
    """``fn(value)`` with ``value`` evaluated once, however often ``fn`` uses it."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def or_empty(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def words(text: Column) -> Column:
    """The contract's words of a text, in order; NULL and blank texts have none."""
    trimmed = F.btrim(or_empty(text), F.lit(SPACE_CHARS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_RUN))


def internal_id(col: Column) -> Column:
    return F.coalesce(col.cast("long"), F.lit(NULL_ID))


def prefix_sums(lengths: Column, chunk: int = 512) -> Column:
    """Running totals *before* each element of an array of longs: ``[3, 4, 1] -> [0, 3, 7]``.

    Chunks are summed on their own and then moved by the totals of the chunks before them, so an
    array of n elements costs about ``n * chunk / 2 + (n / chunk)^2 / 2`` copies, not ``n^2 / 2``.
    """
    empty = F.array().cast("array<long>")

    def running(a):  # [0, a1, a1+a2, ...], one element longer than a
        return F.aggregate(a, F.array(F.lit(0).cast("long")),
                           lambda acc, x: F.array_append(acc, F.element_at(acc, -1) + x))

    def moved(pieces):
        totals = F.transform(pieces, lambda p: F.element_at(p, -1))
        return bind(running(totals), lambda bases: F.flatten(F.transform(
            pieces, lambda p, k: F.transform(F.slice(p, F.lit(1), F.size(p) - 1), lambda v: v + F.get(bases, k)))))

    def pieces(a):
        last = ((F.size(a) - 1) / chunk).cast("int")
        return F.transform(F.sequence(F.lit(0), last),
                           lambda k: running(F.slice(a, k * chunk + 1, F.lit(chunk))))

    return bind(lengths, lambda a: F.when(F.size(a) > 0, bind(pieces(a), moved)).otherwise(empty))
