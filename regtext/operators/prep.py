"""Cohort preparation: projections, filters, casts, joins, dedup, ordered concatenation,
rare-value masking and one-hot expansion (P1-P10, J1-J5, A1-A3, A8, A9)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.text import let


# ---------------------------------------------------------------- P: projections and filters
def select_by_prefix(df: DataFrame, prefixes: list[str], keep: list[str] | None = None,
                     substring: bool = False, exclude: list[str] | None = None) -> DataFrame:
    """``keep`` columns plus every column whose name starts with (or, with ``substring``,
    contains) one of ``prefixes``. Resolved on ``df.columns``: plan-time metadata, no job."""
    def hit(c: str) -> bool:
        return any((p in c) if substring else c.startswith(p) for p in prefixes)
    keep = list(keep or [])
    cols = keep + [c for c in df.columns if hit(c) and c not in keep and c not in (exclude or [])]
    return df.select(*cols)


def prefixed_columns(df: DataFrame, prefixes: list[str], substring: bool = False) -> list[str]:
    return [c for c in df.columns if any((p in c) if substring else c.startswith(p) for p in prefixes)]


def drop_nulls(df: DataFrame, subset: list[str] | None = None) -> DataFrame:
    """Drop rows null in ``subset`` (or in any column)."""
    return df.na.drop(how="any", subset=subset)


def regex_filter(df: DataFrame, col: str, pattern: str, case_sensitive: bool = True) -> DataFrame:
    """Keep rows whose ``col`` contains a match of ``pattern`` (Java regex)."""
    return df.filter(F.col(col).rlike(("" if case_sensitive else "(?i)") + pattern))


def min_words_filter(df: DataFrame, col: str, min_words: int = 1) -> DataFrame:
    """Keep rows with more than ``min_words`` whitespace words."""
    from ..functions.text import word_count
    return df.filter(word_count(col) > min_words)


def empty_to_null(df: DataFrame, col: str, drop: bool = True) -> DataFrame:
    """P5: '' -> NULL, then drop the NULL rows.

    The value passes through a one-element outer generator before the filter: a filter on a
    derived column would otherwise be pushed below the projection (and below any repartition)
    and evaluate a long cleaning chain twice, the first time in the scan task."""
    if not drop:
        return df.withColumn(col, F.nullif(F.col(col), F.lit("")))
    others = [c for c in df.columns if c != col]
    out = df.select(*others, F.explode_outer(F.array(F.nullif(F.col(col), F.lit("")))).alias(col))
    return out.filter(F.col(col).isNotNull()).select(*df.columns)


def labels_to_int(df: DataFrame, labels: list[str], fill: int = 0) -> DataFrame:
    """Strict cast of label columns to INT (a bad value fails the job under ANSI), nulls -> 0."""
    return df.select(*[F.coalesce(F.col(c).cast("int"), F.lit(fill)).alias(c) if c in labels else F.col(c)
                       for c in df.columns])


def lenient_to_bigint(col, fill: int = 0) -> Column:
    """Non-strict cast: a bad value becomes NULL, then ``fill``."""
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(c.try_cast("bigint"), F.lit(fill).cast("bigint"))


def first_line(df: DataFrame, line_col: str, first: int, keys: list[str], order: list[str]) -> DataFrame:
    """The first line of every note only, one row per ``keys`` (first in ``order``)."""
    return keyed_dedup(df.filter(F.col(line_col) == F.lit(first)), keys, order)


def str_to_bool_labels(df: DataFrame, cols: list[str], positive=None, negative=None) -> DataFrame:
    """Spelled-out labels -> 1/0; rows with an unrecognised value in any listed column dropped."""
    pos = positive or K.POSITIVE_SPELLINGS
    neg = negative or K.NEGATIVE_SPELLINGS
    ok = reduce(lambda a, b: a & b, [F.col(c).isin(pos + neg) for c in cols])
    return df.filter(ok).select(*[
        F.when(F.col(c).isin(pos), F.lit(1)).otherwise(F.lit(0)).cast("bigint").alias(c) if c in cols else F.col(c)
        for c in df.columns])


def drop_nan_literal(df: DataFrame, col: str) -> DataFrame:
    """P10: drop NULLs and the literal string ``'nan'``."""
    return df.filter(F.col(col).isNotNull() & (F.col(col) != F.lit("nan")))


def nan_to_null(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Ingest: floating NaN -> NULL (SQL semantics downstream: NULLs are skipped by aggregates)."""
    from pyspark.sql.types import DoubleType, FloatType
    targets = cols or [f.name for f in df.schema.fields if isinstance(f.dataType, (DoubleType, FloatType))]
    return df.select(*[F.when(~F.isnan(F.col(c)), F.col(c)).alias(c) if c in targets else F.col(c)
                       for c in df.columns])


def date_key(col) -> Column:
    """Ingest: a date kept as text (optionally with a midnight time suffix) or a timestamp -> DATE,
    so registry joins compare dates, not strings."""
    c = F.col(col) if isinstance(col, str) else col
    return F.to_date(F.regexp_replace(c.cast("string"), r"[ T]00:00:00(?:\.0+)?$", ""))


# ---------------------------------------------------------------- J: joins
def join_registry(notes: DataFrame, registry: DataFrame, keys: list[str], labels: list[str],
                  label_prefixes: list[str] | None = None) -> DataFrame:
    """Notes inner-join a label registry. Only requested labels the notes do not already carry
    are taken from the registry; the result keeps the labels plus the notes' non-label columns."""
    missing = [c for c in labels if c not in notes.columns]
    right = registry.select(*keys, *missing)
    prefixes = label_prefixes or []
    note_cols = [c for c in notes.columns if c not in keys and not any(c.startswith(p) for p in prefixes)
                 and c not in labels]
    joined = notes.join(right, keys, "inner")
    return joined.select(*keys, *labels, *note_cols)


def join_dropping(left: DataFrame, right: DataFrame, keys: list[str], drop_left: list[str] | None = None,
                  drop_right_prefixes: list[str] | None = None, how: str = "inner") -> DataFrame:
    """Drop prefixed columns on the right and named columns on the left *before* the join,
    and rename any remaining non-key clash on the right with a ``_right`` suffix."""
    rp = drop_right_prefixes or []
    r = right.select(*[c for c in right.columns if c in keys or not any(c.startswith(p) for p in rp)])
    l = left.drop(*(drop_left or []))
    clash = [c for c in r.columns if c in l.columns and c not in keys]
    for c in clash:
        r = r.withColumnRenamed(c, c + "_right")
    return l.join(r, keys, how)


def join_then_dedup(left: DataFrame, right: DataFrame, keys: list[str], dedup_keys: list[str],
                    order: list[str]) -> DataFrame:
    """Join, then one row per ``dedup_keys`` (first in ``order``)."""
    return keyed_dedup(left.join(right, keys, "inner"), dedup_keys, order)


def join_small_dimension(facts: DataFrame, dim: DataFrame, keys: list[str]) -> DataFrame:
    """Facts joined to a small dimension. The strategy is the optimiser's: AQE broadcasts a side whose
    measured size is below ``spark.sql.autoBroadcastJoinThreshold``."""
    return facts.join(dim, keys, "inner")


# ---------------------------------------------------------------- A1-A3: dedup and concatenation
def first_row(order: list[str], others: list[str]) -> Column:
    """Aggregate: the first row by ``order``, then by the other columns (a total order). One struct
    carries order and payload once; partial aggregation keeps one candidate per key per task."""
    return F.min(F.struct(*[F.col(c) for c in order + [c for c in others if c not in order]]))


def keyed_dedup(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """A1: one row per ``keys`` -- the first by ``order`` (ascending, then all columns for a total order)."""
    rest = [c for c in df.columns if c not in keys]
    if not rest:
        return df.select(*keys).dropDuplicates(keys)
    own = [c for c in order if c in rest]
    return df.groupBy(*keys).agg(first_row(own, rest).alias("_r")).select(*keys, *[F.col("_r." + c).alias(c) for c in rest])


def _ordered_join(arr: Column, sep: str, distinct: bool = False) -> Column:
    """Join ``(k, t)`` structs in order; with ``distinct`` one text (the smallest) for every ``k``."""
    s = F.array_sort(arr)
    if distinct:
        s = let(s, lambda a: F.filter(a, lambda x, i: F.coalesce(F.get(a, i - 1)["k"] != x["k"], F.lit(True))))
    return F.array_join(F.transform(s, lambda x: x["t"]), sep)


def ordered_concat(df: DataFrame, keys: list[str], line_col: str, text_col: str, sep: str = "\n",
                   out_col: str = "concat_text", chunk_lines: int | None = 1000) -> DataFrame:
    """A2: ``sep``-join ``text_col`` ordered by ``line_col`` (numeric), one row per ``keys``.

    Null keys and null texts are removed first, and a line number that occurs more than once keeps one
    text (the smallest). With ``chunk_lines`` the lines of a note are concatenated in line ranges first
    (a line number lies in one range), then the ranges are joined: a note with very many lines is split
    across tasks before its final row is built.
    """
    base = df.filter(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys]) & F.col(text_col).isNotNull())
    lines = F.collect_list(F.struct(F.col(line_col).alias("k"), F.col(text_col).alias("t")))
    if chunk_lines:
        part = base.groupBy(*keys, F.floor(F.col(line_col) / F.lit(chunk_lines)).alias("_chunk")) \
            .agg(_ordered_join(lines, sep, distinct=True).alias("_part"))
        return part.groupBy(*keys).agg(
            _ordered_join(F.collect_list(F.struct(F.col("_chunk").alias("k"), F.col("_part").alias("t"))), sep)
            .alias(out_col))
    return base.groupBy(*keys).agg(_ordered_join(lines, sep, distinct=True).alias(out_col))


def sort_group_concat(df: DataFrame, by: list[str], agg: str, sort_by: str, select: list[str],
                      unique_key: str, collapse: bool = True, out_col: str = "concat_text") -> DataFrame:
    """A3: drop rows with any null, concatenate ``agg`` per ``by`` in ``sort_by`` order (or keep the
    row's own text when not collapsing), then one row per ``unique_key`` and project ``select``."""
    base = df.na.drop(how="any")
    if not collapse:
        return keyed_dedup(base, [unique_key], [sort_by]).withColumn(out_col, F.col(agg)).select(*select)
    if by == [unique_key]:  # the group is the row: concatenation and representative in one aggregate
        rest = [c for c in df.columns if c != unique_key]
        text = _ordered_join(F.collect_list(F.struct(F.col(sort_by).alias("k"), F.col(agg).alias("t"))), "\n")
        one = base.groupBy(unique_key).agg(text.alias(out_col), first_row([sort_by], rest).alias("_r"))
        return one.select(unique_key, out_col, *[F.col("_r." + c).alias(c) for c in rest]).select(*select)
    # one representative row per unique key first, then one concatenation per group joined to it:
    # joining the concatenation back to every line would copy a note's whole text once per line
    rep = keyed_dedup(base, [unique_key], [sort_by])
    return rep.join(ordered_concat(base, by, sort_by, agg, out_col=out_col), by, "inner").select(*select)


# ---------------------------------------------------------------- A8/A9: categorical labels
def frequent_values(df: DataFrame, cols: list[str], cut: float = K.RARE_CUT) -> dict[str, list[str]]:
    """Per column the values (as text) whose share of its non-null rows is at least ``cut`` (above 0); at
    most ``1/cut`` of them a column reach the driver. One job for all columns."""
    if cut <= 0:
        raise ValueError("cut must be above 0: every value is frequent otherwise")
    pairs = F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("string").alias("v")) for c in cols])
    counts = df.select(F.inline(pairs)).filter(F.col("v").isNotNull()).groupBy("c", "v").agg(F.count(F.lit(1)).alias("n"))
    total = counts.groupBy("c").agg(F.sum("n").cast("double").alias("t"))
    kept = counts.join(total, "c").filter(F.col("n") / F.col("t") >= F.lit(cut)).collect()
    return {c: sorted(r["v"] for r in kept if r["c"] == c) for c in cols}


def mask_rare(df: DataFrame, cols: list[str], cut: float = K.RARE_CUT, token: str = "NULL",
              keep: dict[str, list[str]] | None = None) -> DataFrame:
    """Values with share < ``cut`` of the column's non-null values become ``token`` (``cut`` 0 masks
    nothing). Only the frequent values (bounded by ``1/cut``) are collected, unless they are given as ``keep``."""
    if cut <= 0 and keep is None:
        return df.select(*[F.col(c).cast("string").alias(c) if c in cols else F.col(c) for c in df.columns])
    keep = keep or frequent_values(df, cols, cut)
    return df.select(*[F.when(F.col(c).isNull(), F.lit(None).cast("string")).when(F.col(c).cast("string").isin(keep[c]), F.col(c).cast("string"))
                       .otherwise(F.lit(token)).alias(c) if c in cols else F.col(c) for c in df.columns])


def one_hot(df: DataFrame, cols: list[str], values: dict[str, list] | None = None, cut: float = K.RARE_CUT,
            drop_source: bool = False):
    """A ``{col}_{value}`` 0/1 column for each value (sorted). The values are those given, or the
    ones that A8 keeps at ``cut``: a label wide enough for a column has that share of the rows, and the
    schema stays bounded by ``1/cut`` columns a label. Returns (DataFrame, new label names)."""
    values = values or frequent_values(df, cols, cut)
    new = [F.coalesce((F.col(c).cast("string") == F.lit(str(v))).cast("int"), F.lit(0)).alias(f"{c}_{v}")
           for c in cols for v in sorted(values[c], key=str)]
    names = [f"{c}_{v}" for c in cols for v in sorted(values[c], key=str)]
    kept = [c for c in df.columns if not (drop_source and c in cols)]
    return df.select(*kept, *new), names
