"""Corpus and label statistics."""

from __future__ import annotations


from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions.tdist import t_critical
from ..functions.text import keywords, py_split


# ---------------------------------------------------------------- A4-A7: corpus statistics
def grouped_text_concat(df: DataFrame, by: list[str], order_col: str, text_col: str, clean: bool = True,
                        chunk_rows: int = 1000, out_col: str = "corpus_text") -> DataFrame:
    """A4: space-joined (keyword-normalised) text per ``by`` key, in ``order_col`` order.

    One all-rows string does not scale, so the output is chunked: one row per ``by`` key and block
    of ``chunk_rows`` consecutive ``order_col`` values (``chunk`` column), each built by one task.
    """
    txt = keywords(text_col) if clean else F.col(text_col)
    base = df.select(*by, order_col, txt.alias("_t"),
                     F.floor(F.col(order_col) / F.lit(chunk_rows)).cast("bigint").alias("chunk"))
    return base.groupBy(*by, "chunk").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order_col).alias("k"), F.col("_t").alias("t")))),
                                 lambda x: x["t"]), " ").alias(out_col))


def token_frequency(tokens: DataFrame, token_col: str = "token") -> DataFrame:
    """A5: (token, n) over an exploded token column; partial aggregation before the shuffle."""
    return tokens.groupBy(token_col).agg(F.count(F.lit(1)).cast("bigint").alias("n"))


def explode_tokens(df: DataFrame, tokens_col, key_cols: list[str] | None = None) -> DataFrame:
    """One row per token (outer explode + null filter: no inferred size() filter copies the
    token expression below a repartition)."""
    return df.select(*(key_cols or []), F.explode_outer(tokens_col).alias("token")).filter(F.col("token").isNotNull())


def top_terms(freq: DataFrame, k: int = 100, stop: list[str] | None = None, token_col: str = "token") -> DataFrame:
    """The ``k`` most frequent tokens not in ``stop`` (ties by token); a distributed top-k."""
    f = freq
    if stop:
        f = f.filter(~F.col(token_col).isin(stop))
    return f.orderBy(F.desc("n"), F.asc(token_col)).limit(k)


def word_counts(df: DataFrame, text_col: str, preprocess: bool = False) -> DataFrame:
    """Per row ``n_words`` and ``n_distinct_words`` (optionally on keyword-normalised text)."""
    w = py_split(keywords(text_col) if preprocess else F.col(text_col))
    # the word array is its own projection: read twice, it is still computed once
    return df.withColumn("_w", w) \
             .withColumn("n_words", F.size("_w").cast("bigint")) \
             .withColumn("n_distinct_words", F.size(F.array_distinct("_w")).cast("bigint")).drop("_w")


# ---------------------------------------------------------------- A10-A12: label statistics
def _unpivot(df: DataFrame, ids: list[str], cols: list[str], var: str, val: str) -> DataFrame:
    return df.unpivot(ids, cols, var, val)


def label_prevalence(df: DataFrame, labels: list[str], min_pos_rate: float,
                     ignore: list[str] | None = None) -> DataFrame:
    """A10: one aggregate over all labels -> (label, pos_rate, n_passing, kept).

    ``n_passing`` counts labels with ``pos_rate > min_pos_rate`` before the ignore list is applied;
    ``kept`` is 1 for passing labels not in the ignore list (default: the fixed list).
    """
    ign = K.IGNORED_LABELS if ignore is None else ignore
    n = F.count(F.lit(1))
    one = df.agg(*[(F.sum(F.when(F.col(c) == 1, 1).otherwise(0)) / n).cast("double").alias(c) for c in labels])
    long = _unpivot(one.withColumn("_k", F.lit(0)), ["_k"], labels, "label", "pos_rate").drop("_k")
    passing = (F.col("pos_rate") > F.lit(min_pos_rate))
    w = Window.partitionBy()  # over the one-row-per-label table
    return long.select("label", "pos_rate",
                       F.sum(passing.cast("bigint")).over(w).alias("n_passing"),
                       (passing & ~F.col("label").isin(ign)).cast("bigint").alias("kept"))


def class_weights(df: DataFrame, label_col: str) -> DataFrame:
    """Inverse-frequency class weights normalised to sum 1 -> (class, n, weight)."""
    counts = df.filter(F.col(label_col).isNotNull()).groupBy(label_col).agg(F.count(F.lit(1)).cast("bigint").alias("n"))
    inv = 1.0 / F.col("n").cast("double")
    return counts.select(F.col(label_col).alias("class"), "n",
                         (inv / F.sum(inv).over(Window.partitionBy())).alias("weight"))


def loss_weights(df: DataFrame, labels: list[str], how: str = "non_null_reinforcement",
                 bounds=K.LOSS_WEIGHT_BOUNDS) -> DataFrame:
    """Per-label loss weight in ``bounds``: null share (``non_null_reinforcement``) or
    1 - positive share (``positive_example_reinforcement``); a zero count falls back to
    ``floor(sqrt(n))`` as in the original. One aggregate over all labels."""
    lo, hi = bounds
    n = F.count(F.lit(1))
    if how == "non_null_reinforcement":
        aggs = [F.sum(F.col(c).isNull().cast("bigint")).alias(c) for c in labels]
    elif how == "positive_example_reinforcement":
        aggs = [F.sum((F.col(c) == 1).cast("bigint")).alias(c) for c in labels]
    else:
        raise ValueError(how)
    one = df.agg(n.alias("_n"), *aggs)
    long = _unpivot(one, ["_n"], labels, "label", "cnt")
    cnt = F.when(F.coalesce(F.col("cnt"), F.lit(0)) == 0, F.floor(F.sqrt(F.col("_n").cast("double")))) \
        .otherwise(F.col("cnt")).cast("double")
    share = cnt / F.col("_n").cast("double")
    raw = share if how == "non_null_reinforcement" else (F.lit(1.0) - share)
    return long.select("label", (F.lit(lo) + F.lit(hi - lo) * raw).alias("weight"))


# ---------------------------------------------------------------- A13/A14: summaries
def subgroup_summary(df: DataFrame, key: str, flags: list[str], outcomes: list[str],
                     fractions=(1.0, 0.5, 0.1), seed: int = K.SPLIT_SEED) -> DataFrame:
    """Mean and sample std of every outcome over rows with ``flag == 1``, on deterministic
    hash samples of each fraction -> (fraction, flag, outcome, n, mean, std)."""
    slot = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), 1, 8), 16, 10) \
        .cast("bigint")  # 32 bits
    fr = F.array(*[F.lit(float(f)) for f in fractions])
    long = (df.select(key, slot.alias("_slot"), *flags, *[F.col(o).cast("double").alias(o) for o in outcomes])
            .unpivot([key, "_slot", *outcomes], flags, "flag", "_fv").filter(F.col("_fv") == 1)
            .unpivot([key, "_slot", "flag"], outcomes, "outcome", "value")
            .withColumn("fraction", F.explode(fr))
            .filter(F.col("_slot") < F.col("fraction") * 4294967296.0))
    return long.groupBy("fraction", "flag", "outcome").agg(
        F.count("value").cast("bigint").alias("n"), F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"))


def mean_ci(df: DataFrame, value_col: str, by: list[str] | None = None, confidence: float = K.CONFIDENCE) -> DataFrame:
    """Mean, sample std, n and Student-t half-width per group (NaN and NULL dropped)."""
    v = F.col(value_col).cast("double")
    base = df.filter(v.isNotNull() & ~F.isnan(v))
    g = base.groupBy(*(by or [])).agg(F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"),
                                      F.count(v).cast("bigint").alias("n"))
    half = t_critical(F.col("n") - 1, confidence) * F.col("std") / F.sqrt(F.col("n").cast("double"))
    return g.withColumn("half_width", half) \
            .withColumn("ci_lower", F.col("mean") - F.col("half_width")) \
            .withColumn("ci_upper", F.col("mean") + F.col("half_width"))


# ---------------------------------------------------------------- A15/A16: over the metric history
def best_per_label(history: DataFrame, split: str = "test") -> DataFrame:
    """Max over epochs of each (label, metric), NaN/NULL counted as 0."""
    v = F.coalesce(F.nanvl(F.col("value"), F.lit(0.0)), F.lit(0.0))
    return history.filter(F.col("split") == split).groupBy("run_id", "label", "metric") \
        .agg(F.max(v).alias("best_value"))


def best_epoch(history: DataFrame, loss_metric: str = "loss", split: str = "test") -> DataFrame:
    """The (epoch, loss) with the smallest loss per run (ties: earliest epoch)."""
    h = history.filter((F.col("metric") == loss_metric) & (F.col("split") == split) & (F.col("label") == "all"))
    return h.groupBy("run_id").agg(
        F.min_by(F.col("epoch"), F.struct(F.col("value"), F.col("epoch"))).alias("best_epoch"),
        F.min("value").alias("best_loss"))
