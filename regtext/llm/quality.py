"""Operator 1, quality rules: cut-offs with a guaranteed limit on false rejection.

Each rule scores a document in [0, 1] (higher is worse) and rejects it above a cut-off. The cut-off of
every (stratum, rule) is chosen on labelled holdout documents. For a cut-off with k rejections among
the n documents labelled good, the exact binomial tail P[Bin(n, a) <= k] is a p-value for "the false
rejection rate exceeds a". Cut-offs are tested from the most lenient to the strictest and the search
stops at the first that is not significant (fixed-sequence testing, which needs no correction inside
the sequence); the level is split evenly over all (stratum, rule) sequences (Bonferroni), and the
permitted rate of a stratum evenly over its rules. With confidence ``1 - delta`` no stratum loses more
than the share ``max_false_rejection`` of its good documents to the rules, all strata at once.

Defined cases: a NULL or blank text has no words (it fails the base rule); a NULL stratum is a stratum
of its own; a stratum without enough labelled good documents certifies no cut-off and rejects nothing
beyond the base rule; a document labelled several times counts as good only if every label says so;
NULL ids and NULL labels take no part in the holdout; repeated rows are scored row by row; an empty
table gives an empty result; extra columns are ignored or passed on by ``filter_documents``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import bind, fresh, or_empty, words

# fixed values of the contract
MIN_WORDS = 20
WINDOW = 8
MAX_REPEAT_PERCENT = 30
SYMBOLS = "#*$%&|<>"

# lenient to strict; a document is rejected above its cut-off
CUTOFFS = (0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.15, 0.1, 0.05, 0.02)
RULES = ("symbols", "repeats", "dup_lines", "uppercase", "monotony")
MAX_FALSE_REJECTION = 0.02
DELTA = 0.05


def repeat_words(ws: Column) -> Column:
    """Words lying in ``WINDOW``-word windows that occur at least twice in the text.

    Repeated windows are adjacent once (hash, position) pairs are sorted; each start then covers
    ``WINDOW`` words, or fewer where the next start comes sooner. n log n for n words, no pairs.
    """
    def covered(starts):
        nexts = F.slice(starts, F.lit(2), F.greatest(F.size(starts), F.lit(1)))
        steps = F.zip_with(starts, nexts, lambda a, b: F.coalesce(F.least(b - a, F.lit(WINDOW)), F.lit(WINDOW)))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda acc, x: acc + x)

    def repeated(s):
        same = lambda x, j: F.coalesce(F.get(s, j)["h"] == x["h"], F.lit(False))
        return F.transform(F.filter(s, lambda x, j: same(x, j - 1) | same(x, j + 1)), lambda x: x["i"])

    def from_hashes(hs):
        pairs = F.sort_array(F.transform(hs, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hs)) == F.size(hs), F.lit(0).cast("long")).otherwise(
            bind(F.sort_array(bind(pairs, repeated)), covered))

    def from_words(a):
        hashes = F.transform(F.sequence(F.lit(1), F.size(a) - (WINDOW - 1)),
                             lambda i: F.xxhash64(F.slice(a, i, F.lit(WINDOW))))
        return F.when(F.size(a) > WINDOW, bind(hashes, from_hashes)).otherwise(F.lit(0).cast("long"))

    return bind(ws, from_words)


def _share(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0)).cast("double")


def features(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns plus one struct column per document: base counts and the rules' scores."""
    name = fresh(keep, "features")
    ws, ls, raw = (fresh(keep, c) for c in ("words_", "lines_", "raw_"))
    d = docs.select(*keep, or_empty(F.col(text)).alias(raw), words(F.col(text)).alias(ws),
                    F.filter(F.split(or_empty(F.col(text)), "\n"), lambda l: F.btrim(l, F.lit(" \t\n\x0b\x0c\r")) != "")
                    .alias(ls))
    without = lambda pattern: F.length(F.regexp_replace(F.col(raw), pattern, ""))
    n, chars = F.size(ws).cast("long"), F.length(raw)
    d = d.select(*keep, F.struct(
        n.alias("n_words"),
        without(r"[\x20\x09-\x0D]+").cast("long").alias("word_chars"),
        (chars - without(r"[#*$%&|<>]+")).cast("long").alias("n_symbols"),
        (chars - without(r"[A-Z]+")).cast("long").alias("n_upper"),
        F.size(ls).cast("long").alias("n_lines"),
        (F.size(ls) - F.size(F.array_distinct(ls))).cast("long").alias("n_dup_lines"),
        F.size(F.array_distinct(ws)).cast("long").alias("n_distinct"),
        repeat_words(F.col(ws)).alias("n_repeat_words")).alias(name))
    f = F.col(name)
    scores = F.struct(_share(f["n_symbols"], f["word_chars"]).alias("symbols"),
                      _share(f["n_repeat_words"], f["n_words"]).alias("repeats"),
                      _share(f["n_dup_lines"], f["n_lines"]).alias("dup_lines"),
                      _share(f["n_upper"], f["word_chars"]).alias("uppercase"),
                      _share(f["n_words"] - f["n_distinct"], f["n_words"]).alias("monotony"))
    failed = (f["n_words"] < MIN_WORDS) | (f["n_repeat_words"] * 100 > f["n_words"] * MAX_REPEAT_PERCENT)
    return d.select(*keep, f.withField("scores", scores).withField("base_failed", failed).alias(name))


def _log_factorial(x: Column) -> Column:
    table = F.array(*[F.lit(math.lgamma(i + 1)) for i in range(16)])
    x = x.cast("double")
    series = (x + 0.5) * F.log(x) - x + F.lit(0.5 * math.log(2 * math.pi)) + 1 / (12 * x) - 1 / (360 * x * x * x) \
        + 1 / (1260 * x * x * x * x * x)
    return F.when(x < 16, F.element_at(table, F.least(x, F.lit(15.0)).cast("int") + 1)).otherwise(series)


def binomial_tail(n: Column, k: Column, rate: float, terms: int = 2000) -> Column:
    """P[Bin(n, rate) <= k], and 1 from the mean upwards (no evidence there).

    Terms are added downwards from k, where they shrink at least geometrically. Beyond ``terms`` of
    them the geometric remainder is added, which bounds the true sum from above, so a cut-off is
    never certified by the shortening.
    """
    n, k = n.cast("double"), k.cast("double")
    odds = (1 - rate) / rate
    top = _log_factorial(n) - _log_factorial(k) - _log_factorial(n - k) + k * math.log(rate) + (n - k) * math.log1p(-rate)
    ratio = lambda j: (k - j + 1) / (n - k + j) * odds  # noqa: E731  of the j-th term below k to the one before
    start = F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s"))

    def add(acc, j):
        t = acc["t"] * ratio(j)
        return F.struct(t.alias("t"), (acc["s"] + t).alias("s"))

    steps = F.when(k >= 1, F.sequence(F.lit(1), F.least(k, F.lit(float(terms))).cast("int"))).otherwise(
        F.array().cast("array<int>"))
    total = F.aggregate(steps, start, add, lambda acc: acc["s"] + F.when(
        k > terms, acc["t"] * ratio(F.lit(terms + 1.0)) / (1 - ratio(F.lit(terms + 1.0)))).otherwise(F.lit(0.0)))
    return F.when((n <= 0) | (k >= n * rate), F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.exp(top) * total))


def calibrate(scored: DataFrame, labels: DataFrame, stratum: str = "lang", key: str = "doc_id", label: str = "quality",
              feature: str = "features", max_false_rejection: float = MAX_FALSE_REJECTION, delta: float = DELTA) -> DataFrame:
    """One row per stratum of the holdout: ``stratum``, ``n_good`` and a struct ``cut`` of cut-offs by
    rule (NULL where none is certified). Labels and scores are joined without the texts, and one
    partial aggregate counts the rejections of every cut-off."""
    good = labels.filter(F.col(key).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(key).alias("k_")) \
        .agg(F.min(label).alias("good_")).filter("good_ = 1").select("k_")
    rows = scored.select(F.col(key).alias("k_"), F.col(stratum).alias("stratum"), F.col(feature)["scores"].alias("s_"))
    held = rows.join(good, "k_")
    counts = held.groupBy("stratum").agg(F.count("*").alias("n_good"), *[
        F.sum((F.col("s_")[r] > c).cast("long")).alias(f"{r}_{i}") for r in RULES for i, c in enumerate(CUTOFFS)])
    counts = materialize(counts, "quality-counts")  # a row per stratum
    level = delta / (max(counts.count(), 1) * len(RULES))
    rate = max_false_rejection / len(RULES)

    tests = F.transform(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(c).alias("c"), F.col(f"{r}_{i}").alias("k"))
                                  for r in RULES for i, c in enumerate(CUTOFFS)]),
                        lambda t: t.withField("ok", binomial_tail(F.col("n_good"), t["k"], rate) <= level))

    def chosen(rule):
        start = F.struct(F.lit(None).cast("double").alias("cut"), F.lit(True).alias("open"))
        return F.aggregate(F.filter("tests", lambda t: t["rule"] == rule), start, lambda acc, t: F.when(
            acc["open"] & t["ok"], F.struct(t["c"].alias("cut"), F.lit(True).alias("open")))
            .otherwise(F.struct(acc["cut"].alias("cut"), F.lit(False).alias("open"))))["cut"]

    counts = counts.select("stratum", "n_good", tests.alias("tests"))
    return counts.select("stratum", "n_good", F.struct(*[chosen(r).alias(r) for r in RULES]).alias("cut"))


def judge(scored: DataFrame, cutoffs: DataFrame, stratum: str = "lang", feature: str = "features") -> DataFrame:
    """``scored`` plus ``kept`` (boolean) and ``rejected_by`` (names of the rules above their cut-off)."""
    kept, by = fresh(scored.columns, "kept"), fresh(scored.columns, "rejected_by")
    group, cut = fresh(scored.columns, "stratum_"), fresh(scored.columns, "cut_")
    joined = scored.join(cutoffs.select(F.col("stratum").alias(group), F.col("cut").alias(cut)),
                         F.col(stratum).eqNullSafe(F.col(group)), "left")
    f = F.col(feature)
    hits = F.array_compact(F.array(*[F.when(f["scores"][r] > F.col(cut)[r], F.lit(r)) for r in RULES]))
    return joined.withColumn(by, hits).withColumn(kept, ~f["base_failed"] & (F.size(by) == 0)).drop(group, cut)


def filter_documents(docs: DataFrame, labels: DataFrame, stratum: str = "lang", key: str = "doc_id",
                     text: str = "text") -> DataFrame:
    """The documents that the rules keep, all columns. Features are computed once and written beside
    the texts under the shared folder; the calibration reads only the narrow columns of that table."""
    scored = materialize(features(docs, docs.columns, text), "quality-scored")
    name = fresh(docs.columns, "features")
    verdict = judge(scored, calibrate(scored, labels, stratum, key, feature=name), stratum, name)
    return verdict.filter(F.col(fresh(scored.columns, "kept"))).select(*docs.columns)
