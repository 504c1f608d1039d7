"""Distributed multi-label evaluation.

Input is a long table ``(row_id, label, y_true, score)``. Curves and rank statistics need
cumulative sums over descending score per label. They are built in two levels so that no task
sorts a whole label: scores are first pre-aggregated per (label, score); the distinct scores of a
label are cut into ``score_buckets`` buckets at their quantiles; per-bucket totals give each bucket
its base, and the running sum inside a bucket is a window partitioned by (label, bucket).

All ratios are DOUBLE (``sum(int)/2`` would be DECIMAL) and undefined ratios are NULL.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

LABEL, Y, SCORE, ROW = "label", "y_true", "score", "row_id"


def _d(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("double")


def safe_div(a, b) -> Column:
    return F.when(_d(b) == 0, F.lit(None).cast("double")).otherwise(_d(a) / _d(b))


def wide_to_long(df: DataFrame, row_id: str, truth_cols: dict[str, str], score_cols: dict[str, str]) -> DataFrame:
    """Wide (one truth and one score column per label) -> long ``(row_id, label, y_true, score)``."""
    labels = list(truth_cols)
    st = F.array(*[F.struct(F.lit(l).alias(LABEL), F.col(truth_cols[l]).cast("int").alias(Y),
                            F.col(score_cols[l]).cast("double").alias(SCORE)) for l in labels])
    return df.select(F.col(row_id).alias(ROW), F.inline(st))


# ---------------------------------------------------------------- cumulative counts
# Every operator takes ``by``: extra grouping columns (an epoch, a run, a split) evaluated in the
# same plan, so E epochs cost one job, not E.
def _g(by) -> list[str]:
    return [*by, LABEL]


def usable(long: DataFrame) -> DataFrame:
    """Rows with a truth and a score: NULL and NaN scores rank nowhere and are left out of every metric."""
    return long.filter(F.col(Y).isNotNull() & F.col(SCORE).isNotNull() & ~F.isnan(F.col(SCORE).cast("double")))


def unusable_count(long: DataFrame, by: tuple = ()) -> DataFrame:
    """(by.., label, n_unusable): how many rows ``usable`` leaves out."""
    bad = F.col(Y).isNull() | F.col(SCORE).isNull() | F.isnan(F.col(SCORE).cast("double"))
    return long.groupBy(*_g(by)).agg(F.sum(bad.cast("bigint")).alias("n_unusable"))


def cumulative_counts(long: DataFrame, score_buckets: int = 512, by: tuple = (), pooled: str | None = None) -> DataFrame:
    """(by.., label, score, pos, neg, tp, fp, P, N): tp/fp count rows with score >= this score.

    ``pooled`` adds one more label holding all labels together (micro averages of rank metrics), from
    the same aggregate over grouping sets. Running sums are two-level: the distinct scores of a label
    are cut at their own quantiles, so every bucket holds about ``1 / score_buckets`` of them however
    crowded the scores are, and the sum inside a bucket is a window partitioned by (label, bucket).
    The per-score counts are written once under the shared folder."""
    g = _g(by)
    sums = (F.sum(F.col(Y).cast("bigint")).alias("pos"), F.sum((1 - F.col(Y)).cast("bigint")).alias("neg"))
    rows = usable(long)
    if pooled is None:
        c = rows.groupBy(*g, SCORE).agg(*sums)
    else:
        rows = rows.select(*by, LABEL, SCORE, Y)
        c = rows.groupingSets([[*by, LABEL, SCORE], [*by, SCORE]], *by, LABEL, SCORE).agg(*sums, F.grouping(LABEL).alias("_all"))
        c = c.select(*by, F.when(F.col("_all") == 1, F.lit(pooled)).otherwise(F.col(LABEL)).alias(LABEL), SCORE, "pos", "neg")
    # read four times below; the scored rows (a model's output) are evaluated once
    c = materialize(c, "score-counts")
    points = [i / score_buckets for i in range(1, score_buckets)]
    cuts = c.groupBy(*g).agg(F.percentile_approx(F.col(SCORE).cast("double"), points, 20 * score_buckets).alias("_q"),
                             F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    below = lambda q: F.aggregate(F.sequence(F.lit(1), F.lit(score_buckets.bit_length())),  # noqa: E731  binary search
                                  F.struct(F.lit(0).alias("lo"), F.size(q).alias("hi")), lambda acc, _: _halve(acc, q), lambda acc: acc["lo"])
    nulls = [F.col(x).eqNullSafe(F.col(f"_c{i}")) for i, x in enumerate(g)]
    named = cuts.select(*[F.col(x).alias(f"_c{i}") for i, x in enumerate(g)], "_q", "P", "N")
    c = c.join(named, reduce(lambda a, b: a & b, nulls)).select(*g, SCORE, "pos", "neg", "P", "N", below(F.col("_q")).alias("_b"))
    tot = c.groupBy(*g, "_b").agg(F.sum("pos").alias("_bp"), F.sum("neg").alias("_bn"))
    above = Window.partitionBy(*g).orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)
    # windows below run over the per-(label, bucket) totals: at most groups x score_buckets rows
    bases = tot.select(*g, "_b",
                       F.coalesce(F.sum("_bp").over(above), F.lit(0)).alias("_base_p"),
                       F.coalesce(F.sum("_bn").over(above), F.lit(0)).alias("_base_n"))
    inb = Window.partitionBy(*g, "_b").orderBy(F.desc(SCORE)).rowsBetween(Window.unboundedPreceding, 0)
    return (c.join(bases, [*g, "_b"])  # labels without a name have no curve
            .select(*g, SCORE, "pos", "neg",
                    (F.col("_base_p") + F.sum("pos").over(inb)).alias("tp"),
                    (F.col("_base_n") + F.sum("neg").over(inb)).alias("fp"), "P", "N"))


def _halve(acc: Column, q: Column) -> Column:
    mid = F.floor((acc["lo"] + acc["hi"]) / 2).cast("int")
    open_ = acc["lo"] < acc["hi"]
    right = F.get(q, mid) < F.col(SCORE).cast("double")
    return F.struct(F.when(open_ & right, mid + 1).otherwise(acc["lo"]).alias("lo"),
                    F.when(open_ & ~right, mid).otherwise(acc["hi"]).alias("hi"))


def pr_curve(cum: DataFrame, by: tuple = ()) -> DataFrame:
    """M4: (label, threshold, precision, recall, tp, fp) for every distinct score, descending
    thresholds below the first one reaching full recall dropped (as the common library does)."""
    return (cum.filter((F.col("tp") - F.col("pos")) < F.col("P"))
            .select(*_g(by), F.col(SCORE).alias("threshold"),
                    safe_div("tp", F.col("tp") + F.col("fp")).alias("precision"),
                    safe_div("tp", "P").alias("recall"), "tp", "fp"))


def roc_auc(cum: DataFrame, by: tuple = ()) -> DataFrame:
    """M8: tie-aware ROC AUC (Mann-Whitney) per label -> (label, auc)."""
    contrib = F.col("neg").cast("double") * ((F.col("tp") - F.col("pos")).cast("double") + F.col("pos") / F.lit(2.0))
    return cum.groupBy(*_g(by)).agg(
        safe_div(F.sum(contrib), F.first("P").cast("double") * F.first("N").cast("double")).alias("auc"))


def average_precision(cum: DataFrame, by: tuple = ()) -> DataFrame:
    """Average precision = sum over thresholds of (recall step) x precision -> (label, ap)."""
    term = F.when(F.col("P") > 0, (F.col("pos") / F.col("P").cast("double")) *
                  (F.col("tp") / (F.col("tp") + F.col("fp")).cast("double")))
    return cum.groupBy(*_g(by)).agg(F.when(F.first("P") > 0, F.sum(term)).alias("ap"))


def optimal_thresholds(curve: DataFrame, by: tuple = ()) -> DataFrame:
    """M7: per label the threshold minimising |precision - recall| (ties: lowest threshold)."""
    gap = F.abs(F.col("precision") - F.col("recall"))
    return curve.filter(F.col("precision").isNotNull() & F.col("recall").isNotNull()).groupBy(*_g(by)).agg(
        F.min_by(F.col("threshold"), F.struct(gap, F.col("threshold"))).alias("threshold"))


def label_stats(cum: DataFrame, by: tuple = (), at: float | None = None) -> DataFrame:
    """M7 + M8 + M10 in one aggregate over the cumulative table ->
    (by.., label, auc, ap, threshold, tp, fp, fn, tn, P, N): ROC AUC, average precision, the tuned
    threshold and the confusion counts of ``score > threshold`` -- read off the same rows (at the
    chosen threshold row, rows strictly above it are ``tp - pos`` / ``fp - neg``), so the scored
    rows are not scanned a second time. A label without a curve predicts nothing positive. With ``at`` also the counts
    ``tp_at, fp_at, fn_at`` of ``score >= at``."""
    contrib = F.col("neg").cast("double") * ((F.col("tp") - F.col("pos")).cast("double") + F.col("pos") / F.lit(2.0))
    prec = F.col("tp") / (F.col("tp") + F.col("fp")).cast("double")
    rec = F.col("tp") / F.col("P").cast("double")
    on_curve = ((F.col("tp") - F.col("pos")) < F.col("P")) & (F.col("P") > 0) & ((F.col("tp") + F.col("fp")) > 0)
    # rows off the curve get a NULL ordering and are skipped by min_by
    order = F.when(on_curve, F.struct(F.abs(prec - rec).alias("gap"), F.col(SCORE).alias("t")))
    pick = F.struct(F.col(SCORE).alias("threshold"), (F.col("tp") - F.col("pos")).alias("tp_gt"),
                    (F.col("fp") - F.col("neg")).alias("fp_gt"))
    fixed = [] if at is None else [F.sum(F.when(c, F.col(x)).otherwise(0)).alias(n) for n, c, x in (
        ("tp_at", F.col(SCORE) >= at, "pos"), ("fp_at", F.col(SCORE) >= at, "neg"), ("fn_at", F.col(SCORE) < at, "pos"))]
    agg = cum.groupBy(*_g(by)).agg(
        safe_div(F.sum(contrib), F.first("P").cast("double") * F.first("N").cast("double")).alias("auc"),
        F.when(F.first("P") > 0, F.sum(F.when(F.col("P") > 0, (F.col("pos") / F.col("P").cast("double")) * prec)))
        .alias("ap"),
        F.min_by(pick, order).alias("_pick"), F.first("P").alias("P"), F.first("N").alias("N"), *fixed)
    tp = F.coalesce(F.col("_pick.tp_gt"), F.lit(0)).cast("bigint")
    fp = F.coalesce(F.col("_pick.fp_gt"), F.lit(0)).cast("bigint")
    return agg.select(*_g(by), "auc", "ap", F.col("_pick.threshold").alias("threshold"), tp.alias("tp"),
                      fp.alias("fp"), (F.col("P") - tp).cast("bigint").alias("fn"),
                      (F.col("N") - fp).cast("bigint").alias("tn"), "P", "N",
                      *([] if at is None else ["tp_at", "fp_at", "fn_at"]))


# ---------------------------------------------------------------- confusion counts
def confusion(long: DataFrame, pred: Column, by: tuple = ()) -> DataFrame:
    """Per label tp, fp, fn, tn from a 0/1 prediction expression."""
    p = pred.cast("int")
    y = F.col(Y).cast("int")
    return usable(long).groupBy(*_g(by)).agg(
        F.sum(((p == 1) & (y == 1)).cast("bigint")).alias("tp"),
        F.sum(((p == 1) & (y == 0)).cast("bigint")).alias("fp"),
        F.sum(((p == 0) & (y == 1)).cast("bigint")).alias("fn"),
        F.sum(((p == 0) & (y == 0)).cast("bigint")).alias("tn"))


def prf(counts: DataFrame) -> DataFrame:
    """M5: precision = tp/(tp+fp), recall = tp/(tp+fn), F1 -- NULL when undefined."""
    p = safe_div("tp", F.col("tp") + F.col("fp"))
    r = safe_div("tp", F.col("tp") + F.col("fn"))
    return counts.select("*", p.alias("precision"), r.alias("recall")).withColumn(
        "f1", F.when(F.col("precision").isNull() | F.col("recall").isNull(), F.lit(None).cast("double"))
        .otherwise(safe_div(F.lit(2.0) * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))))


def averaged_prf(counts: DataFrame, average: str = "micro", by: tuple = ()) -> DataFrame:
    """M6: one row per ``by`` group (average, precision, recall, f1); undefined values count as 0."""
    by = list(by)
    if average == "micro":
        t = counts.groupBy(*by).agg(F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"))
        out = prf(t.withColumn("tn", F.lit(0)))
        return out.select(*by, F.lit("micro").alias("average"),
                          *[F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in ("precision", "recall", "f1")])
    per = prf(counts).select(*by, *[F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in ("precision", "recall", "f1")],
                             (F.col("tp") + F.col("fn")).alias("support"))
    if average == "macro":
        return per.groupBy(*by).agg(F.lit("macro").alias("average"),
                                    *[F.avg(c).alias(c) for c in ("precision", "recall", "f1")])
    if average == "weighted":
        return per.groupBy(*by).agg(F.lit("weighted").alias("average"),
                                    *[safe_div(F.sum(F.col(c) * F.col("support")), F.sum("support")).alias(c)
                                      for c in ("precision", "recall", "f1")])
    raise ValueError(average)


# ---------------------------------------------------------------- M9 losses
def losses(long: DataFrame, gamma: float = 2.0, by: tuple = ()) -> DataFrame:
    """M9: per label mean binary cross-entropy (log clamped at -100) and focal loss on p_t
    (p clamped to [1e-4, 1-1e-4]); label ``all`` = mean BCE over every cell and the focal loss
    summed over labels (the original's per-row mean x number of labels)."""
    p = F.col(SCORE).cast("double")
    y = F.col(Y).cast("double")
    ln = lambda x: F.greatest(F.log(x), F.lit(-100.0))
    bce = -(y * ln(p) + (F.lit(1.0) - y) * ln(F.lit(1.0) - p))
    pt = F.least(F.greatest(F.when(y >= 0.5, p).otherwise(F.lit(1.0) - p), F.lit(1e-4)), F.lit(1 - 1e-4))
    focal = -F.pow(F.lit(1.0) - pt, F.lit(gamma)) * F.log(pt)
    per = usable(long).groupBy(*_g(by)).agg(F.avg(bce).alias("bce"), F.avg(focal).alias("focal"),
                                    F.count(F.lit(1)).alias("_n"), F.sum(bce).alias("_s"))
    total = per.groupBy(*by).agg(F.lit("all").alias(LABEL), (F.sum("_s") / F.sum("_n")).alias("bce"),
                                 F.sum("focal").alias("focal"))
    return per.select(*_g(by), "bce", "focal").unionByName(total)


# ---------------------------------------------------------------- M11 / M12 / M15 reports
def tuned_predictions(long: DataFrame, thresholds: DataFrame, by: tuple = ()) -> DataFrame:
    """Long table with ``pred`` = score > tuned threshold (labels without a threshold predict 0).
    The threshold table has one row per (group, label); how it is joined is left to the optimiser."""
    return long.join(thresholds, _g(by), "left") \
        .withColumn("pred", F.when(F.col(SCORE) > F.col("threshold"), 1).otherwise(0))


POOLED = "__pooled__"


def evaluation_report(long: DataFrame, auc: str = "roc", average: str = "micro",
                      score_buckets: int = 512, by: tuple = ()) -> DataFrame:
    """Per label (auc, threshold, precision, recall, f1) at the tuned threshold, plus one
    row for the ``average`` (auc pooled for micro, mean for macro, support-weighted for weighted),
    for every ``by`` group in one plan.

    Precision and recall are in the correct order (the original swapped them per label).
    """
    by = list(by)
    g = _g(by)
    cum = cumulative_counts(long, score_buckets, by=by, pooled=POOLED if average == "micro" else None)
    stats = label_stats(cum, by).withColumn("auc", F.col("auc" if auc == "roc" else "ap"))
    per_out = prf(stats.filter(F.col(LABEL) != POOLED)).select(*g, "auc", "threshold", "precision", "recall", "f1")
    avg_row = _average_row(prf(stats), average, by)
    return per_out.unionByName(avg_row.select(*g, "auc", "threshold", "precision", "recall", "f1"))


def _average_row(per: DataFrame, average: str, by: list[str]) -> DataFrame:
    """The averaged report row per ``by`` group, as one conditional aggregate over the per-label
    table (pooled row included for the micro AUC): micro pools the counts, macro averages the
    per-label values, weighted weighs them by support; undefined values count as 0."""
    real = F.col(LABEL) != POOLED
    z = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    sup = (F.col("tp") + F.col("fn")).cast("double")
    nul = F.lit(None).cast("double")
    if average == "micro":
        tp, fp, fn = (F.sum(F.when(real, F.col(c))) for c in ("tp", "fp", "fn"))
        p, r = safe_div(tp, tp + fp), safe_div(tp, tp + fn)
        f1 = safe_div(F.lit(2.0) * tp, F.lit(2.0) * tp + fp + fn)
        cols = [F.coalesce(p, F.lit(0.0)), F.coalesce(r, F.lit(0.0)), F.coalesce(f1, F.lit(0.0))]
        auc = F.max(F.when(~real, F.col("auc")))
    elif average == "macro":
        cols = [F.avg(F.when(real, z(c))) for c in ("precision", "recall", "f1")]
        auc = F.avg(F.when(real, F.col("auc")))
    elif average == "weighted":
        w = F.sum(F.when(real, sup))
        cols = [safe_div(F.sum(F.when(real, z(c) * sup)), w) for c in ("precision", "recall", "f1")]
        auc = safe_div(F.sum(F.when(real, F.col("auc") * sup)), w)
    else:
        raise ValueError(average)
    return per.groupBy(*by).agg(F.lit(average).alias(LABEL), auc.alias("auc"), nul.alias("threshold"),
                                *[c.alias(n) for c, n in zip(cols, ("precision", "recall", "f1"))])


def logits_report(long_logits: DataFrame, threshold: float = 0.5, score_buckets: int = 512) -> DataFrame:
    """Sigmoid of logits; micro precision/recall/F1 at ``threshold`` and micro ROC AUC on the
    probabilities; per label ROC AUC and F1 at the tuned threshold -> (metric, label, value). All of it is
    read off one cumulative table."""
    probs = long_logits.withColumn(SCORE, F.lit(1.0) / (F.lit(1.0) + F.exp(-F.col(SCORE).cast("double"))))
    st = prf(label_stats(cumulative_counts(probs, score_buckets, pooled=POOLED), at=threshold))
    real = F.col(LABEL) != POOLED
    tp, fp, fn = (F.col(f"{c}_at") for c in ("tp", "fp", "fn"))
    cell = lambda metric, label, v: F.struct(F.lit(metric).alias("metric"), label.alias(LABEL), v.cast("double").alias("value"))
    zero = lambda v: F.coalesce(v, F.lit(0.0))
    rows = F.when(real, F.array(cell("auc", F.col(LABEL), F.col("auc")), cell("f1", F.col(LABEL), zero(F.col("f1"))))).otherwise(F.array(
        cell("roc_auc_micro", F.lit("all"), F.col("auc")), cell("precision_micro", F.lit("all"), zero(safe_div(tp, tp + fp))),
        cell("recall_micro", F.lit("all"), zero(safe_div(tp, tp + fn))),
        cell("f1_micro", F.lit("all"), zero(safe_div(F.lit(2.0) * tp, F.lit(2.0) * tp + fp + fn)))))
    return st.select(F.inline(rows))


def outcome(pred: Column) -> Column:
    """tp / fp / fn / tn of a 0/1 prediction against the truth column."""
    p, y = pred.cast("int"), F.col(Y).cast("int")
    return F.when((p == 1) & (y == 0), "fp").when((p == 0) & (y == 1), "fn").when((p == 1) & (y == 1), "tp") \
        .when((p == 0) & (y == 0), "tn")


def error_types(long: DataFrame, pred: Column, texts: DataFrame | None = None) -> DataFrame:
    """Tp / fp / fn / tn per (row, label), with the row's columns of ``texts(row_id, ...)`` if given.
    Rows without a truth or a score have no outcome (NULL)."""
    out = long.select(ROW, LABEL, outcome(pred).alias("outcome"))
    return out if texts is None else out.join(texts, ROW)


def error_types_wide(long: DataFrame, pred: Column, labels: list[str], texts: DataFrame | None = None) -> DataFrame:
    """M15, one column per label with its outcome (NULL where a row has no outcome for it)."""
    kinds = [F.max(F.when(F.col(LABEL) == F.lit(l), F.col("outcome"))).alias(l) for l in labels]
    out = error_types(long, pred).groupBy(ROW).agg(*kinds)
    return out if texts is None else out.join(texts, ROW)
