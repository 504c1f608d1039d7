"""Evaluation operators against direct numpy computations on small data with ties."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from regtext.operators import metrics as M


def brute(y, s):
    y, s = np.asarray(y), np.asarray(s)
    P, N = y.sum(), (1 - y).sum()
    # AUC: probability a positive outranks a negative, ties count half
    pos, neg = s[y == 1], s[y == 0]
    auc = ((pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()) / (P * N)
    thr = np.unique(s)[::-1]
    prec = np.array([y[s >= t].mean() for t in thr])
    rec = np.array([y[s >= t].sum() / P for t in thr])
    ap = np.sum(np.diff(np.concatenate([[0.0], rec])) * prec)
    # curve kept down to the first threshold reaching full recall
    last = np.argmax(rec >= 1.0)
    curve = list(zip(thr[:last + 1], prec[:last + 1], rec[:last + 1]))
    best = min(curve, key=lambda c: (abs(c[1] - c[2]), c[0]))
    return auc, ap, curve, best[0]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_numpy(spark, seed):
    rng = np.random.default_rng(seed)
    n = 150
    y = rng.integers(0, 2, n)
    s = np.round(rng.random(n) * 20) / 20  # many ties
    df = spark.createDataFrame([(i, "a", int(a), float(b)) for i, (a, b) in enumerate(zip(y, s))],
                               "row_id long, label string, y_true int, score double")
    cum = M.cumulative_counts(df, score_buckets=7)  # few buckets: the two-level path is exercised
    auc, ap, curve, best = brute(y, s)
    assert M.roc_auc(cum).collect()[0].auc == pytest.approx(auc)
    assert M.average_precision(cum).collect()[0].ap == pytest.approx(ap)
    got = sorted((r.threshold, r.precision, r.recall) for r in M.pr_curve(cum).collect())
    assert len(got) == len(curve)
    for g, c in zip(got, sorted(curve)):
        assert g == pytest.approx(c)
    assert M.optimal_thresholds(M.pr_curve(cum)).collect()[0].threshold == pytest.approx(best)


def test_auc_invariant_under_monotone_transform(spark):
    rng = np.random.default_rng(7)
    y = rng.integers(0, 2, 120)
    s = rng.random(120)
    df = spark.createDataFrame([(i, "a", int(a), float(b)) for i, (a, b) in enumerate(zip(y, s))],
                               "row_id long, label string, y_true int, score double")
    a1 = M.roc_auc(M.cumulative_counts(df)).collect()[0].auc
    a2 = M.roc_auc(M.cumulative_counts(df.withColumn("score", F.col("score") ** 3))).collect()[0].auc
    assert a1 == pytest.approx(a2)


def test_swapped_classes(spark):
    rng = np.random.default_rng(9)
    y = rng.integers(0, 2, 80)
    s = rng.random(80)
    df = spark.createDataFrame([(i, "a", int(a), float(b)) for i, (a, b) in enumerate(zip(y, s))],
                               "row_id long, label string, y_true int, score double")
    a1 = M.roc_auc(M.cumulative_counts(df)).collect()[0].auc
    flipped = df.withColumn("y_true", 1 - F.col("y_true")).withColumn("score", 1 - F.col("score"))
    assert M.roc_auc(M.cumulative_counts(flipped)).collect()[0].auc == pytest.approx(a1)


def test_bucketing_does_not_change_results(spark):
    rng = np.random.default_rng(11)
    y = rng.integers(0, 2, 200)
    s = np.round(rng.random(200) ** 6, 4)  # crowded near 0, with ties
    df = spark.createDataFrame([(i, "a", int(a), float(b)) for i, (a, b) in enumerate(zip(y, s))],
                               "row_id long, label string, y_true int, score double")
    ref = None
    for nb in (1, 7, 4096):
        r = M.label_stats(M.cumulative_counts(df, score_buckets=nb)).collect()[0]
        got = (round(r.auc, 12), round(r.ap, 12), r.threshold, r.tp, r.fp, r.fn, r.tn)
        ref = ref or got
        assert got == ref
