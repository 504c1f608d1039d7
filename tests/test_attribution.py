"""Token attribution as a table job."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, RegexTokenizer
from pyspark.sql import functions as F

from regtext.operators import attribution as AT

from .data import table

N = 1 << 12


def corpus(n=80, seed=2):
    rnd = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        y, z = i % 2, int(i % 3 == 0)
        words = [f"w{rnd.randrange(60)}" for _ in range(rnd.randint(0, 25))] + ["Gamma"] * y + ["delta"] * (2 * z)
        docs.append((i, " ".join(words) if i % 13 else None))
        labels.append((i, y, z if i % 7 else None))
    return docs, labels + [(900, 1, 1)]


@pytest.fixture(scope="module")
def frames(spark):
    docs, labels = corpus()
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, y int, z int")


def by_hand(docs, labels, weight, names=("y", "z")):
    y = {r[0]: dict(zip(names, r[1:])) for r in labels}
    rows = [(Counter((t or "").lower().split()), y[i]) for i, t in docs if i in y]
    out = {}
    for l in names:
        n_pos = sum(r[l] == 1 for _, r in rows)
        for w in {w for c, _ in rows for w in c}:
            s, pos = sum(c[w] for c, _ in rows), sum(c[w] for c, r in rows if r[l] == 1)
            out[l, w] = weight(l, w) * (pos - n_pos * s / len(rows))
    return out


def test_given_weights_through_the_table_equal_the_formula(spark, frames):
    """Any weight table gives the arithmetic of m14b; tokens without a weight get 0."""
    docs, labels = frames
    rnd = np.random.default_rng(1)
    w = {l: np.where(rnd.random(N) < 0.7, rnd.normal(size=N), 0.0) for l in ("y", "z")}
    tokens = docs.filter("text IS NOT NULL").join(labels, "doc_id").select("y", "z", F.explode(F.split(F.lower("text"), " ")).alias("token"))
    sums = AT.token_sums(tokens.filter("token <> ''"), "token", ["y", "z"])
    n = AT.totals(docs.join(labels, "doc_id"), ["y", "z"])
    got = {(r.label, r.token): r.attribution for r in AT.weighted_attribution(sums, n, AT.coefficient_table(spark, w), ["y", "z"], N).collect()}
    at = {r.token: r.feature for r in AT.token_features(sums.select("token"), N).collect()}
    want = by_hand(*corpus(), lambda l, t: w[l][at[t]])
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(v, abs=1e-9) for k, v in want.items())


def test_feature_numbers_are_the_transformers(spark):
    words = [f"word{i}" for i in range(50)] + ["ü", "a b"]
    got = {r.token: r.feature for r in AT.token_features(spark.createDataFrame([(w,) for w in words], "token string"), N).collect()}
    vec = HashingTF(inputCol="t", outputCol="v", numFeatures=N)
    for w in words[::7] + ["ü"]:
        assert vec.transform(spark.createDataFrame([([w],)], "t array<string>")).first().v.indices.tolist() == [got[w]]


def test_fitted_attribution_equals_the_formula_with_the_fitted_weights(spark, frames):
    docs, labels = frames
    tokens = RegexTokenizer(inputCol="text", outputCol="t", pattern=r"[^\p{L}\p{N}]+").transform(docs.filter("text IS NOT NULL").join(labels, "doc_id"))
    rows = HashingTF(inputCol="t", outputCol="features", numFeatures=N).transform(tokens)
    w = {l: LogisticRegression(labelCol=l, regParam=0.01, maxIter=50).fit(rows.filter(F.col(l).isNotNull())).coefficients.toArray() for l in ("y", "z")}
    at = {r.token: r.feature for r in AT.token_features(tokens.select(F.explode("t").alias("token")).distinct(), N).collect()}
    d, l = corpus()
    want = by_hand([x for x in d if x[1] is not None], l, lambda name, t: w[name][at[t]])
    got = AT.attribution(docs.filter("text IS NOT NULL"), "doc_id", "text", labels, ["y", "z"], k=5, num_features=N).collect()
    for name in ("y", "z"):
        top = sorted((-v, t) for (n, t), v in want.items() if n == name)[:5]
        mine = sorted((-r.attribution, r.token) for r in got if r.label == name)
        assert [t for _, t in mine] == [t for _, t in top]
        assert [v for v, _ in mine] == pytest.approx([v for v, _ in top], rel=1e-3, abs=1e-6)
    assert {(r.label, r.token) for r in got} >= {("y", "gamma"), ("z", "delta")}


def test_the_ranking_is_limited_before_the_shuffle(spark):
    rows = spark.createDataFrame([(f"t{i}", l, float(i % 40)) for i in range(200) for l in "ab"], "token string, label string, attribution double")
    top = AT.top_tokens(rows, 3)
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and plan.rindex("Exchange") < plan.rindex("WindowGroupLimit")  # one below the exchange
    assert table(top) == sorted(map(repr, [(t, l, 39.0) for t in ("t119", "t159", "t199") for l in "ab"]))


def test_empty_tables(spark):
    sums = AT.token_sums(spark.createDataFrame([], "token string, y int"), "token", ["y"])
    weights = AT.coefficient_table(spark, {"y": np.zeros(N)})
    assert weights.count() == 0
    assert AT.weighted_attribution(sums, {"": 0, "y": 0}, weights, ["y"], N).count() == 0
