"""Networks trained by epochs (M2), their tables (S7, S9), the search by halving."""

import random
import tempfile

import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from regtext.operators import models as ML
from regtext.operators import stats as A
from regtext.operators import training as TR
from regtext.session import materialize
from regtext.sources import sinks as SINK

from .data import table


@pytest.fixture(scope="module")
def data(spark):
    """Two labels on four features: one is a corner rule that a straight line cannot draw, one a single feature."""
    rnd = random.Random(3)
    rows = []
    for i in range(400):
        x = [rnd.choice([0.0, 1.0]) for _ in range(2)] + [rnd.random(), rnd.random()]
        rows.append((i, "train" if i % 4 else "test", x, int(x[0] != x[1]), int(x[2] > 0.5) if i % 10 else None, int(2 * x[2]) + 2 * int(x[3] > 0.5)))
    df = spark.createDataFrame(rows, "k long, split string, x array<double>, corner int, side int, quarter int")
    return materialize(df.withColumn("features", array_to_vector("x")).drop("x"), "test-training")


TARGETS = [TR.Target("corner", "corner"), TR.Target("side", "side")]


@pytest.fixture(scope="module")
def run(spark, data):
    path = tempfile.mkdtemp(prefix="regtext-m2-")
    net = TR.train_epochs(TR.Network(TARGETS, hidden=6, steps=8), data, "k", path, "007", 4)
    return path, net


def weights(net):
    return {k: m.weights.toArray().tolist() for k, m in net.models.items()}


def test_an_epoch_starts_from_the_weights_of_the_one_before(spark, data, run):
    path, _ = run
    net = TR.Network(TARGETS, hidden=6, steps=8)
    first, second = TR.load_epoch(net, path, "007", 0), TR.load_epoch(net, path, "007", 1)
    train = data.filter("split = 'train'")
    again = TR.fit_epoch(first, train, 4)
    for k, w in weights(second).items():
        assert weights(again)[k] == pytest.approx(w, rel=1e-4, abs=1e-4)
    # where the first epoch stopped is where the second starts: its first objective is the loss at those weights
    still = TR.fit_epoch(first, train, 4, steps=1)
    loss = {r.label: r.bce for r in TR.M.losses(TR.scores(first, train, "k")).collect()}
    for k in weights(first):
        start = still.models[k].summary().objectiveHistory[0]
        assert start == pytest.approx(loss[k], rel=1e-3)
    fresh = TR.fit_epoch(net, train, 4)
    assert any(weights(fresh)[k] != pytest.approx(w, rel=1e-3) for k, w in weights(second).items())


def test_history_holds_every_epoch_and_side(spark, data, run):
    path, _ = run
    h = SINK.read_history(spark, f"{path}/history")
    assert {(r.run_id, r.epoch, r.split) for r in h.collect()} == {("007", e, s) for e in range(4) for s in ("train", "test")}
    assert {(r.label, r.metric) for r in h.filter("epoch = 2 AND split = 'test'").collect()} == \
        {(x, m) for x in ("corner", "side", "micro") for m in ("auc", "threshold", "precision", "recall", "f1")} | \
        {(x, "loss") for x in ("corner", "side", "all")}
    written = {r.epoch: r.value for r in h.filter("metric = 'loss' AND label = 'all' AND split = 'test'").collect()}
    best = A.best_epoch(h).first()
    assert best.best_epoch == min(written, key=lambda e: (written[e], e)) and best.best_loss == min(written.values())
    train = [r.value for r in h.filter("metric = 'loss' AND label = 'all' AND split = 'train'").orderBy("epoch").collect()]
    assert train[-1] < train[0]
    top = {(r.label, r.metric): r.best_value for r in A.best_per_label(h).collect()}
    assert top["corner", "auc"] > 0.95 and top["side", "auc"] > 0.95


def test_history_equals_scores_by_hand(spark, run):
    path, _ = run
    rows = SINK.read_predictions(spark, f"{path}/scores", keep="split string, score double").filter("epoch = 1 AND split = 'test'").collect()
    import math
    cells = [(r.y_true, r.score) for r in rows if r.y_true is not None]
    assert len(rows) == 200 and len(cells) == 190 - sum(1 for r in rows if r.y_true is None) + 10
    loss = sum(-math.log(max(s if y else 1 - s, 1e-300)) for y, s in cells) / len(cells)
    got = SINK.read_history(spark, f"{path}/history").filter("epoch = 1 AND split = 'test' AND metric = 'loss' AND label = 'all'").first().value
    assert got == pytest.approx(loss, rel=1e-6)
    assert all(r.y_pred == int(r.score >= 0.5) for r in rows)


def test_a_repeated_epoch_changes_nothing_else(spark, data, run):
    path, net = run
    before, scored = table(SINK.read_history(spark, f"{path}/history").filter("epoch < 3")), SINK.read_predictions(spark, f"{path}/scores").count()
    TR.train_epochs(TR.Network(TARGETS, hidden=6, steps=8), data, "k", path, "007", 4, start=3)
    h = SINK.read_history(spark, f"{path}/history")
    assert table(h.filter("epoch < 3")) == before
    assert h.groupBy("epoch", "split", "label", "metric").count().filter("count > 1").count() == 0
    assert SINK.read_predictions(spark, f"{path}/scores").count() == scored
    assert weights(TR.load_epoch(net, path, "007", 3)) == {k: pytest.approx(w, rel=1e-4, abs=1e-4) for k, w in weights(net).items()}


def test_writing_an_epoch_twice_leaves_its_rows_once(spark):
    base = tempfile.mkdtemp(prefix="regtext-s9-")
    rows = [("a", e, s, "x", m, float(e)) for e in range(3) for s in ("train", "test") for m in ("loss", "f1")]
    h = spark.createDataFrame(rows, "run_id string, epoch long, split string, label string, metric string, value double")
    SINK.append_history(h, f"{base}/h")
    SINK.append_history(h.filter("epoch = 1 AND split = 'test'").withColumn("value", F.lit(9.0)), f"{base}/h")
    SINK.append_history(h.filter("epoch = 2").withColumn("run_id", F.lit("b")), f"{base}/h")
    want = [r if (r[1], r[2]) != (1, "test") else (*r[:5], 9.0) for r in rows] + [("b", *r[1:]) for r in rows if r[1] == 2]
    assert table(SINK.read_history(spark, f"{base}/h").select(*h.columns)) == sorted(map(repr, want))
    dump = spark.createDataFrame([(i, "x", i % 2, 1) for i in range(5)], "row_id long, label string, y_true int, pred int")
    for epoch in (0, 1, 1):
        SINK.append_predictions(SINK.prediction_dump(dump, "a", epoch), f"{base}/p")
    back = SINK.read_predictions(spark, f"{base}/p")
    assert back.count() == 10 and back.filter("epoch = 1").count() == 5


def test_classes_of_one_column_share_a_network(spark, data):
    t = TR.Target("quarter", "quarter", (0, 1, 2, 3))
    train = data.filter("split = 'train'")
    net = TR.fit_epoch(TR.Network([t], hidden=8, steps=60), train, 4)
    long = TR.scores(net, data.filter("split = 'test'"), "k")
    assert {r.label for r in long.collect()} == {f"quarter_{c}" for c in range(4)}
    assert all(r.s == pytest.approx(1.0) for r in long.groupBy("row_id").agg(F.sum("score").alias("s")).collect())
    assert min(r.auc for r in TR.M.roc_auc(TR.M.cumulative_counts(long)).collect()) > 0.95


def test_halving_finds_the_known_point_in_fewer_steps(spark, data):
    """The corner rule needs a hidden layer of some width: of four points one has it."""
    points = [{"hidden": 1, "step_size": None}, {"hidden": 1, "step_size": 1e-6}, {"hidden": 8, "step_size": 1e-6}, {"hidden": 8, "step_size": None}]
    out = TR.halving_search(data, "k", [TR.Target("corner", "corner")], points, steps=10)
    rows = out.collect()
    assert TR.best_point(out).first().point == 3
    assert [sum(r.round == i for r in rows) for i in range(3)] == [4, 2, 1]
    assert {r.round: r.steps for r in rows} == {0: 10, 1: 20, 2: 40}
    fits = sum(r.steps - (0 if r.round == 0 else r.steps // 2) for r in rows)
    assert fits == 80 < len(points) * 40


def test_no_rows(spark, data):
    with pytest.raises(ValueError, match="no rows"):
        TR.train_epochs(TR.Network(TARGETS), data.filter("k < 0"), "k", tempfile.mkdtemp(prefix="regtext-m2-"), "r", 1)
