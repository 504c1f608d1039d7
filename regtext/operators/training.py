"""Two-layer networks trained epoch by epoch, with saved weights, scores and a metric history.

A network is MLlib's multilayer perceptron: features, one hidden layer, one output per class. An epoch is a number
of optimiser steps over the whole training side, started from the weights at which the epoch before stopped. After
every epoch the weights are saved and all sides are scored into a table partitioned by run and epoch, so an epoch
that is repeated replaces its own rows and no others. All epochs are then evaluated in one grouped plan.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml.classification import MultilayerPerceptronClassificationModel, MultilayerPerceptronClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import sinks
from . import metrics as M
from .models import _fit_all, objective

FEATURES = "features"


@dataclass(frozen=True)
class Target:
    """What a network predicts: a 0/1 column (one label, named ``name``), or a column of ``classes`` (a label each)."""
    name: str
    column: str
    classes: tuple = (0, 1)

    @property
    def outputs(self) -> list[tuple[str, int]]:
        """(label, output) of every label."""
        return [(self.name, 1)] if len(self.classes) == 2 else [(f"{self.name}_{c}", i) for i, c in enumerate(self.classes)]

    def index(self):
        """The class number of a row as a double, NULL for a value that is no class."""
        at = F.array_position(F.array(*[F.lit(c) for c in self.classes]), F.col(self.column))
        return F.when(at > 0, (at - 1).cast("double"))


@dataclass
class Network:
    """The settings of a fit and the models of its last epoch, by target."""
    targets: list[Target]
    hidden: int = 32
    steps: int = 10
    step_size: float | None = None   # None: L-BFGS; otherwise gradient descent with this step
    seed: int = 42
    models: dict = field(default_factory=dict)


def width(data: DataFrame) -> int:
    """The number of features, read off one row."""
    row = data.select(F.size(vector_to_array(FEATURES)).alias("n")).first()
    if row is None:
        raise ValueError("no rows to train on")
    return row["n"]


def fit_epoch(net: Network, train: DataFrame, n_features: int, steps: int | None = None) -> Network:
    """One more epoch on ``train(features, target columns)``; every target's network goes on from its own weights."""
    def fit(t: Target):
        rows = train.select(FEATURES, t.index().alias("_y")).filter("_y IS NOT NULL")
        mlp = MultilayerPerceptronClassifier(featuresCol=FEATURES, labelCol="_y", layers=[n_features, net.hidden, len(t.classes)],
                                             maxIter=steps or net.steps, seed=net.seed, tol=0.0)
        if net.step_size is not None:
            mlp.setSolver("gd").setStepSize(net.step_size)
        if t.name in net.models:
            mlp.setInitialWeights(net.models[t.name].weights)
        return mlp.fit(rows)

    fitted = _fit_all(fit, net.targets)
    return Network(net.targets, net.hidden, net.steps, net.step_size, net.seed, {t.name: m for t, m in zip(net.targets, fitted)})


def scores(net: Network, data: DataFrame, key: str, keep: tuple = ()) -> DataFrame:
    """Long ``(keep.., row_id, label, y_true, score)``: every network adds a column, in one pass over ``data``."""
    out, cells = data, []
    for i, t in enumerate(net.targets):
        m = net.models[t.name].copy()
        m.setProbabilityCol(f"_p{i}").setRawPredictionCol("").setPredictionCol("")
        out = m.transform(out).withColumn(f"_p{i}", vector_to_array(f"_p{i}"))
        y = t.index()
        cells += [F.struct(F.lit(label).alias("label"), (y == at).cast("int").alias("y_true"), F.col(f"_p{i}")[at].alias("score"))
                  for label, at in t.outputs]
    return out.select(*keep, F.col(key).alias("row_id"), F.inline(F.array(*cells)))


def _model_path(path: str, run_id: str, epoch: int, target: str) -> str:
    return f"{path.rstrip('/')}/models/run_id={run_id}/epoch={epoch}/{target}"


def save_epoch(net: Network, path: str, run_id: str, epoch: int) -> None:
    for name, m in net.models.items():
        m.write().overwrite().save(_model_path(path, run_id, epoch, name))


def load_epoch(net: Network, path: str, run_id: str, epoch: int) -> Network:
    """``net`` with the weights that ``epoch`` of the run has saved."""
    models = {t.name: MultilayerPerceptronClassificationModel.load(_model_path(path, run_id, epoch, t.name)) for t in net.targets}
    return Network(net.targets, net.hidden, net.steps, net.step_size, net.seed, models)


def train_epochs(net: Network, data: DataFrame, key: str, path: str, run_id: str, epochs: int, start: int = 0,
                 train_split: str = "train") -> Network:
    """M2: epochs ``start`` to ``epochs - 1`` on ``data(key, split, features, target columns)``, a written table.

    Under ``path``: the weights of every epoch, ``scores`` (S7 rows with the score, partitioned by run, epoch and
    split) and ``history`` (S9 rows). With ``start`` above 0 training goes on from the saved weights of the epoch
    before, so a run that was cut short is continued, and an epoch that is trained again replaces its rows."""
    if start:
        net = load_epoch(net, path, run_id, start - 1)
    train = data.filter(F.col("split") == train_split).select(FEATURES, *{t.column for t in net.targets}).persist()
    n_features = width(train)
    for epoch in range(start, epochs):
        net = fit_epoch(net, train, n_features)
        save_epoch(net, path, run_id, epoch)
        long = scores(net, data, key, keep=("split",)).withColumn("pred", F.col("score") >= 0.5)
        sinks.append_predictions(sinks.prediction_dump(long, run_id, epoch, keep=("split", "score")), f"{path}/scores")
    train.unpersist()
    done = sinks.read_predictions(data.sparkSession, f"{path}/scores", keep="split string, score double")
    sinks.append_history(metric_history(done.filter((F.col("run_id") == run_id) & (F.col("epoch") >= start))), f"{path}/history")
    return net


def metric_history(scored: DataFrame, auc: str = "roc", average: str = "micro") -> DataFrame:
    """S9 rows ``(run_id, epoch, split, label, metric, value)`` of all epochs of ``scored``, in one grouped plan: the
    mean loss (label ``all`` and every label) and the report of M11."""
    by = ("run_id", "epoch", "split")
    report = M.evaluation_report(scored, auc, average, by=by).unpivot([*by, "label"], ["auc", "threshold", "precision", "recall", "f1"],
                                                                      "metric", "value")
    loss = M.losses(scored, by=by).select(*by, "label", F.lit("loss").alias("metric"), F.col("bce").alias("value"))
    return report.unionByName(loss)


def halving_search(data: DataFrame, key: str, targets: list[Target], points: list[dict], steps: int = 5, factor: int = 2,
                   train_split: str = "train", held_split: str = "test", seed: int = 42) -> DataFrame:
    """M13 by successive halving: every point ``{hidden, step_size}`` trains ``steps`` optimiser steps; the best
    ``1 / factor`` of them by the original's objective on the held-out side go on from their own weights for
    ``factor`` times as many steps as before, until one is left -> ``(round, point, hidden, step_size, steps, objective, kept)``.

    ``steps`` counts all steps of the point so far. The driver holds the points and the networks' weights."""
    train = data.filter(F.col("split") == train_split).select(FEATURES, *{t.column for t in targets}).persist()
    held = data.filter(F.col("split") == held_split).persist()
    n_features = width(train)
    alive = [(i, Network(targets, p["hidden"], steps, p.get("step_size"), seed)) for i, p in enumerate(points)]
    rows, done, more, round_ = [], 0, steps, 0
    while alive:
        alive = [(i, fit_epoch(net, train, n_features, more)) for i, net in alive]
        done += more
        tried = sorted((objective(scores(net, held, key)), i) for i, net in alive)
        kept = {i for _, i in tried[:max(len(tried) // factor, 1)]}
        rows += [(round_, i, points[i]["hidden"], points[i].get("step_size"), done, value, i in kept) for value, i in tried]
        if len(alive) == 1:
            break
        alive = [(i, net) for i, net in alive if i in kept]
        more, round_ = done * (factor - 1), round_ + 1
    train.unpersist()
    held.unpersist()
    return data.sparkSession.createDataFrame(rows, "round int, point int, hidden int, step_size double, steps int, objective double, kept boolean")


def best_point(search: DataFrame) -> DataFrame:
    """The point that the last round kept."""
    last = search.agg(F.max("round").alias("round"))
    return search.join(last, "round").filter("kept").drop("kept")
