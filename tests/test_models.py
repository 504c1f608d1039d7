"""MLlib helpers and the t quantiles."""

import pytest
from pyspark.sql import functions as F

from regtext.functions import tdist
from regtext.operators import models as ML


def test_power_of_two_grid():
    assert ML.power_of_two_grid(3, 20) == [4, 8, 16]
    with pytest.raises(ValueError):
        ML.power_of_two_grid(10, 15)


@pytest.mark.parametrize("dof,want", [(1, 12.706205), (2, 4.302653), (10, 2.228139), (30, 2.042272), (400, 1.965912)])
def test_t_table(dof, want):
    assert tdist.t_table(0.95)[dof - 1] == pytest.approx(want, abs=1e-6)


def test_t_expansion_beyond_table(spark):
    df = spark.createDataFrame([(1000,), (401,), (0,)], "d int")
    got = [r.t for r in df.select(tdist.t_critical(F.col("d")).alias("t")).collect()]
    assert got[0] == pytest.approx(1.962339, abs=1e-6)
    assert got[1] == pytest.approx(tdist.t_ppf(0.975, 401), abs=1e-9)
    assert got[2] is None


def test_names_above(spark):
    df = spark.createDataFrame([(1, 0.7, 0.2), (2, 0.1, 0.5), (3, 0.9, 0.9), (4, None, 0.1)], "k long, b double, a double")
    got = {r.k: r.n for r in df.select("k", ML.names_above(["b", "a"], [F.col("b"), F.col("a")]).alias("n")).collect()}
    assert got == {1: ["b"], 2: ["a"], 3: ["a", "b"], 4: []}


def test_scores_take_one_pass(spark):
    rows = [(i, "good note " if i % 2 else "bad text ", i % 2, 1 - i % 2) for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, y int, z int")
    models = ML.text_classifier(df, "doc_id", "text", ["y", "z"], num_features=1 << 8, max_iter=10)
    out = ML.score(models, df, "doc_id", {"y": "y", "z": "z"})
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert out.count() == 60 and "Union" not in plan
    names = {r.row_id: r.predicted for r in ML.predicted_names(models, df, "doc_id").collect()}
    assert names == {i: ["y"] if i % 2 else ["z"] for i in range(30)}
    assert "Exchange" not in ML.predicted_names(models, df, "doc_id")._jdf.queryExecution().executedPlan().toString()


def test_embedding_classes_are_read_from_the_column(spark):
    rows = [(i, [float(i % 3 == c) for c in range(3)], 10 * (i % 3)) for i in range(30)]
    df = spark.createDataFrame(rows, "k long, e array<double>, c int")
    assert list(ML.embedding_classifier(df, "k", "e", "c", max_iter=5).classifiers) == [0, 10, 20]


def test_search_grid_and_random(spark):
    rows = [(i, ("good clear " if i % 2 else "bad noisy ") * 2, i % 2) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, y int")
    grid = ML.search(df, "doc_id", "text", ["y"], [0.01, 10.0], [5], num_features=1 << 8)
    assert [g[:2] for g in grid] == [(0.01, 5), (10.0, 5)] and grid[0][2] < grid[1][2]
    drawn = ML.search(df, "doc_id", "text", ["y"], [0.01, 1.0], [2, 6], num_features=1 << 8, n_random=2)
    assert len(drawn) == 2 and all(0.01 <= r <= 1.0 and 2 <= n <= 6 for r, n, _ in drawn)


def test_text_classifier_and_scoring_roundtrip(spark, tmp_path):
    rows = [(i, ("good clear note " if i % 2 else "bad noisy text ") * 3, i % 2) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, y int")
    models = ML.text_classifier(df, "doc_id", "text", ["y"], num_features=1 << 10, max_iter=20)
    ML.save_models(models, str(tmp_path))
    loaded = ML.load_models(str(tmp_path), ["y"])
    scored = {r.row_id: r.score for r in ML.score(loaded, df, "doc_id", {"y": "y"}).collect()}
    assert all((scored[i] >= 0.5) == bool(i % 2) for i in range(40))
