"""Sinks write distributed tables that read back whole."""

import tempfile

from pyspark.sql import functions as F

from regtext.operators import metrics as M
from regtext.operators import split as R
from regtext.plans.tables import scored_long, table
from regtext.sources import notes as SRC
from regtext.sources import sinks as SINK

from .conftest import SF_SMALL


def test_split_export_partitioned(spark):
    d = R.random_split(table(spark, SF_SMALL, "documents").select("doc_id"), "doc_id")
    out = tempfile.mkdtemp(prefix="regtext-s5-")
    SINK.write_split(d, out)
    back = spark.read.parquet(out)
    assert back.count() == d.count()
    assert {r.split for r in back.select("split").distinct().collect()} == {"train", "validation", "test"}
    assert spark.read.parquet(f"{out}/split=test").count() == d.filter("split = 'test'").count()


def test_results_csv_and_history_append(spark):
    long = scored_long(spark, SF_SMALL)
    rep = M.evaluation_report(long)
    t = SINK.results_table(rep.unpivot(["label"], ["auc", "precision", "recall", "f1"], "metric", "value"))
    base = tempfile.mkdtemp(prefix="regtext-s6-")
    path = SINK.write_results(t, base, "discharge", job_id="42")
    assert path.endswith("result_discharge_42")
    assert spark.read.option("header", "true").csv(path).count() == t.count()
    hist = rep.unpivot(["label"], ["auc", "f1"], "metric", "value").select(
        F.lit("r1").alias("run_id"), F.lit(0).cast("bigint").alias("epoch"), F.lit("test").alias("split"),
        "label", "metric", "value")
    SINK.append_history(hist, f"{base}/hist")
    SINK.append_history(hist.withColumn("epoch", F.lit(1).cast("bigint")), f"{base}/hist")
    assert spark.read.parquet(f"{base}/hist").count() == 2 * hist.count()


def test_prediction_dump_and_frequencies(spark):
    long = scored_long(spark, SF_SMALL)
    thr = M.optimal_thresholds(M.pr_curve(M.cumulative_counts(long)))
    dump = SINK.prediction_dump(M.tuned_predictions(long, thr), "run0", 3)
    base = tempfile.mkdtemp(prefix="regtext-s7-")
    SINK.append_predictions(dump, f"{base}/pred")
    assert spark.read.parquet(f"{base}/pred").filter("epoch = 3").count() == long.count()
    freq = table(spark, SF_SMALL, "labels").groupBy("quality").count()
    p = SINK.write_frequencies(freq, f"{base}/freq", max_words=100)
    assert p.endswith("freq_max_words_100.json") and spark.read.json(p).count() == freq.count()


def test_tolerant_csv_registry(spark):
    base = tempfile.mkdtemp(prefix="regtext-s3-")
    with open(f"{base}/reg.csv", "w") as f:
        f.write("PAT_MRN_ID,Surg_Dt,SP_x\n1,2020-01-01,1\n2,2020-01-02,oops\n")
    df = SRC.read_table(spark, f"{base}/reg.csv", "csv", "PAT_MRN_ID string, Surg_Dt date, SP_x int", tolerant=True)
    assert [r.SP_x for r in df.orderBy("PAT_MRN_ID").collect()] == [1, None]
