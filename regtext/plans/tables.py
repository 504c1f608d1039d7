"""Driver tables and data derived from them, shared by the registered queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]

# deterministic stand-in model scores: one multiplier per label (fixed values of the test design)
SCORE_MULTIPLIERS = {"quality": 7919, "toxic": 104729}


# tables whose per-row work (regexes over whole texts) is CPU-heavy
CPU_HEAVY = {"documents"}
SPREAD_TASKS_PER_CORE = 2


def spread(df: DataFrame) -> DataFrame:
    """Round-robin a scan that yields fewer partitions than the cluster has cores (a file with
    one row group is read by one task). On large inputs the scan already has enough splits and
    nothing is added."""
    sc = df.sparkSession.sparkContext
    if df.rdd.getNumPartitions() < sc.defaultParallelism:
        # a few tasks per core even out documents of very different lengths
        return df.repartition(sc.defaultParallelism * SPREAD_TASKS_PER_CORE)
    return df


def table(spark: SparkSession, sf_dir: str, name: str, heavy: bool = True) -> DataFrame:
    """Scan one driver table; ``heavy=False`` for queries that read only keys and numbers."""
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    return spread(df) if heavy and name in CPU_HEAVY else df


def r6(c) -> Column:
    """Round a double for presentation/comparison (6 decimals)."""
    return F.round((F.col(c) if isinstance(c, str) else c).cast("double"), 6)


def score_expr(key: str, mult: int, epoch: int | Column = 0) -> Column:
    e = epoch if isinstance(epoch, Column) else F.lit(epoch)
    return (F.pmod(F.col(key) * F.lit(mult) + e * F.lit(37), F.lit(1000)) / F.lit(1000.0)).cast("double")


def scored_long(spark: SparkSession, sf_dir: str, epoch: int | Column = 0) -> DataFrame:
    """Long evaluation table ``(row_id, label, y_true, score)`` from ``labels`` and the stand-in scores."""
    lab = table(spark, sf_dir, "labels")
    st = F.array(*[F.struct(F.lit(l).alias("label"), F.col(l).cast("int").alias("y_true"),
                            score_expr("doc_id", m, epoch).alias("score")) for l, m in SCORE_MULTIPLIERS.items()])
    return lab.select(F.col("doc_id").alias("row_id"), F.inline(st))


def measurement_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = spread(table(spark, sf_dir, "lineitem"))
    return li.select("l_orderkey", "l_linenumber",
                     F.concat(F.lit("EF "), F.col("l_quantity").cast("string"), F.lit(" cm on "),
                              F.date_format("l_shipdate", "yyyy-MM-dd"), F.lit(", gave "),
                              F.col("l_linenumber").cast("string"), F.lit(" mg and 3 stents")).alias("text"))


def time_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = spread(table(spark, sf_dir, "events"))
    return ev.select("event_id", F.concat(F.col("event_type"), F.lit(" seen in "), F.date_format("ts", "MMMM"),
                                          F.lit(" on "), F.date_format("ts", "dd/MM/yyyy"), F.lit(" at "),
                                          F.date_format("ts", "HH:mm"), F.lit(" pm, Mayo examined")).alias("text"))


def sectioned_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``HEADER: body`` reports built from document columns (the driver texts have no headers)."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.concat(F.lit("DATE: "), F.col("source"), F.lit(" LANGUAGE: "), F.col("lang"),
                                       F.lit(" NOTE: "), F.col("text"), F.lit(" SURGEON: "), F.col("source"),
                                       F.lit(" FINDINGS: "), F.col("n_chars").cast("string")).alias("text"))


def procedure_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports with several procedure starts, with secondary starts only, and with a span that no mark ends."""
    d = table(spark, sf_dir, "documents")
    several = F.concat(F.lit("Indication: "), F.col("lang"), F.lit(" PROCEDURE: "), F.col("text"),
                       F.lit(" FINDINGS: ok ** Operative Report: "), F.col("source"), F.lit(" DISPOSITION: home"))
    secondary = F.concat(F.lit("Name of Operation: "), F.col("text"), F.lit(" #: Procedure type: "), F.col("source"))
    return d.select("doc_id", F.when(F.col("lang") == "de", secondary).otherwise(several).alias("text"))


def history_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    t = F.when(F.col("lang") == "en", F.concat(F.lit("Reason for visit. Past Medical History: "), F.col("text")))\
        .otherwise(F.col("text"))
    return d.select("doc_id", t.alias("text"))
