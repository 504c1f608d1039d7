"""Result sinks (S5-S9). Every writer is a plain DataFrameWriter call on a distributed table; tables by epoch are
written by dynamic partition overwrite, so writing an epoch twice leaves it once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_split(df: DataFrame, path: str, split_col: str = "split", fmt: str = "parquet",
                mode: str = "overwrite") -> None:
    """Write a split-tagged table partitioned by split (held-out part = one folder)."""
    df.write.mode(mode).partitionBy(split_col).format(fmt).save(path)


def results_table(metrics_long: DataFrame, prefix: str = "valid_", metrics: list[str] | None = None) -> DataFrame:
    """Long (label, metric, value) -> one row per label, one column per metric. Giving the
    metric names saves the job that would look up the distinct values."""
    piv = metrics_long.groupBy("label").pivot("metric", metrics).agg(F.first("value"))
    return piv.select("label", *[F.col(c).alias(prefix + c) for c in piv.columns if c != "label"])


def write_results(table: DataFrame, path: str, note_type: str, job_id: str | None = None) -> str:
    """CSV per note type; the job id (if any) becomes part of the folder name."""
    out = f"{path.rstrip('/')}/result_{note_type}" + (f"_{job_id}" if job_id else "")
    table.write.mode("overwrite").option("header", "true").csv(out)
    return out


def _write_epochs(df: DataFrame, path: str) -> None:
    """Replace the partitions (run, epoch and, if there is one, split) that ``df`` has rows of, and no others: an
    epoch that is written again, by a rerun or after a failure, stands once."""
    parts = [c for c in ("run_id", "epoch", "split") if c in df.columns]
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(path)


def prediction_dump(pred_long: DataFrame, run_id: str, epoch: int, keep: tuple = ()) -> DataFrame:
    """(run_id, epoch, row_id, label, y_true, y_pred) rows for one epoch, with the columns ``keep``."""
    return pred_long.select(F.lit(run_id).alias("run_id"), F.lit(epoch).cast("bigint").alias("epoch"),
                            "row_id", "label", F.col("y_true").cast("int"), F.col("pred").cast("int").alias("y_pred"), *keep)


def append_predictions(dump: DataFrame, path: str) -> None:
    """Add the dump's epochs to the table at ``path``, in place of what it holds for them."""
    _write_epochs(dump, path)


def read_predictions(spark: SparkSession, path: str, key_type: str = "bigint", keep: str = "") -> DataFrame:
    """The dump at ``path``; ``keep`` declares its further columns. The types are given: a run named by digits stays text."""
    more = f", {keep}" if keep else ""
    return spark.read.schema(f"run_id string, epoch bigint, row_id {key_type}, label string, y_true int, y_pred int{more}").parquet(path)


def write_frequencies(freq: DataFrame, path: str, **name_parts) -> str:
    """Frequency table as JSON lines; keyword arguments are encoded in the folder name."""
    suffix = "".join(f"_{k}_{v}" for k, v in name_parts.items())
    out = f"{path}{suffix}.json"
    freq.write.mode("overwrite").json(out)
    return out


def append_history(history: DataFrame, path: str) -> None:
    """Add (run_id, epoch, split, label, metric, value) rows to the table at ``path``, partitioned by run, epoch and
    split, in place of what it holds for these."""
    _write_epochs(history.select("run_id", "epoch", "split", "label", "metric", "value"), path)


def read_history(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("run_id string, epoch bigint, split string, label string, metric string, value double").parquet(path)
