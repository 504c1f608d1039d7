"""Incremental note cleaning with Structured Streaming.

The original cleans notes in batch. Cleaning is a per-row projection, so the same column
expressions run unchanged on a file stream: new note files landing in a folder are cleaned and
appended to a Parquet table. Exactly-once output comes from the file sink's commit log under
``checkpointLocation``; a restarted query (or a lost executor) resumes from it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators.cleaning import chain
from ..operators.prep import empty_to_null

def cleaned_stream(stream: DataFrame, key: str, text_col: str, steps: list[str], out_col: str = "cleaned",
                   drop_empty: bool = True) -> DataFrame:
    """Apply the configured cleaning chain (T20) to a streaming DataFrame of notes."""
    out = stream.select(key, chain(text_col, steps).alias(out_col))
    return empty_to_null(out, out_col) if drop_empty else out


def start_note_cleaning(spark: SparkSession, source_dir: str, schema: StructType | str, key: str, text_col: str,
                        steps: list[str], sink_dir: str, checkpoint_dir: str, max_files_per_trigger: int = 100,
                        available_now: bool = False) -> StreamingQuery:
    """Stream Parquet note files from ``source_dir`` through the cleaning chain into ``sink_dir``."""
    src = (spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger)
           .parquet(source_dir))
    out = cleaned_stream(src, key, text_col, steps)
    w = out.writeStream.format("parquet").option("path", sink_dir).option("checkpointLocation", checkpoint_dir) \
        .outputMode("append")
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


def concat_note_stream(lines: DataFrame, keys: list[str], line_col: str, text_col: str, time_col: str,
                       gap: str = "10 minutes", delay: str = "30 minutes", sep: str = "\n",
                       out_col: str = "concat_text") -> DataFrame:
    """A2 on a stream: note lines arriving over time are grouped per note into event-time sessions
    (a note is complete once no line arrived for ``gap``) and concatenated in line order. The
    watermark (``delay``) bounds the state: a session is emitted, in append mode, once the
    watermark passes its end, and its state is dropped."""
    base = lines.filter(F.col(text_col).isNotNull()).withWatermark(time_col, delay)
    parts = F.array_sort(F.collect_list(F.struct(F.col(line_col).alias("k"), F.col(text_col).alias("t"))))
    return (base.groupBy(*keys, F.session_window(F.col(time_col), gap).alias("session"))
            .agg(F.array_join(F.transform(parts, lambda x: x["t"]), sep).alias(out_col))
            .select(*keys, F.col("session.start").alias("session_start"), F.col("session.end").alias("session_end"),
                    out_col))
