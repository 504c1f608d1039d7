"""The streaming cleaner gives the batch result on the same notes."""

import tempfile

from pyspark.sql import functions as F

from regtext.functions import text as X
from regtext.streaming.notes import start_note_cleaning

from .conftest import SF_SMALL


def test_stream_equals_batch(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text")
    base = tempfile.mkdtemp(prefix="regtext-stream-")
    src, sink, ckpt = f"{base}/src", f"{base}/sink", f"{base}/ckpt"
    docs.repartition(3).write.parquet(src)
    q = start_note_cleaning(spark, src, docs.schema, "doc_id", "text", ["history", "nondiagnostic"], sink, ckpt,
                            max_files_per_trigger=1, available_now=True)
    q.awaitTermination(300)
    got = {r.doc_id: r.cleaned for r in spark.read.parquet(sink).collect()}
    want = {r.doc_id: r.c for r in docs.select("doc_id", X.nondiagnostic(X.history_sections("text")).alias("c"))
            .filter(F.col("c") != "").collect()}
    assert got == want


def test_streaming_note_concat_matches_batch(spark):
    from regtext.operators.prep import ordered_concat
    from regtext.streaming.notes import concat_note_stream
    conv = spark.read.parquet(f"{SF_SMALL}/conversations.parquet")
    # lines arrive 10 s apart within a conversation, conversations one hour apart
    timed = conv.withColumn("ts", F.timestamp_seconds(F.col("conv_id") * 3600 + F.col("turn") * 10))
    base = tempfile.mkdtemp(prefix="regtext-stream2-")
    src, sink, ckpt = f"{base}/src", f"{base}/sink", f"{base}/ckpt"
    for lo in (0, 4, 8):  # three files in time order -> three micro-batches
        timed.filter((F.col("conv_id") >= lo) & (F.col("conv_id") < lo + 4)).write.mode("append").parquet(src)
    stream = spark.readStream.schema(timed.schema).option("maxFilesPerTrigger", 1).parquet(src)
    q = (concat_note_stream(stream, ["conv_id"], "turn", "text", "ts").writeStream.format("parquet")
         .option("path", sink).option("checkpointLocation", ckpt).outputMode("append")
         .trigger(availableNow=True).start())
    q.awaitTermination(300)
    got = {r.conv_id: r.concat_text for r in spark.read.parquet(sink).collect()}
    want = {r.conv_id: r.concat_text for r in ordered_concat(conv, ["conv_id"], "turn", "text").collect()}
    assert got, "no session closed"
    assert all(got[k] == want[k] for k in got)
