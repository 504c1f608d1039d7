"""Operator 13, exact dedup by content sort (DataFrame functions only).

Texts are normalised (A-Z lower-cased) and range-partitioned by their bytes: the sort key is the leading
``PREFIX`` characters, then a 64-bit hash of the whole text, so that neither the splitters that Spark samples nor
the driver ever hold a whole text, and texts that share a long opening still spread. Every partition is then
sorted externally by that key and by the whole text. Equal texts are neighbours in that order; the window over
``(key, text)`` opens a new group wherever the whole text differs from the row before it, so hashes only order
rows and never decide that two texts are equal. The texts are moved once.

Hot texts: copies of one text that would fill more than an even share of a partition are dealt over several
neighbouring ranges by a hash of their row (the salt is the last part of the sort key). Fewer than
``spark.sql.shuffle.partitions`` texts can be that heavy, so the table of their hashes is bounded and broadcast.
Each range sorts and compares its copies; what is left, one row per range with its best key and its number of
copies, is compared by whole text again and summed. No task gathers a hot group.

Defined cases: a NULL text counts as empty, so NULL and empty texts are copies of each other; rows equal in key
and text are copies too, one of them stays (of rows with that key, the one with the smallest hash of all its
columns); a NULL key stays only if no copy has a key; an empty table gives an empty result; extra columns are ignored
(``keep_one`` passes them on), whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import materialize
from .common import or_empty

PREFIX = 24  # leading characters of the sort key
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalised(text: Column) -> Column:
    """The text with A-Z lower-cased and nothing else changed. ``lower`` does that for ASCII texts, at a
    fraction of the cost of a character map."""
    t = or_empty(text)
    return F.when(F.octet_length(t) == F.length(t), F.lower(t)).otherwise(F.translate(t, UPPER, LOWER))


def _heavy(keyed: DataFrame, parts: int) -> DataFrame:
    """``(h, salts)`` of the text hashes whose copies hold more than an even share of all bytes: fewer than ``parts``."""
    size = F.octet_length("t").cast("long") + 64
    counts = keyed.select("h", size.alias("size")).groupBy("h").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    # texts that occur once only count towards the total, in the row without a hash
    counts = counts.select(F.when(F.col("n") > 1, F.col("h")).alias("h"), "bytes").groupBy("h").agg(F.sum("bytes").alias("bytes"))
    counts = materialize(counts, "text-hashes")
    share = max((counts.agg(F.sum("bytes")).first()[0] or 0) / parts, 1.0)
    counts = counts.filter("h IS NOT NULL")
    return counts.filter(F.col("bytes") > share).select("h", F.ceil(F.col("bytes") / share).cast("int").alias("salts"))


def content_sort(docs: DataFrame, key: str = "doc_id", text: str = "text", keep: str = "smallest",
                 carry: bool = False) -> DataFrame:
    """``(id, keep_id, n, kept, sha)`` for every row, with ``carry`` also the whole row as ``row``."""
    if keep not in ("smallest", "largest"):
        raise ValueError("keep must be 'smallest' or 'largest'")
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    own = [F.struct(*columns).alias("row")] if carry else []
    base = docs.select(F.col(f"`{key}`").alias("id"), *own, F.xxhash64(*columns).alias("tie") if carry else F.lit(0).alias("tie"),
                       normalised(F.col(f"`{text}`")).alias("t"))
    keyed = base.withColumn("head", F.substring("t", 1, PREFIX)).withColumn("h", F.xxhash64("t"))
    heavy = _heavy(keyed, parts)
    salt = F.when(F.col("salts").isNull(), 0).otherwise(F.pmod(F.xxhash64("id", "tie"), F.col("salts")).cast("int"))
    dealt = keyed.join(F.broadcast(heavy), "h", "left").withColumn("salt", salt) \
        .withColumn("split", F.col("salts").isNotNull()).drop("salts").repartitionByRange("head", "h", "salt")

    best_first = F.col("id").asc_nulls_last() if keep == "smallest" else F.col("id").desc_nulls_last()
    order = W.partitionBy("head", "h", "salt", "t").orderBy(best_first, "tie")
    whole = order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    rest = ["id", *(["row"] if carry else [])]
    runs = dealt.select(*rest, "t", "salt", "split", F.row_number().over(order).alias("rank"),
                        F.first("id").over(whole).alias("best"), F.count("*").over(whole).alias("n"))
    runs = runs.select(*rest, "salt", "split", "best", "n", (F.col("rank") == 1).alias("first"), F.sha2("t", 256).alias("sha"),
                       F.when(F.col("split") & (F.col("rank") == 1), F.col("t")).alias("t"))
    if heavy.isEmpty():
        return runs.select(*rest, F.col("best").alias("keep_id"), "n", F.col("first").alias("kept"), "sha")

    # the ranges of a heavy text, a row each: whole texts compared, best key and count over all ranges
    runs = materialize(runs, "content-runs")
    missing = F.col("best").isNull() if keep == "smallest" else F.col("best").isNotNull()
    pick = F.min if keep == "smallest" else F.max
    merged = runs.filter("split AND first").groupBy("t", "sha").agg(
        pick(F.struct(missing.alias("missing"), "best", "salt")).alias("win"), F.sum("n").alias("total")).drop("t")
    both = runs.drop("t").join(F.broadcast(merged), "sha", "left")
    return both.select(*rest, F.when(F.col("split"), F.col("win.best")).otherwise(F.col("best")).alias("keep_id"),
                       F.when(F.col("split"), F.col("total")).otherwise(F.col("n")).alias("n"),
                       (F.col("first") & (~F.col("split") | (F.col("salt") == F.col("win.salt")))).alias("kept"), "sha")


def exact_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", keep: str = "smallest") -> DataFrame:
    """One row per document: ``key``, ``keep_id`` (key of the copy that stays: the smallest or the largest),
    ``group_size``, ``kept``, ``text_sha256`` (of the normalised text)."""
    return content_sort(docs, key, text, keep).select(F.col("id").alias(key), "keep_id", F.col("n").alias("group_size"), "kept",
                                                      F.col("sha").alias("text_sha256"))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", keep: str = "smallest") -> DataFrame:
    """One row of every group of equal texts, all columns unchanged."""
    return content_sort(docs, key, text, keep, carry=True).filter("kept").select("row.*")
