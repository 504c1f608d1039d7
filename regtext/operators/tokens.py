"""Token sequences and label matrices (K1-K4).

Ids: UNK 0, PAD 1, START 2, END 3 (parameters), vocabulary from 4. A corpus vocabulary replaces
the pretrained sub-word tokenizer of the original.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from ..functions import constants as K
from ..functions.text import let, unicode_words
from ..session import materialize as materialize_table
from .ranking import global_offsets


def build_vocabulary(docs: DataFrame, text_col: str, min_count: int = 1, rows_per_range: int = 1_000_000) -> DataFrame:
    """(token, n, token_id): every word with ``min_count`` occurrences or more, ids from 4 by falling
    count, ties by token. Ids come from a two-level rank over ranges of (count, token): no task and no
    window holds the whole vocabulary."""
    freq = docs.select(F.explode_outer(unicode_words(text_col)).alias("token")).filter(F.col("token").isNotNull()) \
        .groupBy("token").agg(F.count(F.lit(1)).cast("bigint").alias("n")).filter(F.col("n") >= min_count)
    counted = materialize_table(freq.select("token", "n", (-F.col("n")).alias("_o"), F.lit(1).cast("bigint").alias("_one")), "vocabulary")
    ranked, _ = global_offsets(counted, ["_o", "token"], "_one", rows_per_range, out_col="_rank")
    return ranked.select("token", "n", (F.col("_rank") + F.lit(K.FIRST_VOCAB_ID)).cast("int").alias("token_id"))


ROWS_PER_BATCH = 256     # rows that look their words up together
SHORT_ROWS_PER_BATCH = 1024  # the same where rows are cut to a sequence's length
LONG_ROW = 20_000        # words; a longer row is a batch of its own
IDS_PER_RANGE = 16_000_000


def to_ids(docs: DataFrame, key: str, words: Column, vocab: DataFrame, out_col: str = "ids", rows_per_batch: int = ROWS_PER_BATCH) -> DataFrame:
    """(key, ids): the words of every row as vocabulary ids, in order; unknown words are UNK.

    Neighbouring rows are batched and written once with their words. Each batch sends its distinct words through one
    join with the vocabulary (a common word once a batch, not once an occurrence; how it is joined is left to the optimiser)
    and meets what comes back in a cogroup, where Arrow looks all its words up at once. A task holds one batch."""
    row = F.monotonically_increasing_id()
    rows = docs.select(F.col(key), words.alias("_w"), row.alias("_row"))
    rows = rows.select(F.when(F.size("_w") > LONG_ROW, -1 - F.col("_row")).otherwise(F.col("_row") - F.col("_row") % rows_per_batch).alias("_b"), key, "_w")
    rows = materialize_table(rows, "batched-words")
    used = rows.select("_b", F.explode(F.array_distinct("_w")).alias("token")).distinct()
    found = used.join(vocab.select("token", "token_id"), "token").select(F.col("_b").alias("_kb"), "token", "token_id")
    out = StructType([StructField("_k", rows.schema[key].dataType), StructField("ids", ArrayType(IntegerType()))])

    def look_up(batch, known):
        lists = batch.column("_w").combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        flat = lists.flatten()
        at = pc.index_in(flat, value_set=known.column("token").combine_chunks().cast(flat.type))
        ids = pc.fill_null(pc.take(known.column("token_id").combine_chunks(), at), K.UNK_ID)
        ids = ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids
        sizes = np.asarray(pc.fill_null(pc.list_value_length(lists), 0))
        offsets = pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32())
        return pa.table({"_k": batch.column(key), "ids": pa.ListArray.from_arrays(offsets, ids.cast(pa.int32()))})

    looked = rows.groupBy("_b").cogroup(found.groupBy("_kb")).applyInArrow(look_up, out)
    return looked.select(F.col("_k").alias(key), F.col("ids").alias(out_col))


def encode(docs: DataFrame, key: str, text_col: str, vocab: DataFrame, max_len: int = K.MAX_SEQ_LEN) -> DataFrame:
    """K1: (key, input_ids, attention_mask): START + first ``max_len - 2`` word ids + END, padded.

    Words are truncated *before* they are exploded: a document gives the join at most ``max_len`` rows."""
    ids = to_ids(docs, key, unicode_words(text_col, max_len - 2), vocab, "_w")
    out = ids.select(key, F.concat(F.array(F.lit(K.START_ID)), F.col("_w"), F.array(F.lit(K.END_ID))).alias("_ids"))
    return pad(out, "_ids", max_len).drop("_ids")


def encode_sentences(docs: DataFrame, key: str, sentences_col: str, vocab: DataFrame, max_len: int = K.MAX_SEQ_LEN) -> DataFrame:
    """K1 + K2 over sentence word lists: (key, input_ids, attention_mask) of START, the word ids of every
    sentence with END behind each, cut or padded to ``max_len`` by ``flatten_ids``.

    As in ``encode``, words are cut *before* they are looked up: behind START the result holds ``max_len - 1`` ids at
    most, and that there are ``max_len`` of them is all it needs to know of the rest (no word's id is START)."""
    ended = F.slice(F.flatten(F.transform(sentences_col, lambda ws: F.array_append(ws, F.lit(SENTENCE_END)))), 1, max_len)
    ids = to_ids(docs, key, ended, vocab.unionByName(_end_marker(docs.sparkSession, vocab)), "_w", SHORT_ROWS_PER_BATCH)
    one = F.array(F.concat(F.array(F.lit(K.START_ID)), F.col("_w")))
    return ids.select(key, flatten_ids(one, max_len).alias("t")).select(key, "t.input_ids", "t.attention_mask")


# no corpus word holds a blank, so the marker of a sentence's end cannot be one
SENTENCE_END = " end "


def _end_marker(spark, vocab: DataFrame) -> DataFrame:
    return spark.range(1).select(F.lit(SENTENCE_END).alias("token"), F.lit(0).cast("bigint").alias("n"),
                                 F.lit(K.END_ID).cast("int").alias("token_id"))


def pad(df: DataFrame, ids_col: str, max_len: int, pad_id: int = K.PAD_ID) -> DataFrame:
    n = F.size(F.col(ids_col))
    fill = F.greatest(F.lit(max_len) - n, F.lit(0))
    return df.withColumn("input_ids", F.concat(F.col(ids_col), F.array_repeat(F.lit(pad_id), fill))) \
             .withColumn("attention_mask", F.concat(F.array_repeat(F.lit(1), n), F.array_repeat(F.lit(0), fill)))


def flatten_ids(nested: Column, max_len: int = K.MAX_SEQ_LEN, start_id: int = K.START_ID, end_id: int = K.END_ID,
                pad_id: int = K.PAD_ID) -> Column:
    """K2: flatten per-sentence id lists, drop every START but the first, then either cut to
    ``max_len - 1`` ids + END, or pad with ``pad_id`` (mask 0). Returns struct(input_ids, attention_mask)."""
    def shape(kept):
        n = F.size(kept)
        cut = F.concat(F.slice(kept, 1, max_len - 1), F.array(F.lit(end_id)))
        fill = F.greatest(F.lit(max_len) - n, F.lit(0))
        ids = F.when(n >= max_len, cut).otherwise(F.concat(kept, F.array_repeat(F.lit(pad_id), fill)))
        mask = F.when(n >= max_len, F.array_repeat(F.lit(1), F.lit(max_len))) \
            .otherwise(F.concat(F.array_repeat(F.lit(1), n), F.array_repeat(F.lit(0), fill)))
        return F.struct(ids.alias("input_ids"), mask.alias("attention_mask"))

    kept = F.filter(F.flatten(nested), lambda x, i: (i == 0) | (x != F.lit(start_id)))
    return let(kept, shape)  # the filtered list is read four times; computed once


def pack_blocks(docs: DataFrame, key: str, ids_col: str, block: int = K.MAX_SEQ_LEN,
                rows_per_range: int = 1_000_000) -> DataFrame:
    """K3: concatenate all id sequences in ``key`` order and cut into ``block``-long blocks; the
    remainder is dropped; ``labels`` = ``input_ids``. Rows that share a key follow each other in the
    order of a hash of their ids.

    The id table is written once under the shared checkpoint folder (lineage cut). Each row gets its
    global start offset from a two-level prefix sum (``global_offsets``), cuts its ids into the slices
    of the blocks it overlaps inside one projection, and blocks are assembled by grouping on the
    block id: a block never holds more than ``block`` ids, whatever the corpus size.
    """
    ids = docs.select(key, ids_col, F.size(ids_col).cast("bigint").alias("_len"), F.xxhash64(ids_col).alias("_tie"))
    ids = materialize_table(ids, "k3-ids")
    # filtered after the lineage cut, so the id expression is not copied into a pushed-down filter
    ids = ids.filter(F.col("_len") > 0)
    # a range is held by one task with its ids: as many rows as have IDS_PER_RANGE of them
    size = ids.agg(F.count(F.lit(1)).alias("n"), F.sum("_len").alias("ids")).first()
    rows_per_range = max(min(rows_per_range, size["n"] * IDS_PER_RANGE // max(size["ids"] or 0, 1)), 1)
    off, total = global_offsets(ids, [key, "_tie"], "_len", rows_per_range, out_col="_off")
    n_blocks = total // block
    if n_blocks == 0:
        return docs.sparkSession.createDataFrame([], "block_id bigint, input_ids array<int>, labels array<int>")
    first = F.floor(F.col("_off") / F.lit(block)).cast("bigint")
    last = F.least(F.floor((F.col("_off") + F.col("_len") - 1) / F.lit(block)), F.lit(n_blocks - 1)).cast("bigint")

    def piece(b):
        lo = F.greatest(b * F.lit(block) - F.col("_off"), F.lit(0))
        hi = F.least((b + 1) * F.lit(block) - F.col("_off"), F.col("_len"))
        return F.struct(b.alias("block_id"), F.slice(F.col(ids_col), (lo + 1).cast("int"), (hi - lo).cast("int")).alias("p"))

    pieces = off.filter(first < F.lit(n_blocks)).select(
        "_off", F.inline_outer(F.transform(F.sequence(first, last), piece))).filter(F.col("block_id").isNotNull())
    blocks = pieces.groupBy("block_id").agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(F.col("_off").alias("k"), F.col("p").alias("p")))),
                              lambda x: x["p"])).alias("input_ids"))
    return blocks.withColumn("labels", F.col("input_ids"))


def label_matrix(df: DataFrame, key: str, labels: list[str]) -> tuple[DataFrame, dict, dict]:
    """K4: labels sorted by name -> (key, labels ARRAY<INT>), plus id->label and label->id maps."""
    names = sorted(labels)
    out = df.select(key, F.array(*[F.col(c).cast("int") for c in names]).alias("labels"))
    return out, {i: n for i, n in enumerate(names)}, {n: i for i, n in enumerate(names)}
