"""Properties on the driver tables (sf0.001)."""

import math

from pyspark.sql import functions as F

from regtext.functions import text as X
from regtext.operators import prep as P
from regtext.operators import split as R
from regtext.operators import tokens as TK
from regtext.plans.tables import table

from .conftest import SF_SMALL


def test_split_partitions_keys_with_exact_sizes(spark):
    d = table(spark, SF_SMALL, "documents").select("doc_id")
    n = d.count()
    out = R.random_split(d, "doc_id").cache()
    sizes = {r.split: r.c for r in out.groupBy("split").agg(F.count("*").alias("c")).collect()}
    assert sizes["train"] == math.floor(0.8 * n)
    assert sizes["train"] + sizes["validation"] == math.floor(0.9 * n)
    assert out.select("doc_id").distinct().count() == n
    again = {r.doc_id: r.split for r in R.random_split(d, "doc_id").collect()}
    assert again == {r.doc_id: r.split for r in out.collect()}


def test_group_split_keeps_groups_together(spark):
    c = table(spark, SF_SMALL, "conversations")
    out = R.random_split(c, "turn", group_key="conv_id")
    assert out.groupBy("conv_id").agg(F.countDistinct("split").alias("k")).filter("k > 1").count() == 0


def test_concat_preserves_lines(spark):
    c = table(spark, SF_SMALL, "conversations")
    out = P.ordered_concat(c, ["conv_id"], "turn", "text", chunk_lines=2)
    n_lines = out.select(F.sum(F.size(F.split("concat_text", "\n"))).alias("n")).collect()[0].n
    expected = c.select(F.sum(F.size(F.split("text", "\n"))).alias("n")).collect()[0].n
    assert n_lines == expected


def test_blocks_full_length(spark):
    d = table(spark, SF_SMALL, "documents")
    ids = TK.to_ids(d, "doc_id", X.unicode_words("text"), TK.build_vocabulary(d, "text"))
    blocks = TK.pack_blocks(ids, "doc_id", "ids", 512)
    total = ids.select(F.sum(F.size("ids"))).collect()[0][0]
    lens = [r.n for r in blocks.select(F.size("input_ids").alias("n")).collect()]
    assert len(lens) == total // 512 and set(lens) == {512}


def test_cleaning_idempotent(spark):
    d = table(spark, SF_SMALL, "documents")
    once = d.select(X.clean_report("text").alias("a"))
    assert once.filter(X.clean_report("a") != F.col("a")).count() == 0
    p = d.select(F.array_join(X.strip_punctuation(X.sentences("text")), "\n").alias("a"))
    assert p.filter(F.array_join(X.strip_punctuation(F.split("a", "\n")), "\n") != F.col("a")).count() == 0
