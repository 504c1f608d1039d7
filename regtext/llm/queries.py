"""Registered queries of the training-data operators: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize
from . import chat, decontam, exactdedup, lexical, licenses, linededup, mixing, passages, quality, secrets, simhash, trie, warc
from .common import read

REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(name: str):
    def deco(fn):
        REGISTRY[name] = fn
        return fn
    return deco


@query("op1_quality_rules")
def op1(spark, sf):
    scored = materialize(quality.features(read(spark, sf, "documents"), ["doc_id", "lang"]), "quality-scored")
    verdict = quality.judge(scored, quality.calibrate(scored, read(spark, sf, "labels")))
    return verdict.select("doc_id", *[f"features.{c}" for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines",
                                                                "n_repeat_words", "base_failed")],
                          "kept", F.array_join("rejected_by", ",").alias("rejected_by"))


@query("op2_simhash_dedup")
def op2(spark, sf):
    return simhash.near_duplicates(read(spark, sf, "documents"))


@query("op3_warc_fixity")
def op3(spark, sf):
    # the second replica: the same files with some payloads lost, cut short or altered
    key, body = F.col("page_id"), F.coalesce("html", F.lit(""))
    second = F.when(key % 499 == 11, F.lit(None)).when(key % 503 == 7, F.concat(F.lit("#"), F.substr(body, F.lit(2)))) \
        .when(key % 509 == 13, F.substr(body, F.lit(1), F.length(body) - 1)).otherwise(body)
    index = materialize(warc.index_pages(read(spark, sf, "pages"), copies={"b": second}), "warc-index")
    first = index.select("file", "offset", "length", "digest", "id")
    other = index.filter("digest_b IS NOT NULL").select(
        "file", "offset", F.col("length_b").alias("length"), F.col("digest_b").alias("digest"), "id")
    return warc.audit(first, other).withColumnRenamed("id", "page_id")


@query("op4_chat_format")
def op4(spark, sf):
    said = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)],
                                  "conv_id long, turn long, role string, text string")
    rows = read(spark, sf, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    out = chat.format_records(chat.as_records(rows), "conv_id", "record")
    back = out.withColumn("turns", chat.read_back(F.col("formatted"))) \
        .withColumn("loss_text", chat.under_mask(F.col("turns"), F.col("loss")))
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"),
                       F.sha2(F.array_join(lines, ""), 256).alias("turns_sha256"),
                       F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"),
                       F.length("formatted").cast("long").alias("formatted_chars"), "layout")


@query("op5_license_scan")
def op5(spark, sf):
    return licenses.scan(read(spark, sf, "documents"), licenses.known_table(spark))


@query("op6_substring_dedup")
def op6(spark, sf):
    return passages.passages(read(spark, sf, "documents"))


@query("op7_secret_scan")
def op7(spark, sf):
    found = secrets.find(read(spark, sf, "documents"))
    base = F.filter("spans", lambda s: s["kind"] < 3)
    n = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select("doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), n(3).alias("n_markov"),
                        F.sha2(secrets.as_text(base), 256).alias("base_sha256"), secrets.as_text(F.col("spans")).alias("spans"))


@query("op8_source_mix")
def op8(spark, sf):
    return mixing.mix(read(spark, sf, "documents"))


@query("op9_decontamination")
def op9(spark, sf):
    return decontam.contained_items(read(spark, sf, "documents"), read(spark, sf, "benchmark"))


@query("op10_line_dedup")
def op10(spark, sf):
    out = linededup.dedup_lines(read(spark, sf, "documents").select("doc_id", "text"), report=True)
    return out.select("doc_id", "n_lines", "n_deleted", F.length("text").cast("long").alias("n_chars"),
                      F.sha2("text", 256).alias("text_sha256"))


@query("op11_lexical_search")
def op11(spark, sf):
    return lexical.search(read(spark, sf, "documents"), read(spark, sf, "benchmark"))


@query("op12_prefix_trie")
def op12(spark, sf):
    return trie.prefix_trie(spliced(trie.numbered_turns(read(spark, sf, "conversations"))))


def spliced(turns: DataFrame, longest: int = 6) -> DataFrame:
    """The contract's rebuilt conversations: the first h turns of conversation c - c % 100, then c's own turns after
    its first h, with h = crc32(c) % ``longest``; a conversation is listed (without a digest) even if nothing is left."""
    turns = materialize(turns, "numbered-turns")
    h = F.crc32(F.col("conv").cast("string").cast("binary")) % longest
    base = F.col("conv") - F.col("conv") % 100
    ids = turns.filter("pos = 1").select("conv", base.alias("base"), h.alias("h"))
    heads = turns.filter((F.col("conv") == base) & (F.col("pos") < longest)).withColumnRenamed("conv", "base")
    nothing = ids.select("conv", F.lit(0).cast("long").alias("pos"), F.lit(None).cast("binary").alias("turn_digest"),
                         F.lit(0).cast("long").alias("chars"))
    return ids.join(heads, "base").filter("pos <= h").select("conv", "pos", "turn_digest", "chars") \
        .union(turns.filter(F.col("pos") > h)).union(nothing)


@query("op13_exact_dedup")
def op13(spark, sf):
    return exactdedup.exact_groups(read(spark, sf, "documents"), keep="largest")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(REGISTRY)
