"""Registered queries: one per operator ID of the blueprint, over the driver tables.

Every query reads whole tables (or data Spark derives from them) and returns a DataFrame whose
computed columns carry the same names as the DuckDB oracle in ``plans.oracle``. Doubles are
rounded to 6 decimals at the edge so both engines' summation orders compare equal.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as K
from ..functions import text as X
from ..operators import attribution as AT
from ..operators import cleaning as C
from ..operators import metrics as M
from ..operators import models as ML
from ..operators import prep as P
from ..operators import sections as S
from ..operators import split as R
from ..operators import stats as A
from ..operators import tokens as TK
from ..operators.pairs import dictionary_table, expand_abbreviations, longest_shared_passage
from ..session import delete_on_exit, materialize, scratch_path
from ..sources import notes as SRC
from ..sources import sinks as SINK
from .cohort import build_cohort
from .tables import (SCORE_MULTIPLIERS, history_text, measurement_text, procedure_text, r6, score_expr,
                     scored_long, sectioned_text, table, time_text)

Q = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Q] = {}


def query(name: str):
    def deco(fn):
        REGISTRY[name] = fn
        return fn
    return deco


# fixed values of the test design: note types routed from the driver tables
DIALOG_ROLES = ["user", "assistant"]
# fixed values of the test design: the codes that become columns (all that orders have)
ORDER_CODES = ["AF", "AO", "NF", "NO", "RF", "RO"]
ABBREVIATIONS = {"ed": ["education"], "th": ["the", "then"], "an": ["and", "another"], "of": ["off", "often"]}


# ======================================================================= S: sources and sinks
@query("s1_note_scan")
def s1(spark, sf):
    conv = table(spark, sf, "conversations")
    return SRC.scan_notes(conv, "role", DIALOG_ROLES, "text").select("conv_id", "turn", "role", "text")


def _note_registry(spark, sf):
    def docs():
        d = table(spark, sf, "documents")
        return d.select(F.lit("document").alias("note_type"), F.col("doc_id").alias("note_key"),
                        F.lit(0).cast("bigint").alias("line"), F.col("text"))

    def dialog():
        c = SRC.scan_notes(table(spark, sf, "conversations"), "role", DIALOG_ROLES, "text")
        return c.select(F.lit("dialog").alias("note_type"), F.col("conv_id").alias("note_key"),
                        F.col("turn").alias("line"), F.col("text"))

    def system():
        c = SRC.scan_notes(table(spark, sf, "conversations"), "role", ["system"], "text")
        return c.select(F.lit("system").alias("note_type"), F.col("conv_id").alias("note_key"),
                        F.col("turn").alias("line"), F.col("text"))

    return {"document": SRC.NoteSource(docs), "dialog": SRC.NoteSource(dialog, "conversation", 2),
            "system": SRC.NoteSource(system, "conversation", 1)}


@query("s2_multi_source")
def s2(spark, sf):
    return SRC.route_sources(_note_registry(spark, sf), ["document", "dialog", "system"])


@query("s3_registry_scan")
def s3(spark, sf):
    return SRC.read_table(spark, f"{sf}/labels.parquet", columns=["doc_id", "quality", "toxic"]) \
        .select("doc_id", F.col("quality").cast("bigint"), F.col("toxic").cast("bigint"))


def _order_codes(spark, sf):
    li = table(spark, sf, "lineitem").withColumn("code", F.concat("l_returnflag", "l_linestatus"))
    return SRC.code_features(li, "l_orderkey", None, "code", "l_quantity", ORDER_CODES)


@query("s3b_tolerant_scan")
def s3b(spark, sf):
    """``labels`` as a CSV with broken lines (a value of another type, a field too few, one too many), read back with
    the rejected lines and their count from the same scan."""
    i, q, t = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("doc_id", "quality", "toxic"))
    line = F.when(F.col("doc_id") % 7 == 3, F.concat_ws(",", i, F.lit("oops"), t)).when(F.col("doc_id") % 11 == 5, F.concat_ws(",", i, q)) \
        .when(F.col("doc_id") % 13 == 1, F.concat_ws(",", i, q, t, F.lit("more"))).otherwise(F.concat_ws(",", i, q, t))
    path = scratch_path(spark, "registry-csv")
    table(spark, sf, "labels").select(line.alias("value")).write.text(path)
    delete_on_exit(spark, path)
    rows, n = SRC.ingest_registry(spark, path, "doc_id bigint, quality bigint, toxic bigint", header=False)
    return rows.select("doc_id", "quality", "toxic", F.col(SRC.CORRUPT).alias("rejected_line"),
                       *[F.lit(n[c]).cast("bigint").alias(f"n_{c}") for c in ("rows", "rejects")])


@query("s4_code_features")
def s4(spark, sf):
    f = _order_codes(spark, sf)
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"),
                                          F.date_format(F.to_date("o_orderdate"), "yyyy-MM-dd").alias("order_date"))
    codes = [c for c in f.columns if c.startswith("CPT_")]
    return f.join(o, "l_orderkey").select("l_orderkey", "order_date", *[r6(c).alias(c) for c in codes])


@query("s4b_code_totals")
def s4b(spark, sf):
    li = table(spark, sf, "lineitem").withColumn("code", F.concat("l_returnflag", "l_linestatus"))
    return SRC.code_totals(li, "l_orderkey", None, "code", "l_quantity").withColumn("value", r6("value"))


def _brand_codes(spark, sf):
    """(l_orderkey, code, value): the quantity of every part brand in an order, an open set of codes."""
    li = table(spark, sf, "lineitem").select("l_orderkey", F.col("l_partkey").alias("p_partkey"), "l_quantity")
    rows = li.join(table(spark, sf, "part").select("p_partkey", F.col("p_brand").alias("code")), "p_partkey")
    return SRC.code_totals(rows, "l_orderkey", None, "code", "l_quantity")


@query("s4c_code_vectors")
def s4c(spark, sf):
    """The sparse vectors, read back as one row per entry."""
    totals = _brand_codes(spark, sf)
    codes, n = SRC.code_dictionary(totals)
    v = F.unwrap_udt("features")
    rows = SRC.code_vectors(totals, codes, n, "l_orderkey").select("l_orderkey", v["size"].cast("bigint").alias("n_codes"), v["values"].alias("v"),
                                                                  F.posexplode(v["indices"]).alias("pos", "code_id"))
    return rows.select("l_orderkey", "n_codes", *[F.col(c).cast("bigint").alias(c) for c in ("pos", "code_id")], r6(F.get("v", F.col("pos"))).alias("value"))


@query("s5_split_export")
def s5(spark, sf):
    """Write the R1 split partitioned by split under the checkpoint folder; read the held-out part back."""
    from ..session import delete_on_exit, scratch_path
    tagged = R.random_split(table(spark, sf, "documents", heavy=False).select("doc_id", "lang"), "doc_id")
    path = scratch_path(spark, "s5")
    SINK.write_split(tagged, path)
    delete_on_exit(spark, path)
    return spark.read.parquet(f"{path}/split=test")


@query("s6_results_table")
def s6(spark, sf):
    rep = M.evaluation_report(scored_long(spark, sf))
    long = rep.unpivot(["label"], ["auc", "precision", "recall", "f1"], "metric", "value")
    t = SINK.results_table(long, metrics=["auc", "f1", "precision", "recall"])
    return t.select("label", *[r6(c).alias(c) for c in t.columns if c != "label"])


def _history(spark, sf, epochs: int = 3, run_id: str = "run0") -> DataFrame:
    """Metric history over epochs: epoch e scores the labels with the stand-in model of epoch e.
    All epochs are evaluated in one plan (``epoch`` is a grouping column of every metric)."""
    ep = F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))).alias("epoch")
    base = table(spark, sf, "labels").select("*", ep)
    st = F.array(*[F.struct(F.lit(l).alias("label"), F.col(l).cast("int").alias("y_true"),
                            score_expr("doc_id", m, F.col("epoch")).alias("score"))
                   for l, m in SCORE_MULTIPLIERS.items()])
    long = base.select(F.col("epoch").cast("bigint").alias("epoch"), F.col("doc_id").alias("row_id"), F.inline(st))
    rep = M.evaluation_report(long, by=["epoch"])
    per = rep.unpivot(["epoch", "label"], ["auc", "precision", "recall", "f1"], "metric", "value")
    loss = M.losses(long, by=["epoch"]).filter(F.col("label") == "all") \
        .select("epoch", "label", F.lit("loss").alias("metric"), F.col("bce").alias("value"))
    return per.unionByName(loss).select(F.lit(run_id).alias("run_id"), "epoch", F.lit("test").alias("split"),
                                        "label", "metric", "value")


@query("s7_prediction_dump")
def s7(spark, sf):
    long = scored_long(spark, sf)
    thr = M.optimal_thresholds(M.pr_curve(M.cumulative_counts(long)))
    return SINK.prediction_dump(M.tuned_predictions(long, thr), "run0", 0)


@query("s8_frequency_table")
def s8(spark, sf):
    d = table(spark, sf, "documents")
    return A.token_frequency(A.explode_tokens(d, X.unicode_words("text")))


@query("s9_metric_history")
def s9(spark, sf):
    h = _history(spark, sf)
    return h.withColumn("value", r6("value"))


# ======================================================================= P: projections, filters
@query("p1_select_by_prefix")
def p1(spark, sf):
    return P.select_by_prefix(table(spark, sf, "part"), ["p_"], keep=["p_partkey"], exclude=["p_name"]) \
        .withColumn("p_size", F.col("p_size").cast("bigint"))


@query("p2_drop_nulls")
def p2(spark, sf):
    d = table(spark, sf, "documents", heavy=False).select("doc_id", "lang", "n_chars")
    j = d.join(table(spark, sf, "labels"), "doc_id", "left")
    return P.drop_nulls(j).select("doc_id", "lang", "n_chars", F.col("quality").cast("bigint"),
                                  F.col("toxic").cast("bigint"))


@query("p3_regex_filter")
def p3(spark, sf):
    d = P.regex_filter(table(spark, sf, "documents"), "text", "nicht|the sh", case_sensitive=False)
    return d.select("doc_id", "lang", "source")


@query("p4_min_words")
def p4(spark, sf):
    c = P.min_words_filter(table(spark, sf, "conversations"), "text", 5)
    return c.select("conv_id", "turn")


@query("p5_empty_to_null")
def p5(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.regexp_replace("text", "[^0-9]", "").alias("digits"))
    return P.empty_to_null(d, "digits")


@query("p6_label_cast_fill")
def p6(spark, sf):
    d = table(spark, sf, "documents", heavy=False).select("doc_id")
    j = d.join(table(spark, sf, "labels"), "doc_id", "left")
    return P.labels_to_int(j, ["quality", "toxic"]).select(
        "doc_id", F.col("quality").cast("bigint"), F.col("toxic").cast("bigint"))


@query("p7_lenient_cast")
def p7(spark, sf):
    ev = table(spark, sf, "events")
    raw = F.trim(F.regexp_extract("props", r":\s*([^}]*)\}", 1))
    return ev.select("event_id", P.lenient_to_bigint(raw).alias("k"),
                     P.lenient_to_bigint(F.col("event_type")).alias("type_as_int"))


@query("p8_first_line")
def p8(spark, sf):
    c = table(spark, sf, "conversations")
    return P.first_line(c, "turn", 0, ["conv_id"], ["turn"]).select("conv_id", "role", "text")


@query("p9_str2bool")
def p9(spark, sf):
    o = table(spark, sf, "orders")
    spelled = F.when(F.col("o_orderstatus") == "F", "Yes").when(F.col("o_orderstatus") == "O", "No") \
        .otherwise("unknown")
    pri = F.when(F.col("o_orderpriority").startswith("1"), "YES").otherwise("Null")
    o2 = o.select("o_orderkey", spelled.alias("status_flag"), pri.alias("urgent_flag"))
    return P.str_to_bool_labels(o2, ["status_flag", "urgent_flag"])


@query("p10_drop_nan_literal")
def p10(spark, sf):
    ev = table(spark, sf, "events")
    v = F.when(F.col("value") > 50, F.lit("nan")).otherwise(F.col("event_type"))
    return P.drop_nan_literal(ev.select("event_id", v.alias("tag")), "tag")


# ======================================================================= J: joins
@query("j1_notes_registry")
def j1(spark, sf):
    notes = table(spark, sf, "documents", heavy=False).select("doc_id", "lang", "source", "n_chars")
    out = P.join_registry(notes, table(spark, sf, "labels"), ["doc_id"], ["quality", "toxic"])
    return out.select("doc_id", F.col("quality").cast("bigint"), F.col("toxic").cast("bigint"), "lang", "source",
                      "n_chars")


@query("j2_join_dropping")
def j2(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("custkey"), "o_orderkey", "o_totalprice",
                                          "o_orderstatus")
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("custkey"), "c_name", "c_acctbal",
                                            "c_mktsegment", "c_nationkey")
    out = P.join_dropping(o, c, ["custkey"], drop_left=["o_orderstatus"], drop_right_prefixes=["c_acct"])
    return out.select("custkey", "o_orderkey", r6("o_totalprice").alias("o_totalprice"), "c_name", "c_mktsegment",
                      F.col("c_nationkey").cast("bigint"))


@query("j3_join_dedup")
def j3(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("orderkey"), "o_custkey")
    li = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("orderkey"), "l_linenumber", "l_partkey",
                                             "l_quantity")
    out = P.join_then_dedup(o, li, ["orderkey"], ["orderkey"], ["l_linenumber"])
    return out.select("orderkey", "o_custkey", F.col("l_linenumber").cast("bigint"), "l_partkey",
                      r6("l_quantity").alias("l_quantity"))


@query("j4_small_dimension")
def j4(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("nationkey"))
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("nationkey"), "n_name",
                                          F.col("n_regionkey").cast("bigint"))
    return P.join_small_dimension(c, n, ["nationkey"]).select("c_custkey", F.col("nationkey").cast("bigint"),
                                                               "n_name", "n_regionkey")


@query("j5_split_features")
def j5(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority")
    tagged = R.random_split(o, "l_orderkey", validate=False, keys_unique=True)
    f = _order_codes(spark, sf)
    out = tagged.join(f, "l_orderkey")
    codes = [c for c in f.columns if c.startswith("CPT_")]
    return out.select("l_orderkey", "split", "o_orderpriority", *[r6(c).alias(c) for c in codes])


@query("j6_abbrev_expand")
def j6(spark, sf):
    d = table(spark, sf, "documents")
    out = expand_abbreviations(d.select("doc_id", "text"), "doc_id", "text", dictionary_table(spark, ABBREVIATIONS))
    return out.withColumnRenamed("text", "expanded")


@query("j7_longest_shared_passage")
def j7(spark, sf):
    d = table(spark, sf, "documents")
    b = table(spark, sf, "benchmark")
    return longest_shared_passage(d, "doc_id", "text", b, "item_id", "text", k=8)


# ======================================================================= A: aggregation
@query("a1_keyed_dedup")
def a1(spark, sf):
    ev = table(spark, sf, "events")
    out = P.keyed_dedup(ev.select("user_id", "event_id", "ts", "event_type"), ["user_id"], ["ts", "event_id"])
    return out.select("user_id", "event_id", "event_type")


@query("a2_note_concat")
def a2(spark, sf):
    c = table(spark, sf, "conversations")
    return P.ordered_concat(c, ["conv_id", "role"], "turn", "text")


@query("a3_sort_group_concat")
def a3(spark, sf):
    c = table(spark, sf, "conversations")
    return P.sort_group_concat(c, ["conv_id"], "text", "turn", ["conv_id", "concat_text"], "conv_id")


@query("a4_grouped_text_concat")
def a4(spark, sf):
    d = table(spark, sf, "documents")
    return A.grouped_text_concat(d, ["lang"], "doc_id", "text", clean=True, chunk_rows=1000)


@query("a5_token_frequency")
def a5(spark, sf):
    d = table(spark, sf, "documents")
    return A.token_frequency(A.explode_tokens(d, X.unicode_words("text")))


@query("a6_top_terms")
def a6(spark, sf):
    d = table(spark, sf, "documents")
    freq = A.token_frequency(A.explode_tokens(d, X.unicode_words("text")))
    return A.top_terms(freq, 100, K.NLTK_ENGLISH_STOPWORDS)


@query("a7_word_counts")
def a7(spark, sf):
    d = table(spark, sf, "documents")
    return A.word_counts(d, "text", preprocess=False).select("doc_id", "n_words", "n_distinct_words")


@query("a7b_word_counts_keywords")
def a7b(spark, sf):
    d = table(spark, sf, "documents")
    return A.word_counts(d, "text", preprocess=True).select("doc_id", "n_words", "n_distinct_words")


@query("a8_rare_mask")
def a8(spark, sf):
    c = table(spark, sf, "conversations")
    return P.mask_rare(c.select("conv_id", "turn", "role"), ["role"], cut=0.05)


@query("a9_one_hot")
def a9(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    out, names = P.one_hot(o, ["o_orderpriority"], drop_source=True)
    return out.select("o_orderkey", *[F.col(f"`{n}`").cast("bigint").alias(n.replace("-", "_")) for n in names])


@query("a10_label_prevalence")
def a10(spark, sf):
    return A.label_prevalence(table(spark, sf, "labels"), ["quality", "toxic"], 0.2) \
        .withColumn("pos_rate", r6("pos_rate"))


@query("a11_class_weights")
def a11(spark, sf):
    w = A.class_weights(table(spark, sf, "embeddings"), "label")
    return w.select(F.col("class").cast("bigint"), "n", r6("weight").alias("weight"))


def _labels_on_documents(spark, sf):
    return table(spark, sf, "documents", heavy=False).select("doc_id").join(table(spark, sf, "labels"), "doc_id", "left")


@query("a12_loss_weights")
def a12(spark, sf):
    j = _labels_on_documents(spark, sf)
    a = A.loss_weights(j, ["quality", "toxic"], "non_null_reinforcement").withColumn("how", F.lit("null"))
    b = A.loss_weights(j, ["quality", "toxic"], "positive_example_reinforcement").withColumn("how", F.lit("positive"))
    return a.unionByName(b).withColumn("weight", r6("weight"))


@query("a13_subgroup_summary")
def a13(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "n_chars", X.word_count("text").alias("n_words"))
    j = table(spark, sf, "labels").join(docs, "doc_id")
    out = A.subgroup_summary(j, "doc_id", ["quality", "toxic"], ["n_chars", "n_words"])
    return out.select("fraction", "flag", "outcome", "n", r6("mean").alias("mean"), r6("std").alias("std"))


@query("a14_mean_ci")
def a14(spark, sf):
    d = table(spark, sf, "documents", heavy=False)
    out = A.mean_ci(d, "n_chars", ["lang"])
    return out.select("lang", "n", *[r6(c).alias(c) for c in ("mean", "std", "half_width", "ci_lower", "ci_upper")])


@query("a15_best_per_label")
def a15(spark, sf):
    return A.best_per_label(_history(spark, sf)).withColumn("best_value", r6("best_value"))


@query("a16_best_epoch")
def a16(spark, sf):
    return A.best_epoch(_history(spark, sf)).withColumn("best_loss", r6("best_loss"))


# ======================================================================= R: splits
@query("r1_random_split")
def r1(spark, sf):
    d = table(spark, sf, "documents", heavy=False).select("doc_id")
    return R.random_split(d, "doc_id", validate=True)


@query("r2_cohort_split")
def r2(spark, sf):
    d = table(spark, sf, "documents", heavy=False).select("doc_id", "lang", "source")
    return R.cohort_split(d, "doc_id", "lang", "en", "source", "src0", validate=True).select("doc_id", "split")


@query("r3_exact_sample")
def r3(spark, sf):
    d = table(spark, sf, "documents", heavy=False).select("doc_id", "lang")
    return R.exact_sample(d, "doc_id", 0.1)


@query("r3b_hash_sample")
def r3b(spark, sf):
    d = table(spark, sf, "documents", heavy=False).select("doc_id", "lang")
    return R.hash_sample(d, "doc_id", 0.1)


# ======================================================================= T: text
@query("t1_keywords")
def t1(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.keywords("text").alias("keywords"))


@query("t1b_keywords_lemma")
def t1b(spark, sf):
    """Verb endings against the corpus' own vocabulary as the lemma table."""
    kw = materialize(table(spark, sf, "documents").select("doc_id", X.keywords("text").alias("keywords")), "keywords")
    words = C.distinct_words(kw, "keywords")
    lemmas = C.attested_lemmas(words, {"verb": ("ing", "ed", "es", "en"), "noun": ("s", "en")})
    return C.lemmatise(kw, "doc_id", "keywords", lemmas, "verb", words)


@query("t2_clean_report")
def t2(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.clean_report("text").alias("cleaned"))


@query("t3_nondiagnostic")
def t3(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.nondiagnostic("text").alias("cleaned"))


@query("t4_measurements")
def t4(spark, sf):
    m = measurement_text(spark, sf)
    return m.select("l_orderkey", F.col("l_linenumber").cast("bigint"), X.remove_measurements("text").alias("cleaned"))


@query("t5_time_info")
def t5(spark, sf):
    return time_text(spark, sf).select("event_id", X.remove_time_info("text").alias("cleaned"))


@query("t6_dr_names")
def t6(spark, sf):
    c = table(spark, sf, "customer")
    t = F.concat(F.lit("Seen by Dr. "), F.col("c_name"), F.lit(" and dr.  "), F.col("c_mktsegment"))
    return c.select("c_custkey", X.remove_dr_names(t).alias("cleaned"))


@query("t7_strip_punctuation")
def t7(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", F.array_join(X.strip_punctuation(X.sentences("text")), "\n").alias("cleaned"))


@query("t8_line_table")
def t8(spark, sf):
    return S.line_table(table(spark, sf, "documents"), "doc_id", "text")


@query("t9_cut_words")
def t9(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.cut_words("text", 100).alias("cut"))


@query("t10_sentence_table")
def t10(spark, sf):
    return S.sentence_table(table(spark, sf, "documents"), "doc_id", "text", min_len=3)


@query("t11_section_table")
def t11(spark, sf):
    return S.section_table(sectioned_text(spark, sf), "doc_id", "text")


@query("t12_history_filter")
def t12(spark, sf):
    return history_text(spark, sf).select("doc_id", X.history_sections("text").alias("history"))


@query("t13_procedure_section")
def t13(spark, sf):
    return procedure_text(spark, sf).select("doc_id", X.procedure_section("text").alias("procedure"))


@query("t14_procedure_after")
def t14(spark, sf):
    return procedure_text(spark, sf).select("doc_id", X.procedure_after("text").alias("procedure"))


@query("t15_remove_sections")
def t15(spark, sf):
    return S.remove_sections(sectioned_text(spark, sf), "doc_id", "text").select("doc_id", "report")


@query("t16_dict_column")
def t16(spark, sf):
    ev = table(spark, sf, "events")
    kv = ev.select(F.explode_outer(X.parse_dict_string("props")).alias("key", "value")).filter(F.col("key").isNotNull())
    return kv.groupBy("key").agg(F.count(F.lit(1)).cast("bigint").alias("n"),
                                 r6(F.sum(F.col("value").try_cast("double"))).alias("total"))


@query("t17_list_column")
def t17(spark, sf):
    d = table(spark, sf, "documents")
    s = F.concat(F.lit("['"), F.col("lang"), F.lit("', '"), F.col("source"), F.lit("', '']"))
    items = d.select(F.explode(X.parse_list_string(s)).alias("item"))
    return items.groupBy("item").agg(F.count(F.lit(1)).cast("bigint").alias("n"))


@query("t18_first_integer")
def t18(spark, sf):
    p = table(spark, sf, "part").withColumn("brand_no", X.first_integer("p_brand"))
    return p.groupBy("brand_no").agg(F.count(F.lit(1)).cast("bigint").alias("n"),
                                     r6(F.avg("p_retailprice")).alias("avg_price"))


@query("t19_flatten")
def t19(spark, sf):
    k5 = S.sentence_tokens(table(spark, sf, "documents"), "doc_id", "text")
    return S.flatten_to_rows(k5, "doc_id", "tokens")


@query("t20_cleaning_chain")
def t20(spark, sf):
    h = history_text(spark, sf)
    c = h.select("doc_id", X.nondiagnostic(X.history_sections("text")).alias("cleaned"))
    return P.empty_to_null(c, "cleaned")


@query("t20b_cleaning_report")
def t20b(spark, sf):
    d = history_text(spark, sf).join(table(spark, sf, "documents", heavy=False).select("doc_id", "lang"), "doc_id")
    return C.cleaning_report(d, ["history", "time_info", "nondiagnostic"], ["lang"])


# ======================================================================= K: tokens
def _vocab(spark, sf):
    return TK.build_vocabulary(table(spark, sf, "documents"), "text")


@query("k1_vocab_encode")
def k1(spark, sf):
    d = table(spark, sf, "documents")
    enc = TK.encode(d, "doc_id", "text", _vocab(spark, sf))
    return enc.select("doc_id", F.array_join("input_ids", ",").alias("input_ids"),
                      F.array_join("attention_mask", ",").alias("attention_mask"))


@query("k2_flatten_ids")
def k2(spark, sf):
    # the model-input chain: sentences merged (T10), punctuation stripped (T7), word lists, ids, flattened
    d = table(spark, sf, "documents")
    sent = d.select("doc_id", S.word_lists(X.strip_punctuation(S.merged_sentences("text"))).alias("tokens"))
    vocab = TK.build_vocabulary(d, "text")
    ids = TK.encode_sentences(sent, "doc_id", "tokens", vocab)
    return ids.select("doc_id", F.array_join("input_ids", ",").alias("input_ids"),
                      F.array_join("attention_mask", ",").alias("attention_mask"))


@query("k3_pack_blocks")
def k3(spark, sf):
    d = table(spark, sf, "documents")
    ids = TK.to_ids(d, "doc_id", X.unicode_words("text"), _vocab(spark, sf))
    b = TK.pack_blocks(ids, "doc_id", "ids", 512)
    return b.select("block_id", F.array_join("input_ids", ",").alias("input_ids"),
                    F.size("labels").cast("bigint").alias("n_labels"))


@query("k4_label_matrix")
def k4(spark, sf):
    m, _, _ = TK.label_matrix(table(spark, sf, "labels"), "doc_id", ["toxic", "quality"])
    return m.select("doc_id", F.array_join("labels", ",").alias("labels"))


@query("k5_sentence_tokens")
def k5(spark, sf):
    k = S.sentence_tokens(table(spark, sf, "documents"), "doc_id", "text")
    return k.select("doc_id", F.size("tokens").cast("bigint").alias("n_sentences"),
                    F.array_join(F.transform("tokens", lambda t: F.array_join(t, " ")), "\n").alias("tokens"))


@query("k5b_keyword_tokens")
def k5b(spark, sf):
    k = S.sentence_tokens(table(spark, sf, "documents"), "doc_id", "text", preprocess=True)
    return k.select("doc_id", F.size("tokens").cast("bigint").alias("n_sentences"),
                    F.size(F.element_at("tokens", 1)).cast("bigint").alias("n_tokens"),
                    F.array_join(F.element_at("tokens", 1), " ").alias("tokens"))


# ======================================================================= E: the cohort build
@query("e1_cohort_build")
def e1(spark, sf):
    conv = table(spark, sf, "conversations")
    out = build_cohort(conv, table(spark, sf, "labels"), "conv_id", "role", "turn", "text", {"conv_id": "doc_id"},
                       ["quality", "toxic"], descriptions=DIALOG_ROLES, sectionize=["medical history"])
    return out.select("conv_id", "role", F.col("quality").cast("bigint"), F.col("toxic").cast("bigint"), "text", "split")


def _surgery_notes(spark, sf):
    """Conversations as notes of which two belong to one surgery."""
    return table(spark, sf, "conversations").withColumn("surgery_id", F.floor(F.col("conv_id") / 2).cast("bigint"))


@query("e1b_first_line")
def e1b(spark, sf):
    out = build_cohort(_surgery_notes(spark, sf), table(spark, sf, "labels"), "conv_id", "role", "turn", "text",
                       {"surgery_id": "doc_id"}, ["quality"], concatenate=False, first_line=0,
                       label_source="comorbidity", drop_prefixes=["tox"], split=None)
    return out.select("surgery_id", "conv_id", "role", F.col("quality").cast("bigint"), "text")


@query("e1c_raw_registry")
def e1c(spark, sf):
    # a registry with a text label: two common values, and rare ones that are masked
    k = F.col("doc_id")
    raw = table(spark, sf, "documents", heavy=False).select(
        "doc_id", F.when(k % 29 == 3, F.concat(F.lit("odd"), k.cast("string"))).when(k % 3 == 0, "low").otherwise("high").alias("grade"))
    out = build_cohort(_surgery_notes(spark, sf), raw, "conv_id", "role", "turn", "text", {"surgery_id": "doc_id"}, ["grade"],
                       label_source="raw", split=None)
    names = [c for c in out.columns if c.startswith("grade_")]
    flags = F.array(*[F.struct(F.lit(c).alias("label"), F.col(f"`{c}`").cast("bigint").alias("value")) for c in names])
    return out.select("surgery_id", "conv_id", "role", F.md5("text").alias("text_md5"), F.inline(flags))


@query("e1d_version_split")
def e1d(spark, sf):
    versions = table(spark, sf, "documents", heavy=False).select(
        F.col("doc_id").alias("conv_id"), F.col("lang").alias("site"), F.col("source").alias("version"))
    out = build_cohort(table(spark, sf, "conversations"), table(spark, sf, "labels"), "conv_id", "role", "turn", "text",
                       {"conv_id": "doc_id"}, ["quality", "toxic"], descriptions=DIALOG_ROLES, split="version",
                       versions=versions, site="en", test_version="src0")
    return out.select("conv_id", "role", F.col("quality").cast("bigint"), F.col("toxic").cast("bigint"), "text", "split")


# ======================================================================= M: evaluation
@query("m4_pr_curve")
def m4(spark, sf):
    c = M.pr_curve(M.cumulative_counts(scored_long(spark, sf)))
    return c.select("label", r6("threshold").alias("threshold"), r6("precision").alias("precision"),
                    r6("recall").alias("recall"), "tp", "fp")


@query("m5_prf_fixed")
def m5(spark, sf):
    long = scored_long(spark, sf)
    out = M.prf(M.confusion(long, F.col("score") >= 0.5))
    return out.select("label", "tp", "fp", "fn", "tn", *[r6(c).alias(c) for c in ("precision", "recall", "f1")])


@query("m6_averaged_prf")
def m6(spark, sf):
    counts = M.confusion(scored_long(spark, sf), F.col("score") >= 0.5)
    out = M.averaged_prf(counts, "micro").unionByName(M.averaged_prf(counts, "macro")) \
        .unionByName(M.averaged_prf(counts, "weighted"))
    return out.select("average", *[r6(c).alias(c) for c in ("precision", "recall", "f1")])


@query("m7_optimal_threshold")
def m7(spark, sf):
    st = M.label_stats(M.cumulative_counts(scored_long(spark, sf))).filter(F.col("threshold").isNotNull())
    return st.select("label", r6("threshold").alias("threshold"), (F.col("tp") + F.col("fp")).cast("bigint").alias("n_positive_pred"))


@query("m8_roc_auc")
def m8(spark, sf):
    return M.roc_auc(M.cumulative_counts(scored_long(spark, sf), pooled="micro")).withColumn("auc", r6("auc"))


@query("m9_losses")
def m9(spark, sf):
    return M.losses(scored_long(spark, sf)).select("label", r6("bce").alias("bce"), r6("focal").alias("focal"))


@query("m10_average_precision")
def m10(spark, sf):
    return M.average_precision(M.cumulative_counts(scored_long(spark, sf), pooled="micro")).withColumn("ap", r6("ap"))


@query("m11_evaluation_report")
def m11(spark, sf):
    rep = M.evaluation_report(scored_long(spark, sf), auc="roc", average="micro")
    return rep.select("label", *[r6(c).alias(c) for c in ("auc", "threshold", "precision", "recall", "f1")])


@query("m11b_report_pr_macro")
def m11b(spark, sf):
    rep = M.evaluation_report(scored_long(spark, sf), auc="pr", average="macro")
    return rep.select("label", *[r6(c).alias(c) for c in ("auc", "threshold", "precision", "recall", "f1")])


@query("m12_logits_report")
def m12(spark, sf):
    long = scored_long(spark, sf).withColumn("score", (F.col("score") - F.lit(0.5)) * F.lit(8.0))
    return M.logits_report(long).withColumn("value", r6("value"))


def _texts(spark, sf):
    return table(spark, sf, "documents", heavy=False).select(F.col("doc_id").alias("row_id"), "text")


@query("m3b_predicted_names")
def m3b(spark, sf):
    lab = table(spark, sf, "labels")
    scores = [score_expr("doc_id", m) for m in SCORE_MULTIPLIERS.values()]
    return lab.select("doc_id", F.array_join(ML.names_above(list(SCORE_MULTIPLIERS), scores, 0.5), ",").alias("predicted"))


@query("m14b_linear_attribution")
def m14b(spark, sf):
    """The arithmetic of M14 with weights that are a function of the token instead of fitted ones."""
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    counts = d.select("doc_id", "quality", "toxic", F.explode(X.unicode_words("text")).alias("token")) \
        .groupBy("doc_id", "quality", "toxic", "token").agg(F.count(F.lit(1)).alias("x"))
    w = (F.length("token") - F.lit(4)).cast("double")
    att = AT.linear_attribution(counts, d, "token", ["quality", "toxic"], w)
    return att.select("label", "token", (r6("attribution") + F.lit(0.0)).alias("attribution"))  # no negative zero


@query("m15_error_types")
def m15(spark, sf):
    return M.error_types(scored_long(spark, sf), F.col("score") >= 0.5, _texts(spark, sf))


@query("m15b_error_types_wide")
def m15b(spark, sf):
    return M.error_types_wide(scored_long(spark, sf), F.col("score") >= 0.5, list(SCORE_MULTIPLIERS), _texts(spark, sf))


def queries() -> dict[str, Q]:
    from . import ml  # noqa: F401  (registers the MLlib queries)
    return dict(REGISTRY)
