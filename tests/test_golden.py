"""Golden rows: one per decision in the blueprint's fixture list (our reading, not the quirk)."""

import math

import pytest
from pyspark.sql import functions as F

from regtext.functions import text as X
from regtext.operators import metrics as M
from regtext.operators import prep as P
from regtext.operators import sections as S
from regtext.operators import split as R
from regtext.operators import stats as A
from regtext.operators import tokens as TK
from regtext.operators.pairs import dictionary_table, expand_abbreviations, longest_shared_passage


def one(spark, expr, text):
    return spark.createDataFrame([(text,)], "t string").select(expr(F.col("t")).alias("o")).collect()[0]["o"]


def test_a2_numeric_line_order_and_null_keys(spark):
    df = spark.createDataFrame([(1, 2, "b"), (1, 10, "c"), (1, 1, "a"), (None, 1, "z")], "k int, line int, text string")
    rows = P.ordered_concat(df, ["k"], "line", "text").collect()
    assert [(r.k, r.concat_text) for r in rows] == [(1, "a\nb\nc")]


def test_a1_first_in_documented_order(spark):
    df = spark.createDataFrame([(1, 5, "late"), (1, 2, "early"), (2, 1, "only")], "k int, ts int, v string")
    got = {r.k: r.v for r in P.keyed_dedup(df, ["k"], ["ts"]).collect()}
    assert got == {1: "early", 2: "only"}


def test_a8_rare_mask(spark):
    df = spark.createDataFrame([("x",)] * 97 + [("y",)] * 2 + [("z",)], "c string")
    got = sorted(r.c for r in P.mask_rare(df, ["c"], 0.03).collect())
    assert got.count("NULL") == 3 and got.count("x") == 97


def test_a9_one_hot_skips_null(spark):
    df = spark.createDataFrame([("a",), ("b",), (None,)], "c string")
    out, names = P.one_hot(df, ["c"])
    assert names == ["c_a", "c_b"]
    assert sorted(tuple(r) for r in out.select("c_a", "c_b").collect()) == [(0, 0), (0, 1), (1, 0)]


def test_a10_strict_threshold(spark):
    df = spark.createDataFrame([(1,)] * 3 + [(0,)] * 7, "SP_x int")
    r = A.label_prevalence(df, ["SP_x"], 0.3).collect()[0]
    assert r.kept == 0 and r.n_passing == 0


def test_a11_class_weights(spark):
    df = spark.createDataFrame([(0,), (1,), (1,), (1,)], "y int")
    got = {r["class"]: r.weight for r in A.class_weights(df, "y").collect()}
    assert got[0] == pytest.approx(0.75) and got[1] == pytest.approx(0.25)


def test_a12_loss_weights(spark):
    df = spark.createDataFrame([(None,)] * 4 + [(1,)] * 20 + [(0,)] * 76, "l int")
    assert A.loss_weights(df, ["l"]).collect()[0].weight == pytest.approx(0.086)
    assert A.loss_weights(df, ["l"], "positive_example_reinforcement").collect()[0].weight == pytest.approx(0.77)


def test_a14_mean_ci(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (float("nan"),)], "x double")
    r = A.mean_ci(df, "x").collect()[0]
    assert r.mean == pytest.approx(2.0) and r.half_width == pytest.approx(2.484138, abs=1e-6)


def _history(spark, values, metric="f1", label="a"):
    rows = [("r", i, "test", label, metric, v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "run_id string, epoch long, split string, label string, metric string, value double")


def test_a15_best_value_nan_as_zero(spark):
    r = A.best_per_label(_history(spark, [0.3, float("nan"), 0.2])).collect()[0]
    assert r.best_value == pytest.approx(0.3)


def test_a16_true_minimum(spark):
    r = A.best_epoch(_history(spark, [0.1, 0.5, 0.4], "loss", "all")).collect()[0]
    assert r.best_epoch == 0


def test_j6_abbreviation(spark):
    def expanded(dictionary, *texts):
        df = spark.createDataFrame(list(enumerate(texts)), "k int, t string")
        out = expand_abbreviations(df, "k", "t", dictionary_table(spark, dictionary))
        return [r.t for r in out.orderBy("k").collect()]

    assert expanded({"mi": ["myocardial infarction"]}, "hx of mi", None, "", "no match") == \
        ["hx of myocardial infarction", None, "", "no match"]
    assert expanded({"pt": ["patient", "physical therapy"]}, "pt physical therapy pt") == \
        ["physical therapy physical therapy physical therapy"]


def test_j7_char_mode(spark):
    a = spark.createDataFrame([(1, "abcdef")], "id long, t string")
    b = spark.createDataFrame([(9, "zabcy")], "id long, t string")
    r = longest_shared_passage(a, "id", "t", b, "id", "t", k=2, unit="char").collect()[0]
    assert (r.start_a, r.start_b, r.size) == (0, 1, 3)


def test_k2_flatten(spark):
    df = spark.createDataFrame([([[2, 5, 3], [2, 6, 3]],), ([[2, 5], [2], [2, 6]],)], "n array<array<int>>")
    r8 = df.limit(1).select(TK.flatten_ids(F.col("n"), 8).alias("t")).collect()[0].t
    assert r8.input_ids == [2, 5, 3, 6, 3, 1, 1, 1] and r8.attention_mask == [1] * 5 + [0] * 3
    r6 = df.select(TK.flatten_ids(F.col("n"), 6).alias("t")).collect()[1].t
    assert r6.input_ids == [2, 5, 6, 1, 1, 1]


def test_k3_blocks(spark):
    df = spark.createDataFrame([(1, list(range(300))), (2, list(range(300))), (3, list(range(500)))],
                               "k long, ids array<int>")
    blocks = TK.pack_blocks(df, "k", "ids", 512).orderBy("block_id").collect()
    assert [len(b.input_ids) for b in blocks] == [512, 512]
    assert blocks[0].input_ids == list(range(300)) + list(range(212))
    assert blocks[1].input_ids == list(range(212, 300)) + list(range(424))


def _long(spark, y, s, label="a"):
    return spark.createDataFrame([(i, label, yy, float(ss)) for i, (yy, ss) in enumerate(zip(y, s))],
                                 "row_id long, label string, y_true int, score double")


def test_m5_precision_recall_order(spark):
    long = _long(spark, [1, 1, 0, 0, 0], [1, 1, 1, 1, 0])
    r = M.prf(M.confusion(long, F.col("score") >= 0.5)).collect()[0]
    assert r.precision == pytest.approx(0.5) and r.recall == pytest.approx(1.0) and r.f1 == pytest.approx(2 / 3)


def test_m5_undefined_is_null(spark):
    r = M.prf(M.confusion(_long(spark, [1, 0], [0.1, 0.2]), F.col("score") >= 0.5)).collect()[0]
    assert r.precision is None and r.f1 is None


def test_m7_m8_m10(spark):
    long = _long(spark, [0, 0, 1, 1], [0.1, 0.4, 0.35, 0.8])
    cum = M.cumulative_counts(long)
    thr = M.optimal_thresholds(M.pr_curve(cum)).collect()[0].threshold
    assert thr == pytest.approx(0.4)
    mask = [r.pred for r in M.tuned_predictions(long, M.optimal_thresholds(M.pr_curve(cum))).orderBy("row_id").collect()]
    assert mask == [0, 0, 0, 1]
    assert M.roc_auc(cum).collect()[0].auc == pytest.approx(0.75)
    assert M.average_precision(cum).collect()[0].ap == pytest.approx(0.833333, abs=1e-6)


def test_m9_bce(spark):
    r = M.losses(_long(spark, [1], [0.5])).filter("label = 'a'").collect()[0]
    assert r.bce == pytest.approx(math.log(2))


def test_m15_full_codes(spark):
    r = M.error_types(_long(spark, [0], [0.9]), F.col("score") >= 0.5).collect()[0]
    assert r.outcome == "fp"


def test_p9_spellings(spark):
    df = spark.createDataFrame([(1, "Yes"), (2, "Null"), (3, "unknown"), (4, None)], "id int, c string")
    got = {r.id: r.c for r in P.str_to_bool_labels(df, ["c"]).collect()}
    assert got == {1: 1, 2: 0}


def test_r1_sizes(spark):
    df = spark.range(11).withColumnRenamed("id", "k")
    got = {r.split: r.n for r in R.random_split(df, "k").groupBy("split").agg(F.count("*").alias("n")).collect()}
    assert got == {"train": 8, "validation": 1, "test": 2}


def test_r2_cohort(spark):
    df = spark.createDataFrame([(1, "X", "4.1"), (2, "X", "4.2"), (3, "X", None), (4, "Y", "4.1")],
                               "k int, site string, v string")
    got = {r.k: r.split for r in R.cohort_split(df, "k", "site", "X", "v", "4.2", validate=False).collect()}
    assert got == {1: "train", 2: "test"}


@pytest.mark.parametrize("fn,text,want", [
    (X.remove_measurements, "gave 5 mg", "gave "),
    (X.remove_measurements, "placed 3 stents", "placed 3 stents"),
    (X.remove_time_info, "Mayo examined on 2020-01-02 at 10:30pm", "Mayo examined on  at "),
    (X.history_sections, "no header here", "no header here"),
    (X.history_sections, "Intro. Past Medical History: CAD and HTN", " CAD and HTN"),
    (X.procedure_section, "X PROCEDURE: valve repair FINDINGS: ok", "valve repair"),
    (X.procedure_section, "nothing to see", ""),
    (X.procedure_after, "procedure: CABG", " CABG"),
    (X.first_integer, "Brand#17", "17"),
    (X.remove_dr_names, "seen by Dr. Smith today", "seen by  today"),
])
def test_text_steps(spark, fn, text, want):
    assert one(spark, fn, text) == want


def test_t9_cut(spark):
    text = " ".join(f"w{i}" for i in range(300))
    assert one(spark, lambda c: X.cut_words(c, 100), text) == " ".join(f"w{i}" for i in range(100))


def test_t10_merge_without_duplication(spark):
    df = spark.createDataFrame([(1, "Patient was stable overall. No pain.")], "k int, t string")
    rows = S.sentence_table(df, "k", "t", 3).collect()
    assert [r.sentence for r in rows] == ["Patient was stable overall. No pain."]


def test_t11_positional_bodies(spark):
    df = spark.createDataFrame([(1, "A: x B: y")], "k int, t string")
    rows = S.section_table(df, "k", "t").orderBy("sec_no").collect()
    assert [(r.header, r.body) for r in rows] == [("A", "x"), ("B", "y")]


def test_t15_named_sections_only(spark):
    df = spark.createDataFrame([(1, "DATE: d FINDINGS: f")], "k int, t string")
    assert S.remove_sections(df, "k", "t", ["DATE"]).collect()[0].report == "FINDINGS: f"


def test_t16_dict(spark):
    r = spark.createDataFrame([("{'k': 1}",)], "t string").select(X.parse_dict_string("t").alias("m")).collect()[0]
    assert r.m == {"k": "1"}


def test_t17_list(spark):
    r = spark.createDataFrame([("['a', 'b', '']",)], "t string").select(X.parse_list_string("t").alias("l")).collect()[0]
    assert r.l == ["a", "b"]


def test_t1_keywords(spark):
    assert one(spark, X.keywords, "The patient's EF was 55% - cannot walk; 3 cm mass, x-ray") == \
        "patients ef walk mass ray"


def test_t2_clean_report(spark):
    assert one(spark, X.clean_report, "Impression: No (old) stroke volume, EF 55%.\nNot seen") == "no not seen"


def test_cohort_build_carries_join_keys(spark):
    from regtext.plans.cohort import build_cohort
    notes = spark.createDataFrame(
        [(1, "H&P", "p1", "2020-01-01", 2, "second"), (1, "H&P", "p1", "2020-01-01", 1, "first"),
         (2, "H&P", "p2", "2020-02-02", 1, "Past Medical History: diabetes mellitus"),
         (3, "OTHER", "p1", "2020-01-01", 1, "ignored note type")],
        "K_NOTE_KEY long, IP_NOTE_DESC string, PAT_MRN_ID string, Surg_Dt string, LINE int, NOTE_TEXT string")
    reg = spark.createDataFrame([("p1", "2020-01-01", 1), ("p2", "2020-02-02", None)],
                                "PAT_MRN_ID string, Surg_Dt string, HX_x int")
    out = build_cohort(notes, reg, "K_NOTE_KEY", "IP_NOTE_DESC", "LINE", "NOTE_TEXT",
                       {"PAT_MRN_ID": "PAT_MRN_ID", "Surg_Dt": "Surg_Dt"}, ["HX_x"], descriptions=["H&P"],
                       sectionize=["medical history"], preprocess=False, split=None)
    got = {r.K_NOTE_KEY: (r.HX_x, r.text) for r in out.collect()}
    assert got == {1: (1, "first\nsecond"), 2: (0, " diabetes mellitus")}


def test_ingest_helpers(spark):
    df = spark.createDataFrame([(1.0, "2020-01-02 00:00:00.000000000"), (float("nan"), "2020-01-03")], "x double, d string")
    rows = P.nan_to_null(df).select("x", P.date_key("d").alias("d")).collect()
    assert rows[0].x == 1.0 and rows[1].x is None
    assert [str(r.d) for r in rows] == ["2020-01-02", "2020-01-03"]


def test_s4_code_features_zero_fill_and_dates(spark):
    from regtext.sources.notes import code_features
    df = spark.createDataFrame([("m1", "2020-01-02 00:00:00.000000000", "33533", 1),
                                ("m1", "2020-01-02 00:00:00.000000000", "33510", 2),
                                ("m2", "2021-05-06", "33510", 1)], "PAT_MRN_ID string, Surg_Dt string, code string, n int")
    out = {r.PAT_MRN_ID: r for r in code_features(df, "PAT_MRN_ID", "Surg_Dt", "code", "n", ["33510", "33533"]).collect()}
    assert str(out["m1"].Surg_Dt) == "2020-01-02" and out["m1"].CPT_33533 == 1 and out["m1"].CPT_33510 == 2
    assert out["m2"].CPT_33533 == 0


def test_a4_chunked_concat(spark):
    df = spark.createDataFrame([(1, "en", "Heart failure"), (2, "en", "Valve repair"), (1500, "en", "Later note")],
                               "doc_id long, lang string, text string")
    got = {(r.lang, r.chunk): r.corpus_text for r in A.grouped_text_concat(df, ["lang"], "doc_id", "text").collect()}
    assert got == {("en", 0): "heart failure valve repair", ("en", 1): "later note"}


def test_a13_subgroup_summary(spark):
    df = spark.createDataFrame([(i, 1 if i < 6 else 0, float(i)) for i in range(10)], "k long, flag int, y double")
    r = [x for x in A.subgroup_summary(df, "k", ["flag"], ["y"], fractions=(1.0,)).collect()][0]
    assert r.n == 6 and r.mean == pytest.approx(2.5) and r.std == pytest.approx(1.870829, abs=1e-6)


def test_p1_prefix_selection_and_substring_quirk(spark):
    df = spark.createDataFrame([(1, 1, 0, 5)], "PAT_MRN_ID int, SP_a int, HOSP_ID int, x int")
    assert P.select_by_prefix(df, ["SP_"], keep=["PAT_MRN_ID"]).columns == ["PAT_MRN_ID", "SP_a"]
    assert P.select_by_prefix(df, ["SP_"], substring=True).columns == ["SP_a", "HOSP_ID"]


def test_j2_drops_before_join_and_renames_clashes(spark):
    l = spark.createDataFrame([(1, "2020-01-01", 1, "a")], "m int, d string, SP_x int, note string")
    r = spark.createDataFrame([(1, "2020-01-01", 1, 0, "b")], "m int, d string, PREOP_y int, HX_z int, note string")
    out = P.join_dropping(l, r, ["m", "d"], drop_left=["SP_x"], drop_right_prefixes=["PREOP_", "SP_"])
    assert sorted(out.columns) == ["HX_z", "d", "m", "note", "note_right"]


def test_j4_join_without_forced_strategy(spark):
    facts = spark.range(100).withColumnRenamed("id", "k")
    dim = spark.range(10).withColumnRenamed("id", "k")
    out = P.join_small_dimension(facts, dim, ["k"])
    assert out.count() == 10 and "strategy=broadcast" not in out._jdf.queryExecution().optimizedPlan().toString().lower()


def test_a6_top_terms_ties_by_token(spark):
    freq = spark.createDataFrame([("the", 9), ("b", 3), ("a", 3), ("c", 1)], "token string, n long")
    got = [r.token for r in A.top_terms(freq, 2, ["the"]).collect()]
    assert got == ["a", "b"]


def test_a7_word_counts(spark):
    df = spark.createDataFrame([("the cat the hat",)], "t string")
    r = A.word_counts(df, "t").collect()[0]
    assert (r.n_words, r.n_distinct_words) == (4, 3)


def test_s2_exclusive_note_types(spark):
    from regtext.sources.notes import NoteSource, route_sources
    a = spark.createDataFrame([("op", 1)], "src string, k int")
    b = spark.createDataFrame([("full", 2)], "src string, k int")
    c = spark.createDataFrame([("hp", 3)], "src string, k int")
    reg = {"operative_report": NoteSource(lambda: a, "op", 2), "op_notes": NoteSource(lambda: b, "op", 1),
           "h&p": NoteSource(lambda: c)}
    got = sorted(r.src for r in route_sources(reg, ["op_notes", "operative_report", "h&p"]).collect())
    assert got == ["hp", "op"]
