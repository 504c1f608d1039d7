"""Plan shape checks: text operators stay JVM-side; order statistics never funnel rows into one task;
scans read only the needed columns."""

import re

import pytest

from .conftest import SF_SMALL

TEXT_QUERIES = ["t1_keywords", "t2_clean_report", "t3_nondiagnostic", "t4_measurements", "t5_time_info",
                "t6_dr_names", "t7_strip_punctuation", "t8_line_table", "t9_cut_words", "t10_sentence_table",
                "t11_section_table", "t12_history_filter", "t13_procedure_section", "t14_procedure_after",
                "t15_remove_sections", "t16_dict_column", "t17_list_column", "t18_first_integer", "t19_flatten",
                "t20_cleaning_chain", "j6_abbrev_expand", "a5_token_frequency"]
NO_SINGLE_PARTITION = ["r1_random_split", "r2_cohort_split", "m4_pr_curve", "m8_roc_auc", "j7_longest_shared_passage",
                       "a2_note_concat", "t10_sentence_table", "a1_keyed_dedup", "m7_optimal_threshold",
                       "a3_sort_group_concat"]


def plan(spark, key):
    import __spark_entry__ as E
    df = E.queries()[key](spark, SF_SMALL)
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("key", TEXT_QUERIES)
def test_no_python_in_text_plans(spark, key):
    p = plan(spark, key)
    assert not any(x in p for x in ("BatchEvalPython", "ArrowEvalPython", "PythonUDF", "MapInPandas")), key


@pytest.mark.parametrize("key", NO_SINGLE_PARTITION)
def test_no_single_partition_exchange(spark, key):
    p = plan(spark, key)
    assert "SinglePartition" not in p and "TakeOrderedAndProject" not in p, key
    # a window without a partition would put its whole input in one task
    assert not re.search(r"Window \[[^\n]*windowspecdefinition\((?!\w+#)[^\n]*\], \[[^\]]*(ASC|DESC)[^\]]*\]\s*$", p, re.M), key


def test_generators_do_not_copy_text_into_scan_filters(spark):
    for key in ("j7_longest_shared_passage", "t8_line_table", "t19_flatten", "a5_token_frequency"):
        p = plan(spark, key)
        # an inferred size(...) > 0 filter over the text expression would show up under the scan
        assert not re.search(r"Filter \(\(?size\(", p), key


def test_pruned_scans(spark):
    import __spark_entry__ as E
    df = E.queries()["r1_random_split"](spark, SF_SMALL)
    s = df._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "ReadSchema: struct<doc_id:bigint>" in s
    df = E.queries()["s1_note_scan"](spark, SF_SMALL)
    s = df._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "PushedFilters: [IsNotNull(text), In(role, [assistant,user])]" in s


def test_vocabulary_and_blocks_in_ranges_use_no_single_task(spark):
    """Tables of more than one range (a single range is one task by definition)."""
    from regtext.functions import text as X
    from regtext.operators import tokens as TK
    from regtext.plans.tables import table
    d = table(spark, SF_SMALL, "documents")
    vocab = TK.build_vocabulary(d, "text", rows_per_range=1000)
    blocks = TK.pack_blocks(TK.to_ids(d, "doc_id", X.unicode_words("text"), vocab), "doc_id", "ids", 512, rows_per_range=50)
    for df in (vocab, blocks):
        p = df._jdf.queryExecution().executedPlan().toString()
        assert "SinglePartition" not in p and "TakeOrderedAndProject" not in p
