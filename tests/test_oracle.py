"""Every registered query against its DuckDB oracle (sf0.001); queries without one must run."""

from tools.oracle_check import compare

from .conftest import SF_SMALL


def test_all_queries_match_oracle(spark):
    res = compare(spark, SF_SMALL, verbose=False)
    bad = {k: v for k, v in res.items() if not (v.startswith("ok") or v == "no-oracle")}
    assert not bad, bad


def test_queries_without_oracle_run(spark):
    import __spark_entry__ as E
    sql = E.oracle_sql()
    for k, fn in E.queries().items():
        if k not in sql:
            assert fn(spark, SF_SMALL).count() >= 0, k


def test_entry_smoke(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns == ["conv_id", "role", "cleaned", "n_words", "n_distinct_words"]
