"""Text steps on adversarial random strings: the Spark expressions and the independent DuckDB SQL
must agree (regex dialects differ: Java vs RE2)."""

import random
import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from regtext.functions import constants as K
from regtext.functions import text as X
from regtext.operators import sections as S
from regtext.plans import oracle as O

PIECES = ["a", "b", "Z", "é", "ß", "ü", "中", " ", "  ", "\n", "\t", ".", ",", "-", "'", "(", ")", "[", "]", "/",
          "5", "12", "3.5", "mg", "cm", "ml", "%", " mg", " kg", "May", "march", "am", "pm", "10:30", "2020-01-02",
          "12/03/2021", "history", "History of", "PMH:", "HPI", "stroke volume", "net forward volume", "ef", "the",
          "not", "no", "cannot", "wanna", "dr. Smith", "a.b", "x.", "..", "physician", "fax", "ohio", "#", "+", "_",
          "Result:", "impression:", "overall", " ", " ", "!", "?", "A: ", "NOTE:", "*"]

STEPS = [
    ("keywords", X.keywords, O.keywords),
    ("clean_report", X.clean_report, O.clean_report),
    ("nondiagnostic", X.nondiagnostic, O.nondiagnostic),
    ("measurements", X.remove_measurements, O.remove_measurements),
    ("time", X.remove_time_info, O.remove_time_info),
    ("history", X.history_sections, O.history_sections),
    ("sentences", lambda c: F.array_join(X.strip_punctuation(X.sentences(c)), "|"),
     lambda x: f"array_to_string(list_transform({O.sentences(x)}, lambda s: translate(s, {O.q(O.K.PUNCTUATION)}, '')), '|')"),
    ("lines", lambda c: F.array_join(X.lines(c), "|"),
     lambda x: f"array_to_string(list_filter(regexp_split_to_array({O.rr('lower(' + x + ')', '^' + X.PY_SPACE + '+|' + X.PY_SPACE + '+$')}, "
               f"{O.q(X.PY_LINE_BREAK)}), lambda w: w <> ''), '|')"),
    ("cut_words", lambda c: X.cut_words(c, 5),
     lambda x: f"CASE WHEN len({O.py_split(x)}) <= 5 THEN {x} ELSE array_to_string(list_slice({O.py_split(x)}, 1, 5), ' ') END"),
    ("unicode_words", lambda c: F.array_join(X.unicode_words(c), "|"), lambda x: f"array_to_string({O.unicode_words(x)}, '|')"),
]


def strings(seed, n=250):
    rng = random.Random(seed)
    return [("".join(rng.choice(PIECES) for _ in range(rng.randint(0, 25))),) for _ in range(n)]


@pytest.mark.parametrize("name,spark_fn,sql_fn", STEPS, ids=[s[0] for s in STEPS])
def test_spark_matches_duckdb(spark, name, spark_fn, sql_fn):
    rows = [r for k in range(4) for r in strings(zlib.crc32(name.encode()) + k)]
    df = spark.createDataFrame([(i, t) for i, (t,) in enumerate(rows)], "id long, text string")
    got = {r.id: r.o for r in df.select("id", spark_fn(F.col("text")).alias("o")).collect()}
    con = duckdb.connect()
    con.execute("CREATE TABLE t (id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO t VALUES (?, ?)", [(i, t) for i, (t,) in enumerate(rows)])
    want = dict(con.execute(f"SELECT id, {sql_fn('text')} FROM t").fetchall())
    bad = [(rows[i][0], got[i], want[i]) for i in got if got[i] != want[i]]
    assert not bad, bad[:5]

MORE = [
    ("procedure_after", X.procedure_after, O.procedure_after),
    ("first_integer", X.first_integer, O.first_integer),
]


@pytest.mark.parametrize("name,spark_fn,sql_fn", MORE, ids=[s[0] for s in MORE])
def test_more_steps(spark, name, spark_fn, sql_fn):
    test_spark_matches_duckdb(spark, name, spark_fn, sql_fn)


def test_remove_sections_matches(spark):
    from regtext.operators.sections import remove_sections
    rows = [r for k in range(3) for r in strings(zlib.crc32(b"sections") + k)]
    df = spark.createDataFrame([(i, t) for i, (t,) in enumerate(rows)], "id long, text string")
    got = {r.id: r.report for r in remove_sections(df, "id", "text").collect()}
    con = duckdb.connect()
    con.execute("CREATE TABLE t (id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO t VALUES (?, ?)", [(i, t) for i, (t,) in enumerate(rows)])
    want = dict(con.execute(f"SELECT id, {O.remove_sections('text')} FROM t").fetchall())
    bad = [(rows[i][0], got[i], want[i]) for i in got if got[i] != want[i]]
    assert not bad, bad[:5]


def test_cleaning_steps_use_quick_classes_and_few_passes(spark):
    """A negated union of ranges took ten times a table class; every translate() and filter() is a pass over the text."""
    df = spark.createDataFrame([("a",)], "t string")
    expr = lambda c: df.select(c.alias("c"))._jdf.queryExecution().analyzed().toString()
    kw, nd = expr(X.keywords("t")), expr(X.nondiagnostic("t"))
    assert "[^A-Za-z0-9 ]" not in kw and "[^.,a-zA-Z ]" not in nd
    assert kw.count("translate(") == 1 and kw.count("filter(") == 3 and nd.count("translate(") == 0
    texts = ["", None, "wanna", "wanna ", "wanna é", "wanna go, cannot!", "x-1y 5cm (ok) Ä.b a.b", "12:30pm May_ mAY am Am 3/4/2020",
             "PMH: a hpi Comorbidities b", "physician x ohio y", "contact information\tfax", "a\x85b　cm \U0001d49c"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [tuple(r) for r in rows.select(X.keywords("t"), X.nondiagnostic("t"), F.split(X.history_sections("t"), " ")).collect()]
    con = duckdb.connect()
    want = [con.execute(f"SELECT {O.keywords('t')}, {O.nondiagnostic('t')}, string_split({O.history_sections('t')}, ' ') FROM (SELECT ?::VARCHAR AS t)", [t]).fetchone() for t in texts]
    assert got == want


def test_look_aheads_and_guards_change_no_text(spark):
    """A look-ahead of one class per place passes every word; what is guarded by a search runs where it is found."""
    for words, any_case in ((K.MONTHS, True), (["can", "wan"], False), (["hx", "pmh"], False)):
        begin = re.compile(X.begins_like(words, any_case))
        assert all(begin.match(w) and (not any_case or (begin.match(w.upper()) and begin.match(w.title()))) for w in words)
        assert not begin.match("xyz") and not begin.match("")
    texts = ["stroke volume cardiac index stroke volume", "lv lv mass mass cardiac output", "net forward volume physician a fax b oh",
             "contact information physician fax z ohio", "history physician history oh x", "a MAY b mayo Sept september SEPTEMBER", "amp am 5pm AM. pM",
             "hx: Pm PMHx Principal Diagnosis x", "a.b .c d. e f", "heart vascular institute x ohio", "w" * 9000, None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [tuple(r) for r in rows.select(X.nondiagnostic("t"), X.remove_time_info("t"), F.split(X.history_sections("t"), " ")).collect()]
    con = duckdb.connect()
    want = [con.execute(f"SELECT {O.nondiagnostic('t')}, {O.remove_time_info('t')}, string_split({O.history_sections('t')}, ' ') FROM (SELECT ?::VARCHAR AS t)", [t]).fetchone() for t in texts]
    assert got == want


def test_sentences_are_counted_without_splitting_them(spark):
    """No pattern is compiled or table looked up per sentence: a sentence's words are counted by one search."""
    df = spark.createDataFrame([("a",)], "t string")
    plan = df.select(S.merged_sentences("t").alias("c"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("split(") == 1 and plan.count("translate(") == 0
    texts = ["one two three. a b. c d e! x\u3000y\x85z? q", "a. b c. d e f.", "a b\n\n \n\x1c\nc d e", "", " . ", "w" * 50_000 + " x", "a\xa0b c. d\u2003e f"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    for n in (0, 1, 2, 3):
        got = [r[0] for r in rows.select(S.merged_sentences("t", n)).collect()]
        for t, g in zip(texts, got):
            parts = [p for p in re.split(r"(?<=[.!?])[ \t\n\x0b\f\r]+|\n+", t) if p.strip()]
            want = []
            for p in parts:
                if want and len(p.split()) < n:
                    want[-1] += " " + p
                else:
                    want.append(p)
            assert g == want, (n, t[:40])
