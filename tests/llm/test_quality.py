import math
import re

from pyspark.sql import functions as F

from regtext.llm import quality as Q

from .data import awkward_rows, docs, table, with_clashes

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    t = text or ""
    ws = WORD.findall(t)
    where = {}
    for i in range(len(ws) - 7):
        where.setdefault(tuple(ws[i:i + 8]), []).append(i)
    covered = {p + k for ps in where.values() if len(ps) > 1 for p in ps for k in range(8)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return (len(ws), sum(map(len, ws)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered),
            len(ws) < 20 or 100 * len(covered) > 30 * len(ws))


def test_base_counts_equal_brute_force(spark):
    rows = awkward_rows() + [(900, "a b c d e f g h " * 3 + "#*$ %%", "en", "a", 0), (901, "x " * 50, "en", "a", 0),
                             (902, "a b c d e f g h i a b c d e f g h j k a b c d e f g h", "en", "a", 0)]
    got = Q.features(docs(spark, rows), ["doc_id", "text"]).select("doc_id", "text", *[f"features.{c}" for c in (
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")])
    assert table(got) == sorted(repr((r[0], r[1], *brute(r[1]))) for r in rows)


def test_binomial_tail_is_exact(spark):
    cases = [(n, k, p) for p in (0.01, 0.05, 0.3) for n, k in ((1, 0), (10, 0), (100, 1), (1000, 5), (5000, 30), (200000, 1700))]
    for p in (0.01, 0.05, 0.3):
        mine = [(n, k) for n, k, q in cases if q == p]
        got = spark.createDataFrame(mine, "n long, k long").select("n", "k", Q.binomial_tail(F.col("n"), F.col("k"), p).alias("t"))
        for n, k, t in got.collect():
            want = math.fsum(math.exp(math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1) + j * math.log(p)
                                      + (n - j) * math.log1p(-p)) for j in range(k + 1)) if k < n * p else 1.0
            assert math.isclose(t, want, rel_tol=1e-7, abs_tol=1e-300), (n, k, p, t, want)
    short = spark.range(1).select(Q.binomial_tail(F.lit(200000), F.lit(9000), 0.05, terms=50).alias("a"),
                                  Q.binomial_tail(F.lit(200000), F.lit(9000), 0.05, terms=9000).alias("b")).first()
    assert short.a >= short.b > 0  # shortening errs on the safe side


def labelled(spark, n=8000):
    good = " ".join(f"word{i}" for i in range(40))
    bad = good + " " + " ".join(f"%%%###{i}" for i in range(30))
    rows = [(i, bad if i % 4 == 0 else good, "en" if i % 2 == 0 else "de", "a", 0) for i in range(n)]
    labels = spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(n)], "doc_id long, quality int, toxic int")
    return docs(spark, rows), labels


def test_cutoffs_certified_and_false_rejection_limited(spark):
    d, labels = labelled(spark)
    scored = Q.features(d, ["doc_id", "lang"])
    cuts = {r.stratum: r for r in Q.calibrate(scored, labels).collect()}
    assert cuts["en"].n_good == 2000 and cuts["de"].n_good == 4000
    assert cuts["de"].cut.symbols is not None and cuts["en"].cut.symbols is not None
    kept = Q.judge(scored, Q.calibrate(scored, labels)).join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int"))).collect()
    assert dict(map(tuple, kept)) == {0: 0.0, 1: 1.0}


def test_too_few_labels_certify_nothing(spark):
    d, labels = labelled(spark, 40)
    scored = Q.features(d, ["doc_id", "lang"])
    assert all(v is None for r in Q.calibrate(scored, labels).collect() for v in r.cut)
    assert Q.judge(scored, Q.calibrate(scored, labels)).filter("NOT kept AND NOT features.base_failed").count() == 0


def test_awkward_labels_tables_and_columns(spark):
    d = docs(spark)
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 1), (2, 1), (None, 1), (3, None)], "doc_id long, quality int")
    scored = Q.features(d, ["doc_id", "lang"])
    assert sum(r.n_good for r in Q.calibrate(scored, labels).collect()) == 1  # only document 2
    kept = Q.filter_documents(d, labels)
    assert kept.columns == d.columns
    want = sorted(repr(r) for r in awkward_rows() if not brute(r[1])[-1])
    assert table(kept) == want
    clash = Q.filter_documents(with_clashes(d), labels)
    assert clash.columns == with_clashes(d).columns and table(clash.select(*d.columns)) == want
    assert Q.filter_documents(d.limit(0), labels).count() == 0
    assert Q.filter_documents(d, labels.limit(0)).count() == len(want)
