"""Longest shared passages by seeds (J7) against brute force; lemmas through a table."""

import random

import pytest
from pyspark.sql import functions as F

from regtext.functions import text as X
from regtext.operators import cleaning as C
from regtext.operators import pairs as J

from .data import table


def brute(a, b, k):
    out = []
    for i, s in a:
        for j, t in b:
            x, y = s.split(), t.split()
            best = None
            for p in range(len(x)):
                for q in range(len(y)):
                    n = 0
                    while p + n < len(x) and q + n < len(y) and x[p + n] == y[q + n]:
                        n += 1
                    if n >= k and (best is None or (-n, p, q) < best):
                        best = (-n, p, q)
            if best:
                out.append((i, j, best[1], best[2], -best[0]))
    return sorted(map(repr, out))


def shared(spark, a, b, k):
    return J.longest_shared_passage(spark.createDataFrame(a, "id long, t string"), "id", "t", spark.createDataFrame(b, "item long, t string"), "item", "t", k=k)


@pytest.mark.parametrize("k", [1, 2, 3, 5, 8])
def test_equals_brute_force(spark, k):
    """Few words, so that runs of every length touch, overlap, repeat and end at either end of a text."""
    rnd = random.Random(k)
    vocab = [f"w{i}" for i in range(3 if k > 4 else 12)]
    texts = lambda n: [(i, " ".join(rnd.choice(vocab) for _ in range(rnd.randint(0, 40)))) for i in range(n)]
    a, b = texts(25), texts(20)
    b += [(100 + i, " ".join(a[i][1].split()[3:17])) for i in range(10)] + [(200, a[0][1]), (201, "x " * 50)]
    a += [(300, "x " * 37), (301, "y " + "x " * 20 + "z"), (302, "")]
    assert table(shared(spark, a, b, k)) == brute(a, b, k)


def test_a_gram_in_half_of_all_texts(spark):
    """A common phrase of seed length stands in every second text; runs of k words are found through rarer seeds, and
    far fewer seeds meet than the texts have grams."""
    rnd = random.Random(9)
    words = lambda n: [f"v{rnd.randrange(5000)}" for _ in range(n)]
    common, runs = "in the case of the".split(), [words(9) for _ in range(6)]
    a, b = [], []
    for side, n in ((a, 300), (b, 60)):
        for i in range(n):
            ws = words(60)
            if i % 2:
                ws[20:20] = common
            if i % 10 == 0:
                at = rnd.randrange(60)
                ws[at:at] = runs[i // 10 % 6] if i % 20 else common + runs[i // 10 % 6]
            side.append((i, " ".join(ws)))
    got = shared(spark, a, b, 8)
    assert table(got) == brute(a, b, 8) and got.count() >= 25
    w, g = 4, 5
    fa, fb = (spark.createDataFrame(r, "id long, t string") for r in (a, b))
    hb = J._hashed(fb, "id", "t", 8, g, "word")
    sa, sb = (J._seeds(h, J._rarity(hb), g, w) for h in (J._hashed(fa, "id", "t", 8, g, "word"), hb))
    grams = sum(len(t.split()) - g + 1 for _, t in a)
    met = sa.alias("x").join(sb.alias("y"), ["g1", "g2"]).count()
    both = sum(c in t for _, t in a for c in [" ".join(common)]) * sum(" ".join(common) in t for _, t in b)
    assert sa.count() < grams / 4 and met < both / 4  # the pairs of texts that share the phrase alone do not meet


def test_no_text_is_read_twice(spark):
    df = shared(spark, [(1, "a b c")], [(2, "a b c")], 2)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Join") == 1 and "Python" not in plan


def test_lemmas_equal_a_dictionary(spark):
    rnd = random.Random(3)
    lemmas = [("walking", "verb", "walk"), ("walked", "verb", "walk"), ("sees", "verb", "see"), ("sees", "noun", "se"), ("left", "verb", "leave"),
              ("left", "verb", "lay"), ("same", "verb", "same"), ("none", "verb", None), ("unused", "verb", "use")]
    words = ["walking", "walked", "sees", "left", "same", "none", "other", "walk", ""]
    rows = [(i, " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 12)))) for i in range(60)] + [(60, None), (3, "walked"), (None, "left sees"), (None, "x")]
    df = spark.createDataFrame(rows, "k long, t string").withColumn("word", F.lit(1))
    table_ = spark.createDataFrame(lemmas, "word string, word_class string, lemma string")
    for cls in ("verb", "noun", None):
        best = {}
        for w, c, l in lemmas:
            if l is not None and l != w and cls in (c, None):
                best[w] = min(best.get(w, l), l)
        got = C.lemmatise(df, "k", "t", table_, cls)
        assert got.columns == ["k", "t", "word"]
        want = [(k, None if t is None else " ".join(best.get(w, w) for w in t.split(" ")), 1) for k, t in rows]
        assert table(got) == sorted(map(repr, want))
    assert C.lemmatise(df.limit(0), "k", "t", table_).count() == 0 and table(C.lemmatise(df, "k", "t", table_.limit(0))) == table(df)


def test_keywords_with_lemmas(spark):
    df = spark.createDataFrame([(1, "The patients walked - walking, sees 3 cm x-ray"), (2, None), (3, "")], "k long, t string")
    rules = C.attested_lemmas(spark.createDataFrame([(w,) for w in "walk walked walking see sees patients patient bed".split()], "word string"),
                              {"verb": ("ing", "ed", "s"), "noun": ("s",)})
    assert table(rules) == sorted(map(repr, [("walked", "verb", "walk"), ("walking", "verb", "walk"), ("sees", "verb", "see"), ("patients", "verb", "patient"),
                                             ("sees", "noun", "see"), ("patients", "noun", "patient")]))
    got = {r.k: r.keywords for r in C.keywords_with_lemmas(df, "k", "t", rules).collect()}
    plain = {r.k: r.x for r in df.select("k", X.keywords("t").alias("x")).collect()}
    assert got[1].split() == [{"walked": "walk", "walking": "walk", "sees": "see", "patients": "patient"}.get(w, w) for w in plain[1].split()]
    assert got[2] is None and got[3] == ""


def test_lemmas_are_written_before_tokens_are_dealt(spark):
    df = spark.createDataFrame([(1, "walking walk  walking"), (2, "talk talking x"), (3, None), (None, "walking")], "k long, t string")
    words = C.distinct_words(df, "t")
    assert sorted(r.word for r in words.collect()) == ["talk", "talking", "walk", "walking", "x"]
    lemmas = C.attested_lemmas(words, {"verb": ("ing",)})
    for got in (C.lemmatise(df, "k", "t", lemmas, "verb"), C.lemmatise(df, "k", "t", lemmas, "verb", words)):
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Generate explode") == 1 and "LeftSemi" not in plan
        assert {(r.k, r.t) for r in got.collect()} == {(1, "walk walk  walk"), (2, "talk talk x"), (3, None), (None, "walk")}
