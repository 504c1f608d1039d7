import hashlib

import pytest
from pyspark.sql import functions as F

from regtext.llm import exactdedup as X

from .data import awkward_rows, docs, table, with_clashes

FOLD = str.maketrans(X.UPPER, X.LOWER)


def brute(rows, largest=False):
    groups = {}
    for i, t in rows:
        groups.setdefault((t or "").translate(FOLD), []).append(i)
    out = []
    for t, ids in groups.items():
        some = [i for i in ids if i is not None]
        best = (max if largest else min)(some) if some else None
        sha, done = hashlib.sha256(t.encode()).hexdigest(), False
        for i in ids:
            out.append((i, best, len(ids), i == best and not done, sha))
            done = done or i == best
    return sorted(map(repr, out))


def cased(rows):
    """Copies that differ in case: ASCII case only makes copies, other letters do not."""
    return rows + [(900 + k, t, "en", "a", 0) for k, t in enumerate(["Same TEXT", "same text", "SAME text ", "É same", "é same", "K", "k", "K"])]


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_equals_brute_force(spark, keep):
    rows = cased(awkward_rows())
    got = X.exact_groups(with_clashes(docs(spark, rows)), keep=keep)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert table(got) == brute([(r[0], r[1]) for r in rows], keep == "largest")


@pytest.mark.parametrize("keep", ["smallest", "largest"])
def test_hot_texts_are_split_and_summed(spark, keep):
    """A text with over half of all bytes, and one of NULL and empty texts, spread over several ranges."""
    rows = awkward_rows() + [(1000 + i, "one very common text " * 40, "en", "a", 0) for i in range(400)]
    rows += [(2000 + i, None if i % 2 else "", "en", "a", 0) for i in range(300)] + [(None, "one very common text " * 40, "en", "a", i) for i in range(5)]
    df = docs(spark, rows)
    keyed = df.select(X.normalised(F.col("text")).alias("t")).withColumn("h", F.xxhash64("t"))
    heavy = X._heavy(keyed, 4).collect()
    assert 0 < len(heavy) < 4 and all(r.salts > 1 for r in heavy)
    assert table(X.exact_groups(df, keep=keep)) == brute([(r[0], r[1]) for r in rows], keep == "largest")


def test_equal_hashes_do_not_make_copies(spark, monkeypatch):
    """With every text in one hash, the whole texts still tell them apart."""
    rows = awkward_rows()
    monkeypatch.setattr(X.F, "xxhash64", lambda *c: F.lit(7).cast("long"))
    assert table(X.exact_groups(docs(spark, rows))) == brute([(r[0], r[1]) for r in rows])


def test_keep_one_passes_rows_on(spark):
    rows = cased(awkward_rows()) + [(3000 + i, "common " * 300, "en", "a", i) for i in range(200)] + [(3000, "common " * 300, None, "z", 9)]
    df = with_clashes(docs(spark, rows))
    for keep, best in (("smallest", min), ("largest", max)):
        got = X.keep_one(df, keep=keep)
        assert got.columns == df.columns
        kept = [tuple(r)[:5] for r in got.collect()]
        assert set(map(repr, kept)) <= set(map(repr, rows))
        folded = [(r[1] or "").translate(FOLD) for r in kept]
        assert len(folded) == len(set(folded)) and set(folded) == {(r[1] or "").translate(FOLD) for r in rows}
        by_text = {}
        for r in rows:
            by_text.setdefault((r[1] or "").translate(FOLD), []).append(r[0])
        for r, t in zip(kept, folded):
            some = [i for i in by_text[t] if i is not None]
            assert r[0] == (best(some) if some else None)


def test_long_openings_and_empty_table(spark):
    rows = [(i, "x" * 5000 + str(i % 7), "en", "a", 0) for i in range(60)]
    assert table(X.exact_groups(docs(spark, rows))) == brute([(r[0], r[1]) for r in rows])
    assert X.exact_groups(docs(spark, [])).count() == 0
    assert X.keep_one(docs(spark, [])).count() == 0


def test_texts_move_once(spark):
    """One range exchange carries the texts; no Python on the path."""
    df = X.exact_groups(docs(spark, [(i, f"text {i}", "en", "a", 0) for i in range(50)]))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("rangepartitioning(") == 1 and "Python" not in plan and "hashpartitioning" not in plan
