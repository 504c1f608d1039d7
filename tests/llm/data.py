"""Small tables with awkward rows, shared by the operator tests."""

import random

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rnd, n, vocab=400):
    return " ".join(f"w{rnd.randrange(vocab)}" + rnd.choice(["", "", "", ",", ".\n"]) for _ in range(n))


def awkward_rows(seed=5, n=40):
    """Ordinary texts plus NULLs, empty and blank texts, a long text, ties and repeated rows."""
    rnd = random.Random(seed)
    rows = [(i, prose(rnd, rnd.randint(1, 120)), rnd.choice(["en", "de", None]), rnd.choice(["a", "b", None]), 0) for i in range(n)]
    rows += [rows[3], rows[3], (n + 1, rows[4][1], "en", "a", 0), (n + 2, None, "en", "a", None), (n + 3, "", None, None, 0),
             (n + 4, " \n\t ", "de", "b", 0), (None, rows[5][1], "en", "a", 0), (None, None, None, None, None),
             (None, "only here " + prose(rnd, 30), "en", "c", 0), (n + 5, prose(rnd, 20000), "en", "a", 0),
             (n + 6, "Ünï çødé É " * 30, "fr", "a", 0), (n + 7, "same line\n" * 300, "fr", "a", 0)]
    return rows


def docs(spark, rows=None):
    return spark.createDataFrame(awkward_rows() if rows is None else rows, DOC_SCHEMA)


def with_clashes(df):
    """Extra columns named like the operators' own."""
    from pyspark.sql import functions as F
    for c in ("id", "th", "lines", "features", "kept", "fingerprint", "fp", "rn", "found", "gone_", "words_", "key", "root", "b", "h"):
        df = df.withColumn(c, F.lit("x"))
    return df


def table(df):
    return sorted(map(repr, map(tuple, df.collect())))
