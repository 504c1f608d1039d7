import re
from collections import Counter

from regtext.llm import licenses as L

from .data import awkward_rows, docs, table, with_clashes


def norm(text):
    t = re.sub(r"(?m)^[ \t]*(?:copyright\b|\(c\)|©|all rights reserved)[^\n]*$", "", (text or "").lower())
    for a, b in L.EQUIVALENT:
        t = t.replace(a, b)
    return re.sub(r"[\x00-\x09\x0b-\x2f\x3a-\x60\x7b-\x7f ©‐-―‘-‟•…]+", " ", t)


def flat(u):
    return re.sub(r"[ \n]+", " ", u).strip(" ")


def brute(rows, known):
    names = {}
    for n, t in known:
        names.setdefault(flat(norm(t)), set()).add(n)
    out = Counter()
    for d, text in rows:
        t = norm(text)
        units = [("document", flat(t))] + [("block", flat(b)) for b in re.split(r"\n(?: *\n)+", t)] + [("line", x.strip(" ")) for x in t.split("\n")]
        for scope, u in units:
            for n in names.get(u, ()) if u else ():
                out[d, scope, n] += 1
    return sorted(repr((*k, v)) for k, v in out.items())


def sample(spark):
    mit = next(t for n, t in L.KNOWN if n == "MIT" and "\n" in t)
    rows = [(r[0], r[1]) for r in awkward_rows()] + [
        (800, "MIT License\n\nCopyright (c) 2020 Somebody\n\n" + mit), (801, "  copyright 1999, me\n" + mit.upper().replace(" ", "  ")),
        (802, mit.replace("sublicense", "sub-license")), (803, "Intro.\n\nReleased under the MIT licence!\n\nMore."),
        (804, "x\nLicensed under “CC BY-NC 4.0”\ny\nlicensed under cc by nc 4.0"), (805, mit + " extra"), (None, "Released under the MIT License."),
        (806, "Released under the MIT License."), (806, "Released under the MIT License."), (807, "no licence here"),
        (808, mit + "\n\n" + ("word " * 50000))]
    return rows, docs(spark, [(d, t, "en", "a", 0) for d, t in rows])


def test_equals_brute_force(spark):
    rows, df = sample(spark)
    got = table(L.scan(with_clashes(df), L.known_table(spark)))
    assert got == brute(rows, L.known_rows())
    hit = {(eval(x)[0], eval(x)[1]) for x in got}
    assert {(800, "document"), (801, "document"), (802, "document"), (803, "block"), (804, "line"), (None, "document")} <= hit
    assert not any(d in (805, 807) for d, _ in hit)


def test_other_known_texts_and_empty_tables(spark):
    rows, df = sample(spark)
    known = spark.createDataFrame([("own", "No, licence: HERE"), ("twin", "no license here"), ("blank", " !! "), ("null", None)], "license string, text string")
    assert table(L.scan(df, known)) == sorted(repr((807, s, n, 1)) for s in ("document", "block", "line") for n in ("own", "twin"))
    assert L.scan(df.limit(0), known).count() == 0 and L.scan(df, known.limit(0)).count() == 0
