import hashlib
import random
import re

from pyspark.sql import functions as F

from regtext.llm import secrets as S

from .data import awkward_rows, docs, with_clashes

ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base(text):
    t, out = text or "", []
    out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[1]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m[0]) >= 32]
    return sorted(out)


def texts():
    rnd = random.Random(4)
    rand = lambda n, chars: "".join(rnd.choice(chars) for _ in range(n))
    hexa, mixed = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    words = ["the", "connection", "handler", "returns", "value", "configuration", "manager", "identifier", "factory", "some", "long", "name"]
    bits = ["password=", "Token = '", "api_key:", "APIKEY\"=", "secret", " : ", "AKIA", "é😀", "\n", " ", "=", "'", ".", "ſ", "K"]
    out = [(r[0], r[1]) for r in awkward_rows()]
    for i in range(200):
        parts = [rnd.choice([rnd.choice(bits), rnd.choice(words), rand(rnd.randint(1, 50), hexa), rand(rnd.randint(1, 30), mixed),
                             rand(rnd.randint(8, 24), "ABCDEF0123456789")]) for _ in range(rnd.randint(1, 30))]
        out.append((1000 + i, "".join(parts) if i % 2 else " ".join(parts)))
    out += [(3000 + i, " ".join(words)) for i in range(3)] + [(3100 + i, f"password={rand(30, mixed)}") for i in range(60)]
    out += [(2000, "secret=token: abcdefgh password= secret=abcdefgh"), (2001, "password=short AKIA1234567 " + "a" * 31), (2002, "0" * 32 + "g" + "f" * 100),
            (2003, ("deadbeef" * 4 + " ") * 2500), (2004, "x9Qk2LmZp8RtVw3YbN7cTq some_long_identifier_name connectionHandlerFactory"),
            (2005, "key " + rand(40, mixed)), (2005, "key " + rand(40, mixed))]
    return out


def test_base_spans_equal_brute_force(spark):
    rows = texts()
    got = S.find(with_clashes(docs(spark, [(d, t, "en", "a", 0) for d, t in rows])).withColumn("t2", F.col("text")))
    have = sorted(repr((r.doc_id, [(s.start, s.kind, s.end) for s in r.spans if s.kind < 3])) for r in got.collect())
    assert have == sorted(repr((d, base(t))) for d, t in rows)


def test_added_spans_are_random_tokens_beside_the_base(spark):
    rows = dict(texts())
    out = {r.doc_id: r.spans for r in S.find(docs(spark, [(d, t, "en", "a", 0) for d, t in rows.items()])).collect()}
    values = lambda d: [s.value for s in out[d] if s.kind == 3]
    assert values(2004) == ["x9Qk2LmZp8RtVw3YbN7cTq"]
    for d, spans in out.items():
        for s in spans:
            if s.kind == 3:
                assert rows[d][s.start:s.end] == s.value
                assert not any(b.kind < 3 and b.start < s.end and s.start < b.end for b in spans)
        assert [(s.start, s.kind) for s in spans] == sorted((s.start, s.kind) for s in spans)


def test_held_out_accuracy(spark):
    rnd = random.Random(9)
    rand = lambda n: "".join(rnd.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(n))
    syll = ["con", "nec", "tion", "hand", "ler", "re", "turn", "val", "ue", "man", "ag", "er", "iden", "ti", "fi", "get", "set"]
    known = ["".join(rnd.choice(syll) for _ in range(rnd.randint(6, 9))) for _ in range(300)]
    ident = lambda: rnd.choice(known)
    unseen = lambda: "".join(rnd.choice(syll) for _ in range(rnd.randint(6, 9)))
    rows = [(i, f"password={rand(30)} here", "en", "a", 0) for i in range(150)] + [(1000 + i, " ".join(ident() for _ in range(12)), "en", "a", 0) for i in range(150)]
    rows += [(5000 + i, rand(rnd.randint(20, 40)), "en", "a", 0) for i in range(200)] + [(7000 + i, unseen(), "en", "a", 0) for i in range(200)]
    out = {r.doc_id: r.spans for r in S.find(docs(spark, rows)).collect()}
    hit = sum(any(s.kind == 3 for s in out[5000 + i]) for i in range(200))
    wrong = sum(any(s.kind == 3 for s in out[7000 + i]) for i in range(200))
    assert hit >= 190 and wrong <= 4


def test_nothing_to_train_on_and_empty_table(spark):
    rows = [(1, "plain words only", "en", "a", 0), (2, None, "en", "a", 0)]
    assert [r.spans for r in S.find(docs(spark, rows)).collect()] == [[], []]
    assert S.find(docs(spark, [])).count() == 0


def test_query_of_the_contract(spark):
    from regtext.llm.queries import queries

    from ..conftest import SF_SMALL
    kinds = ("assign", "access", "hex")
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").collect()}
    got = queries()["op7_secret_scan"](spark, SF_SMALL).collect()
    assert len(got) == len(text)
    for r in got:
        b = base(text[r.doc_id])
        joined = ",".join(f"{kinds[k]}:{s}:{e}" for s, k, e in b)
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == i for _, k, _ in b) for i in range(3))
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert set(filter(None, joined.split(","))) <= set(r.spans.split(","))
