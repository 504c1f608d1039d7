from pyspark.sql import functions as F

from regtext.llm import warc as W

from .data import table, with_clashes


def pages(spark, n=300):
    rows = [(i, f"http://x/{i}" if i % 7 else None, None if i % 11 == 3 else f"<p>é {i}</p>" * (i % 50)) for i in range(n)]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def index(spark, n=300):
    return W.materialize(W.index_pages(pages(spark, n), pages_per_file=120), "test-index")


def brute(a, b):
    """Records of either list by place: what differs."""
    key = lambda r: (r["file"], r["offset"], r["id"])
    x, y = {key(r): r for r in a}, {key(r): r for r in b}
    out = []
    for k in set(x) | set(y):
        r, s = x.get(k), y.get(k)
        if r is None or s is None or r["digest"] != s["digest"]:
            status = "missing" if s is None else "extra" if r is None else "resized" if r["length"] != s["length"] else "changed"
            out.append((*k, status))
    return sorted(map(repr, out))


def found(df):
    return sorted(repr((r["file"], r["offset"], r["id"], r["status"])) for r in df.collect())


def test_index_offsets_and_digests(spark):
    import hashlib
    rows = {r["id"]: r for r in index(spark).collect()}
    at = {}
    for p in sorted(pages(spark).collect(), key=lambda p: p.page_id):
        body = (p.html or "").encode()
        rec = (f"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:{p.page_id}>\r\nWARC-Target-URI: {p.url or ''}\r\n"
               f"Content-Type: text/html\r\nContent-Length: {len(body)}\r\n\r\n").encode() + body + b"\r\n\r\n"
        f = p.page_id // 120
        r = rows[p.page_id]
        assert (r["file"], r["offset"], r["length"], r["digest"]) == (f, at.get(f, 0), len(rec), hashlib.sha256(rec).hexdigest())
        at[f] = at.get(f, 0) + len(rec)


def test_audit_locates_all_damage(spark):
    a = index(spark)
    damaged = a.filter("id % 37 != 5").withColumn("digest", F.when(F.col("id") % 41 == 7, F.lit("x")).otherwise(F.col("digest"))) \
        .withColumn("length", F.when(F.col("id") % 82 == 7, F.col("length") - 1).otherwise(F.col("length")))
    extra = spark.createDataFrame([(9, 5000, 3, "new file"), (0, 10 ** 7, 5, "far")], "file long, length long, offset long, digest string") \
        .select("file", F.lit(1).alias("id"), "length", "digest", "offset")
    b = W.materialize(damaged.select("file", "id", "length", "digest", "offset").unionByName(extra), "test-b")
    want = brute(a.collect(), b.collect())
    assert len(want) > 12
    for leaf, fan in ((512, 2), (4096, 4), (1 << 20, 16)):
        assert found(W.audit(a, b, leaf, fan)) == want


def test_descends_only_differing_branches(spark):
    a = index(spark)
    b = a.withColumn("digest", F.when(F.col("id") == 17, F.lit("x")).otherwise(F.col("digest")))
    levels = W.height([a, b], 512, 4)
    ta, tb = W.tree(a, levels, 512, 4), W.tree(b, levels, 512, 4)
    roots = ta.filter(F.col("level") == levels)
    assert roots.count() == roots.select("file").distinct().count() == 3
    bad = W.differing_leaves(ta, tb, levels, 4).collect()
    place = a.filter("id = 17").first()
    assert [(r["file"], r["node"]) for r in bad] == [(place["file"], place["offset"] // 512)]


def test_equal_repeated_null_and_empty(spark):
    a = index(spark)
    assert W.audit(a, a.unionByName(a)).count() == 0  # repeated index rows count once
    none = a.withColumn("file", F.lit(None).cast("long"))
    bad = none.withColumn("digest", F.when(F.col("id") == 4, F.lit("x")).otherwise(F.col("digest")))
    assert [(r["file"], r["id"], r["status"]) for r in W.audit(none, bad, 512, 4).collect()] == [(None, 4, "changed")]
    assert W.audit(a.limit(0), a.limit(0)).count() == 0
    assert {r["status"] for r in W.audit(a, a.limit(0)).collect()} == {"missing"} and W.audit(a.limit(0), a).count() == 300
    assert found(W.audit(with_clashes(a.drop("id")).withColumn("id", F.lit(1)), with_clashes(a.drop("id")).withColumn("id", F.lit(1)))) == []
    assert table(W.audit(a.filter("id < 0"), a.filter("id < 0"))) == []
