import random

import numpy as np
import xxhash

from regtext.llm import simhash as S
from regtext.llm.graph import components

from .data import awkward_rows, docs, table, with_clashes


def brute_print(text, k=3):
    ws = (text or "").encode().lower().split()
    grams = [b" ".join(ws[i:i + k]) for i in range(len(ws) - k + 1)] if len(ws) >= k else ([b" ".join(ws)] if ws else [])
    hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_classes(prints, distance=3):
    prints = sorted(set(prints))
    part = {p: p for p in prints}

    def root(x):
        while part[x] != x:
            x = part[x]
        return x
    for i, a in enumerate(prints):
        for b in prints[i + 1:]:
            if (a ^ b).bit_count() <= distance:
                ra, rb = root(a), root(b)
                part[max(ra, rb)] = min(ra, rb)
    return {p: root(p) for p in prints}


def test_fingerprints_and_components_equal_brute_force(spark):
    rows = awkward_rows() + [(700 + i, awkward_rows()[49][1] + f" tail{i}", "en", "a", 0) for i in range(6)]
    got = {(r.doc_id, r.fingerprint, r.component_id) for r in S.near_duplicates(with_clashes(docs(spark, rows))).collect()}
    prints = [(r[0], brute_print(r[1])) for r in rows]
    cls = brute_classes([p for _, p in prints])
    least = {}
    for d, p in prints:
        if d is not None:
            least[cls[p]] = min(d, least.get(cls[p], d))
    assert got == {(d, f"{p:016x}", least.get(cls[p])) for d, p in prints}
    assert S.near_duplicates(docs(spark, [])).count() == 0


def planted_prints(rng, n=400, groups=12):
    prints = set(int(x) for x in rng.integers(0, 1 << 63, n, dtype=np.uint64) * 2 + 1)
    for _ in range(groups):  # chains of small steps, and a dense ball
        x = int(rng.integers(0, 1 << 63, dtype=np.uint64))
        for _ in range(25):
            for b in rng.choice(64, rng.integers(1, 5), replace=False):
                x ^= 1 << int(b)
            prints.add(x)
    center = int(rng.integers(0, 1 << 63, dtype=np.uint64))
    prints |= {center ^ (1 << int(rng.integers(0, 64))) ^ (1 << int(rng.integers(0, 64))) for _ in range(300)}
    return prints


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def check_links(spark, distance, segments, bucket_rows):
    prints = planted_prints(np.random.default_rng(distance))
    df = spark.createDataFrame([(signed(p),) for p in prints], "fp long")
    links = S.links(df, distance, segments, bucket_rows)
    pairs = {(r.u, r.v) for r in links.collect()}
    assert all(((u ^ v) & ((1 << 64) - 1)).bit_count() <= distance for u, v in pairs)
    root = {r.node: r.root for r in components(links).collect()}
    want = brute_classes(prints, distance)
    mine = {}
    for p in prints:
        mine.setdefault(root.get(signed(p), signed(p)), set()).add(p)
    theirs = {}
    for p, c in want.items():
        theirs.setdefault(c, set()).add(p)
    assert sorted(map(sorted, mine.values())) == sorted(map(sorted, theirs.values()))


def test_links_lose_nothing(spark):
    check_links(spark, 3, 16, 8192)


def test_hot_buckets_are_split_without_loss(spark):
    check_links(spark, 3, 16, 20)


def test_other_distance_and_segments(spark):
    check_links(spark, 6, 8, 50)


def test_keep_one_of_each_component(spark):
    rows = awkward_rows()
    d = docs(spark, rows)
    kept = S.keep_one(with_clashes(d))
    assert kept.columns == with_clashes(d).columns
    ids = [r.doc_id for r in kept.collect()]
    cls = brute_classes([brute_print(r[1]) for r in rows])
    least = {}
    for r in rows:
        c = cls[brute_print(r[1])]
        if r[0] is not None:
            least[c] = min(r[0], least.get(c, r[0]))
    nameless = len({cls[brute_print(r[1])] for r in rows} - set(least))
    assert nameless == 1 and sorted(i for i in ids if i is not None) == sorted(least.values())
    assert ids.count(None) == nameless
    assert S.keep_one(d.limit(0)).count() == 0


def test_components_of_path_star_and_cycle(spark):
    path = [(i, i + 1) for i in range(200)]
    star = [(1000, 1000 + i) for i in range(1, 150)]
    cycle = [(5000 + i, 5000 + (i + 1) % 30) for i in range(30)] + [(7, 7), (-5, -9), (-9, -5)]
    got = {r.node: r.root for r in components(spark.createDataFrame(path + star + cycle, "u long, v long")).collect()}
    assert all(got[i] == 0 for i in range(201)) and all(got[1000 + i] == 1000 for i in range(150))
    assert all(got[5000 + i] == 5000 for i in range(30)) and got[-5] == got[-9] == -9
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0
    assert table(components(spark.createDataFrame([(3, 4), (3, 4)], "u long, v long"))) == ["(3, 3)", "(4, 3)"]


def test_rows_of_one_key_in_several_components_are_all_heads(spark):
    rnd = random.Random(12)
    texts = [" ".join(f"t{j}w{rnd.randrange(5000)}" for _ in range(120)) for j in range(4)]
    rows = [(7, t, "en", "a", 0) for t in texts] + [(20 + i, t, "en", "a", 0) for i, t in enumerate(texts)]
    assert table(S.keep_one(docs(spark, rows))) == sorted(map(repr, rows[:4]))
