import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from regtext.llm import lexical as L

from .data import awkward_rows, docs, prose, table, with_clashes

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ITEMS = "item_id long, text string"


def found(text):
    return TERM.findall((text or "").translate(FOLD))


def brute(rows, items, k=10):
    texts = [(i, Counter(found(t))) for i, t in rows if t is not None]
    texts = [(i, c) for i, c in texts if c]
    n_docs, n_terms = len(texts), sum(c.total() for _, c in texts)
    df = Counter(w for _, c in texts for w in c)
    out = []
    for item, text in set(items):
        scored = []
        for i, c in texts:
            m = 100 - 75 + (75 * c.total() * n_docs) // n_terms
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((1000000000 * c[w]) // (1000 * c[w] + 8 * m))
                    for w in found(text) if w in c)
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scored)[:k])]
    return sorted(map(repr, out))


def collection(seed=1, n=300):
    rnd = random.Random(seed)
    rows = awkward_rows() + [(1000 + i, prose(rnd, rnd.randint(3, 60), 90) + " the of", "en", "a", 0) for i in range(n)]
    rows += [(5000 + i, "the same copy of a text w1 w2 w3", "en", "a", 0) for i in range(40)]  # ties past the tenth
    items = [(i, prose(rnd, rnd.randint(1, 30), 120)) for i in range(25)]
    items += [(30, "the of The"), (31, None), (32, " ,.;"), (33, "unknownword"), (34, "w1 w1 w1 w2 W2"), (34, "w1 w1 w1 w2 W2"), (35, "w3 w4"),
              (35, "w5"), (None, "w7 copy"), (36, "Ünï çødé É"), (37, rows[-1][1]), (38, prose(rnd, 4000, 500))]
    return rows, items


def test_terms_are_the_contracts():
    text = "".join(map(chr, range(0x180))) + " Ünï-çødé_É A1b2  x　y\x85z"
    assert [t.decode() for t in L.terms(text)] == found(text)


def test_equals_brute_force(spark):
    rows, items = collection()
    got = L.search(with_clashes(docs(spark, rows)), with_clashes(spark.createDataFrame(items, ITEMS)))
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert table(got) == brute([(r[0], r[1]) for r in rows], items)


@pytest.mark.parametrize("k", [1, 25])
def test_small_shards_pieces_and_query_blocks(spark, monkeypatch, k):
    """Limits so small that shards, list pieces, query groups, blocks and query blocks are all cut many times."""
    rows, items = collection(2)
    want = brute([(r[0], r[1]) for r in rows], items, k)
    vectors = None
    for name, value in {"SHARD_DOCS": 64, "LIST_PIECE": 40, "BLOCK_DOCS": 4, "COORDINATES": 30}.items():
        monkeypatch.setattr(L, name, value)
    texts = [(i, L.terms(t)) for i, t in ((r[0], r[1]) for r in rows) if t is not None]
    texts = [(i, Counter(t)) for i, t in texts if t]
    vocabulary = {w: i for i, w in enumerate(sorted({w for _, t in items for w in L.terms(t)}))}
    n_docs, n_terms = len(texts), sum(c.total() for _, c in texts)
    weight = np.array([L.term_weight(n_docs, sum(w in c for _, c in texts)) for w in vocabulary])
    rarity = {t: -int(weight[t]) for t in range(len(weight))}
    asked = [(i, Counter(vocabulary[w] for w in L.terms(t))) for i, t in set(items) if L.terms(t)]
    qs = [L.Query(j, c, rarity, k) for j, (_, c) in enumerate(asked)]
    scored = 0
    for lo in range(0, len(texts), L.SHARD_DOCS):
        part = texts[lo:lo + L.SHARD_DOCS]
        hits = [sorted((vocabulary[w], n) for w, n in c.items() if w in vocabulary) for _, c in part]
        vectors = [np.array([h[j] for h in x], dtype="<i4").tobytes() for j in (0, 1) for x in hits]
        shard = L.Shard(np.array([c.total() for _, c in part]), vectors[:len(part)], vectors[len(part):], weight, n_docs, n_terms)
        shard.search(qs, [(i is None, i or 0) for i, _ in part])
        scored += shard.n_scored
    got = [(asked[q.number][0], r + 1, None if x[1] else x[2], -x[0]) for q in qs for r, x in enumerate(q.best)]
    assert sorted(map(repr, got)) == want
    touching = sum(any(w in c for w in (L.terms(t))) for _, c in texts for _, t in set(items))
    assert scored < touching  # blocks were skipped, and no document was scored twice for an item
    monkeypatch.setattr(L, "QUERY_BLOCK", 7)
    assert table(L.search(docs(spark, rows), spark.createDataFrame(items, ITEMS), k=k)) == want


def test_blocks_cover_all_rows():
    rnd = np.random.default_rng(3)
    for n in (1, 31, 32, 33, 500):
        order, starts = L.blocks((rnd.random((n, 9)) < 0.3) * rnd.integers(1, 10**9, (n, 9)))
        ends = np.append(starts[1:], n)
        assert sorted(order.tolist()) == list(range(n)) and (ends - starts).max() <= L.BLOCK_DOCS and (ends > starts).all()


def test_empty_tables(spark):
    none, some = docs(spark, []), spark.createDataFrame([(1, "a b")], ITEMS)
    assert L.search(none, some).count() == 0
    assert L.search(docs(spark), spark.createDataFrame([], ITEMS)).count() == 0
    assert L.search(docs(spark, [(1, None, "en", "a", 0), (2, " . ", "en", "a", 0)]), some).count() == 0
