import random

import numpy as np

from regtext.llm import decontam as D

from .data import awkward_rows, docs, table, with_clashes


def brute(doc_rows, items, k=5, share=0.8):
    drop = str.maketrans("", "", ".,;:!?\"'()[]")

    def grams(t):
        ws = (t or "").lower().translate(drop).encode().split()
        return {tuple(ws[i:i + k]) for i in range(len(ws) - k + 1)} if len(ws) >= k else ({tuple(ws)} if ws else set())
    out = []
    for d, t in doc_rows:
        have = grams(t)
        for i, x in set(items):
            own = grams(x)
            if own and len(own & have) >= share * len(own):
                out.append((d, i, len(own & have), len(own)))
    return sorted(map(repr, out))


def planted(spark):
    rnd = random.Random(8)
    items = [(i, " ".join(f"v{rnd.randrange(5000)}" for _ in range(n))) for i, n in enumerate((3, 5, 6, 12, 15, 16, 17, 33, 60, 130, 300))]
    items += [items[4], (None, "null id item one two three four"), (50, None), (51, ""), (52, "?!"), (53, items[5][1].upper() + "!")]
    rows = [(r[0], r[1]) for r in awkward_rows()]
    for n, (i, text) in enumerate(items[:11]):
        for size in (0, 40, 3000, 19000):  # short items inside long documents
            around = [f"u{rnd.randrange(9000)}" for _ in range(size)]
            at = rnd.randint(0, size)
            ws = text.split()
            edited = list(ws)
            if len(ws) > 60:
                edited[len(ws) // 2] = "changed"
            rows.append((1000 + 10 * n + size % 7, " ".join(around[:at] + edited + around[at:])))
            rows.append((5000 + 10 * n + size % 7, " ".join(around[:at] + ws[: len(ws) // 2] + around[at:])))
    return rows, items, spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")


def test_equals_brute_force(spark):
    rows, items, d, i = planted(spark)
    want = brute(rows, items)
    assert len(want) > 40
    cols = ("doc_id", "item_id", "n_shared", "n_shingles")
    assert table(D.contained_items(with_clashes(d), i).select(*cols)) == want
    assert table(D.contained_items(d, i, item_block=3).select(*cols)) == want  # several passes
    assert table(D.contained_items(d, i, block_bytes=500).select(*cols)) == want


def test_drop_contaminated(spark):
    rows, items, d, i = planted(spark)
    hit = {eval(x)[0] for x in brute([(n, t) for n, (_, t) in enumerate(rows)], items)}
    want = sorted(repr(r) for n, r in enumerate(rows) if n not in hit)
    assert table(D.drop_contaminated(d, i)) == want
    assert D.drop_contaminated(with_clashes(d), i, item_block=4).columns == with_clashes(d).columns
    assert table(D.drop_contaminated(d, i.limit(0))) == sorted(map(repr, rows))
    assert D.contained_items(d.limit(0), i).count() == 0 and D.contained_items(d, i.limit(0)).count() == 0


def test_windows_cover_any_stretch_of_a_class():
    h = np.random.default_rng(0).integers(0, 1 << 32, 5000, dtype=np.uint32)
    perms = D._permutations(8)
    for width in (8, 64):
        blocks = D._block_minima(h, perms, width)
        assert blocks.shape == (8, -(-5000 // width))
        windows = np.minimum(blocks[:, :-1], blocks[:, 1:])
        for j in range(windows.shape[1]):
            assert (windows[:, j] == D._signature(h[j * width:(j + 2) * width], perms)).all()
