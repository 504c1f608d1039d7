import hashlib
import math
import re

from regtext.llm import mixing as M

from .data import awkward_rows, docs, table, with_clashes


def brute(rows, ratio=M.BUDGET_RATIO, flatten=M.FLATTEN, most=M.MAX_REPEATS, blocks=M.BLOCKS, seed=M.SEED):
    by = {}
    for i, s, t in rows:
        by.setdefault(s, []).append((i, len([w for w in re.split(r"[\x20\x09-\x0D]+", t or "") if w])))
    tokens = {s: sum(n for _, n in v) for s, v in by.items() if sum(n for _, n in v)}
    total = sum(tokens.values())
    p = {s: v / total for s, v in tokens.items()}

    def z(a):
        return sum(q ** a for q in p.values())

    def entropy(a):
        return math.log(z(a)) - a * sum(q ** a * math.log(q) for q in p.values()) / z(a)
    target = entropy(1) + flatten * (math.log(len(p)) - entropy(1)) if p else 0
    lo, hi = 0.0, 1.0
    for _ in range(60):
        mid = (lo + hi) / 2
        if p and entropy(mid) <= target and min(p.values()) ** (mid - 1) / z(mid) * ratio <= most:
            hi = mid
        else:
            lo = mid
    out = []
    for s, q in p.items():
        budget, at = math.floor(q ** hi / z(hi) * ratio * total), 0
        for e in range(budget // tokens[s] + 1):
            order = sorted((hashlib.md5(f"{seed}:{e}:{'' if i is None else i}".encode()).hexdigest(), -1 if i is None else i, n, i) for i, n in by[s])
            for h, _, n, i in order:
                at += n
                if at <= budget:
                    out.append((i, s, e, min((at - n) * blocks // budget, blocks - 1), hashlib.md5(f"{seed}:{h}".encode()).hexdigest(), n))
    return out


def mixed_rows(n=300):
    return [(i, " ".join(["t"] * (1 + i * 7 % 23)), "en", "big" if i % 3 else ("mid" if i % 2 else f"s{i % 5}"), 0) for i in range(n)]


def test_equals_brute_force(spark):
    rows = mixed_rows() + awkward_rows()
    got = M.mix(with_clashes(docs(spark, rows)))
    assert table(got) == sorted(map(repr, brute([(r[0], r[3], r[1]) for r in rows])))


def test_shares_budget_and_repetition(spark):
    rows = mixed_rows()
    for ratio, most in ((0.5, 4.0), (2.0, 1.0e9), (3.0, 3.2)):
        got = M.mix(docs(spark, rows), budget_ratio=ratio, max_repeats=most).collect()
        want = brute([(r[0], r[3], r[1]) for r in rows], ratio, most=most)
        assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
        total = sum(len(r[1].split()) for r in rows)
        assert 0.9 * ratio * total <= sum(r.n_tokens for r in got) <= ratio * total
        assert max(r.epoch for r in got) <= most
        whole = {}
        for r in got:  # an epoch holds a document once at most
            whole.setdefault((r.source, r.epoch), []).append(r.doc_id)
        assert all(len(v) == len(set(v)) for v in whole.values())


def test_every_block_holds_the_weights(spark):
    rows = [(i, "a b c d", "en", "x" if i % 4 else "y", 0) for i in range(4000)]
    got = M.mix(docs(spark, rows), blocks=8).collect()
    share = lambda rs: sum(r.n_tokens for r in rs if r.source == "x") / sum(r.n_tokens for r in rs)
    assert all(abs(share([r for r in got if r.block == b]) - share(got)) < 0.01 for b in range(8))


def test_empty_and_tokenless_tables(spark):
    assert M.mix(docs(spark, [])).count() == 0
    assert M.mix(docs(spark, [(1, None, "en", "a", 0), (2, "  ", "en", None, 0)])).count() == 0
    one = M.mix(docs(spark, [(1, "a b", "en", "a", 0)])).collect()
    assert [(r.doc_id, r.epoch) for r in sorted(one, key=lambda r: r.epoch)] == [(1, 0), (1, 1)]
