import hashlib
import random
import zlib

import pytest

from regtext.llm import queries as Q
from regtext.llm import trie as T

from .data import table, with_clashes

SCHEMA = "conv_id long, turn long, role string, text string"


def ordered(rows):
    """Turns (role, text) of every conversation, in the operator's order."""
    out = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            out.setdefault(c, []).append((turn is not None, turn or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest(), (role, text)))
    return {c: [t[-1] for t in sorted(v, key=lambda t: t[:3])] for c, v in out.items()}


def rebuilt(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - int(c / 100) * 100  # the remainder has the sign of c
        out[c] = convs.get(c - base, [])[:h] + own[h:]
    return out


def brute(convs):
    nodes = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    kids = {}
    for p in nodes:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    out = []

    def walk(p):
        leaves, saved = 0 if p in kids else 1, (len(nodes[p]) - 1) * (len(p[-1][1]) if p else 0)
        for k in kids.get(p, []):
            sub = walk(k)
            leaves, saved = leaves + sub[0], saved + sub[1]
        ends = ",".join(str(c) for c in sorted(nodes[p]) if len(convs[c]) == len(p))
        out.append((min(nodes[p]), len(p), min(nodes[p[:-1]]) if p else None, len(nodes[p]), len(kids.get(p, [])), leaves, saved,
                    hashlib.sha256(ends.encode()).hexdigest()))
        return leaves, saved

    if nodes:
        walk(())
    return sorted(map(repr, out))


def conversations(seed, n=120):
    rnd = random.Random(seed)
    words = ["hi", "", "Üñï text", "a longer reply " * 5, None, "x"]
    rows = []
    for c in rnd.sample(range(-150, 450), n):
        for turn in range(rnd.choice([1, 1, 2, 3, 5, 9])):
            rows.append((c, turn, rnd.choice(["user", "user", "assistant", None]), rnd.choice(words[:2] if turn < 3 else words)))
    rows += [(500 + i, t, "user", f"same {t}") for i in range(60) for t in range(8)]          # copies of one conversation
    rows += [(700, t, "user", f"long {t % 50}") for t in range(900)] + [(701, t, "user", f"long {t % 50}") for t in range(901)]
    rows += [(800, None, "user", "no number"), (800, 2, "user", "tie b"), (800, 2, "user", "tie a"), (800, 2, "user", "tie a"),
             (None, 0, "user", "no id"), (801, 0, None, None), (802, None, None, None), (803, 0, "1:a", "b"), (804, 0, "1", ":ab")]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("bits", [None, 1])
def test_rebuilt_conversations_equal_brute_force(spark, bits, monkeypatch):
    """``bits`` 1: two counters a row, so the sketch proves next to nothing and all goes the exact way."""
    if bits:
        monkeypatch.setattr(T, "sketch_bits", lambda n: 3)
    rows = conversations(3)
    turns = T.numbered_turns(with_clashes(spark.createDataFrame(rows, SCHEMA)))
    assert table(T.prefix_trie(Q.spliced(turns))) == brute(rebuilt(ordered(rows)))


def test_plain_conversations_equal_brute_force(spark):
    rows = conversations(4, 60)
    got = T.prefix_trie(T.numbered_turns(spark.createDataFrame(rows, SCHEMA)))
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert table(got) == brute(ordered(rows))


def test_hot_parents_are_broadcast(spark, monkeypatch):
    monkeypatch.setattr(T, "HOT_SHARE", 4)
    rows = conversations(5, 80)
    assert table(T.prefix_trie(T.numbered_turns(spark.createDataFrame(rows, SCHEMA)))) == brute(ordered(rows))


def test_sketch_never_counts_too_low_and_screens(spark):
    rows = conversations(6)
    paths = T.materialize(T.prefixes(T.numbered_turns(spark.createDataFrame(rows, SCHEMA))), "test-paths")
    true = {}
    for r in paths.collect():
        true[bytes(r.node)] = true.get(bytes(r.node), 0) + 1
    bits = T.sketch_bits(paths.count())
    out = T.screened(paths, T.count_min(paths, bits), bits).collect()
    assert all(true[bytes(r.node)] == 1 for r in out if r.single)
    alone = sum(n == 1 for n in true.values())
    assert sum(r.single for r in out) > 0.9 * alone


def test_few_and_no_conversations(spark):
    assert T.prefix_trie(T.numbered_turns(spark.createDataFrame([], SCHEMA))).count() == 0
    for rows in ([(5, 0, "user", "one")], [(5, 0, "user", "one"), (6, 0, "user", "one")]):
        assert table(T.prefix_trie(T.numbered_turns(spark.createDataFrame(rows, SCHEMA)))) == brute(ordered(rows))
    only = Q.spliced(T.numbered_turns(spark.createDataFrame([(7, 0, "user", "gone")], SCHEMA)))
    assert table(T.prefix_trie(only)) == brute(rebuilt({7: [("user", "gone")]}))
