"""Operator 12, conversation prefix trie with count-min screening.

Every distinct sequence of leading turns is a node. A node is known by the digest of its turns (each turn's
SHA-256, chained), so no text is shuffled: turns are digested where they are read.

Screening: a count-min sketch counts the digests of all prefixes (two bits a counter: none, one, more). Its
estimate is never below the true count, so an estimate of one proves that a single conversation has this prefix,
and then all longer prefixes of it too. These tails become result rows on the spot. Only the prefixes that may be
shared are shuffled and grouped exactly by digest; a prefix that the sketch takes for shared by mistake is a group of
one. The sketch has a fixed size limit (``MAX_BITS``), it decides how much is shuffled and never what comes out.

Exact part: members, owner (smallest member) and children are counted by partial aggregates, so a first turn
that a third of all conversations share costs one row a task. Sums over subtrees need no descent: a conversation
owns the nodes whose smallest member it is, these are the lower end of its path, and a node's subtree holds
what its members own, less what its owner owns above it. The ids of the conversations that end at a node are sorted by
ranges, joined to pieces in parallel and streamed through the hash; nothing holds a hot node's ids at once.

Bounds: one conversation's turns are chained in order by one task that holds one turn at a time. The driver holds
the sketch (``ROWS * 2 ** MAX_BITS`` bits, 6 MB). A parent with over 1/4096 of all children is broadcast to them, of
which there are fewer than 4,096; other parents join.

Defined cases: rows without a conversation id belong to no conversation and are left out; NULL role and text are
empty; turns are ordered by number, NULL first, rows of equal number by the SHA-256 of their role's length,
role and text; repeated rows are turns of their own; a conversation whose turns are all marked absent
(``turn_digest`` NULL) ends at the root; an empty table has no nodes; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import materialize
from .common import or_empty

ROWS = 3                    # rows of the sketch
MIN_BITS, MAX_BITS = 12, 24  # counters of a row, as a power of two: about eight for every prefix, within these limits
BLOCK = 1 << 15             # counters of a row that travel together
NODE_BYTES = 16
ROOT = bytes(NODE_BYTES)
HOT_SHARE = 4096
NO_ENDS = hashlib.sha256(b"").hexdigest()


def numbered_turns(turns: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``(conv, pos, turn_digest, chars)``: the turns of every conversation, numbered from 1 in their order."""
    r, t = or_empty(F.col(f"`{role}`")), or_empty(F.col(f"`{text}`"))
    # the length of the role keeps (role, text) apart from any other pair with the same characters
    digest = F.unhex(F.sha2(F.concat(F.length(r).cast("string"), F.lit(":"), r, t), 256))
    rows = turns.filter(F.col(f"`{key}`").isNotNull()).select(
        F.col(f"`{key}`").cast("long").alias("conv"), F.col(f"`{turn}`").alias("turn"), digest.alias("turn_digest"),
        F.length(t).cast("long").alias("chars"))
    order = W.partitionBy("conv").orderBy(F.col("turn").asc_nulls_first(), "turn_digest")
    return rows.select("conv", F.row_number().over(order).cast("long").alias("pos"), "turn_digest", "chars")


def prefixes(turns: DataFrame) -> DataFrame:
    """``(conv, depth, node, parent, chars, ends)``: a row for the root and for every leading sequence of turns of
    ``turns(conv, pos, turn_digest, chars)``; rows without a digest only say that the conversation exists."""
    def chain(batches):
        conv, node, depth, held = None, ROOT, 0, None
        for batch in batches:
            rows = []
            for c, digest, chars in zip(batch["conv"].tolist(), batch["turn_digest"].tolist(), batch["chars"].tolist()):
                if c != conv:
                    if held:
                        rows.append((*held, True))
                    conv, node, depth, held = c, ROOT, 0, (c, 0, ROOT, None, 0)
                if digest is None:
                    continue
                rows.append((*held, False))
                below = hashlib.blake2b(node + bytes(digest), digest_size=NODE_BYTES).digest()
                depth += 1
                held = (c, depth, below, node, int(chars))
                node = below
            yield pd.DataFrame(rows, columns=["conv", "depth", "node", "parent", "chars", "ends"])
        if held:
            yield pd.DataFrame([(*held, True)], columns=["conv", "depth", "node", "parent", "chars", "ends"])

    dealt = turns.select("conv", "pos", "turn_digest", "chars").repartition("conv").sortWithinPartitions("conv", "pos")
    return dealt.mapInPandas(chain, "conv long, depth long, node binary, parent binary, chars long, ends boolean")


def _counters(nodes: pd.Series, bits: int) -> np.ndarray:
    """The counter of every node in every row of the sketch."""
    halves = np.frombuffer(b"".join(nodes), dtype="<u8").reshape(-1, 2)
    rows = np.arange(ROWS, dtype=np.uint64)[:, None]
    return ((halves[:, 0] + rows * (halves[:, 1] | np.uint64(1))) >> np.uint64(64 - bits)).astype(np.int64)


def sketch_bits(n: int) -> int:
    return min(max((8 * max(n, 1) - 1).bit_length(), MIN_BITS), MAX_BITS)


def count_min(paths: DataFrame, bits: int) -> np.ndarray:
    """Bits ``[row, counter // 8]`` that are set where a counter of the sketch stands at two or more."""
    width = 1 << bits
    block = min(BLOCK, width)

    def count(batches):
        seen, more = np.zeros((ROWS, width), dtype=bool), np.zeros((ROWS, width), dtype=bool)
        for batch in batches:
            if len(batch):
                for r, at in enumerate(_counters(batch["node"], bits)):
                    at, n = np.unique(at, return_counts=True)
                    more[r, at] |= seen[r, at] | (n > 1)
                    seen[r, at] = True
        for r in range(ROWS):
            for b in np.flatnonzero(seen[r].reshape(-1, block).any(axis=1)).tolist():
                part = slice(b * block, (b + 1) * block)
                yield pd.DataFrame({"part": [r * (width // block) + b], "seen": [np.packbits(seen[r, part]).tobytes()],
                                    "more": [np.packbits(more[r, part]).tobytes()]})

    def add(batches):  # rows come sorted: one block is held at a time
        part, seen, more = None, None, None
        for batch in batches:
            for p, s, m in zip(batch["part"].tolist(), batch["seen"], batch["more"]):
                s, m = np.frombuffer(s, dtype=np.uint8), np.frombuffer(m, dtype=np.uint8)
                if p != part:
                    if part is not None and more.any():
                        yield pd.DataFrame({"part": [part], "more": [more.tobytes()]})
                    part, seen, more = p, s, m
                else:
                    seen, more = seen | s, more | m | (seen & s)
        if part is not None and more.any():
            yield pd.DataFrame({"part": [part], "more": [more.tobytes()]})

    local = paths.filter("depth > 0").select("node").mapInPandas(count, "part int, seen binary, more binary")
    summed = local.repartition("part").sortWithinPartitions("part").mapInPandas(add, "part int, more binary")
    out = np.zeros(ROWS * width // 8, dtype=np.uint8)
    for r in summed.toLocalIterator():
        out[r.part * block // 8:(r.part + 1) * block // 8] = np.frombuffer(bytes(r.more), dtype=np.uint8)
    return out.reshape(ROWS, -1)


def screened(paths: DataFrame, more: np.ndarray, bits: int) -> DataFrame:
    """``paths`` with ``single`` (proven to have one member) and ``head`` (the first such row of its conversation, as
    far as the task sees it)."""
    sketch = paths.sparkSession.sparkContext.broadcast(more)

    def screen(batches):
        last, open_ = None, False  # the conversation of the row before, and whether that row was single
        more = sketch.value
        for batch in batches:
            if not len(batch):
                continue
            conv, n = batch["conv"].to_numpy(), len(batch)
            twice = np.ones(n, dtype=bool)
            for r, at in enumerate(_counters(batch["node"], bits)):
                twice &= (more[r, at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
            proof = ~twice & (batch["depth"].to_numpy() > 0)
            if conv[0] == last and open_:
                proof[0] = True
            start = np.r_[True, conv[1:] != conv[:-1]]
            first = np.maximum.accumulate(np.where(start, np.arange(n), 0))
            single = np.maximum.accumulate(np.where(proof, np.arange(n), -1)) >= first
            before = np.r_[bool(conv[0] == last and open_), single[:-1] & ~start[1:]]
            yield batch.assign(single=single, head=single & ~before)
            last, open_ = conv[-1], bool(single[-1])

    return paths.mapInPandas(screen, "conv long, depth long, node binary, parent binary, chars long, ends boolean, single boolean, head boolean")


def ends_digests(ends: DataFrame) -> DataFrame:
    """``(node, ends_sha256)`` of ``ends(node, conv)``: the decimal ids in numeric order, joined by commas."""
    def pieces(batches):
        for batch in batches:
            if len(batch):
                node = batch["node"].tolist()
                cuts = [i for i in range(len(node)) if i == 0 or node[i] != node[i - 1]] + [len(node)]
                ids = batch["conv"].tolist()
                yield pd.DataFrame({"node": [node[i] for i in cuts[:-1]], "at": [ids[i] for i in cuts[:-1]],
                                    "ids": [",".join(map(str, ids[i:j])) for i, j in zip(cuts, cuts[1:])]})

    def digest(batches):
        node, sha = None, None
        for batch in batches:
            done = []
            for n, ids in zip(batch["node"].tolist(), batch["ids"].tolist()):
                if n != node:
                    if node is not None:
                        done.append((node, sha.hexdigest()))
                    node, sha = n, hashlib.sha256(ids.encode())
                else:
                    sha.update(b"," + ids.encode())
            yield pd.DataFrame(done, columns=["node", "ends_sha256"])
        if node is not None:
            yield pd.DataFrame([(node, sha.hexdigest())], columns=["node", "ends_sha256"])

    parts = ends.repartitionByRange("node", "conv").sortWithinPartitions("node", "conv") \
        .mapInPandas(pieces, "node binary, at long, ids string")
    return parts.repartition("node").sortWithinPartitions("node", "at").mapInPandas(digest, "node binary, ends_sha256 string")


def prefix_trie(turns: DataFrame) -> DataFrame:
    """The nodes of the trie over ``turns(conv, pos, turn_digest, chars)``, a row each: ``conv_id`` (smallest member),
    ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens``, ``ends_sha256``."""
    paths = materialize(prefixes(turns), "trie-prefixes")
    bits = sketch_bits(paths.count())
    rows = materialize(screened(paths, count_min(paths, bits), bits), "trie-screened")
    shared, single = rows.filter("NOT single"), rows.filter("single")

    nodes = shared.groupBy("node", "parent", "depth", "chars").agg(F.min("conv").alias("owner"), F.count("*").alias("n"))
    nodes = materialize(nodes, "trie-groups")
    below = nodes.select("parent").union(single.filter("head").select("parent")).filter("parent IS NOT NULL") \
        .groupBy("parent").agg(F.count("*").alias("n_children"))
    path = W.partitionBy("owner").orderBy("depth").rowsBetween(W.unboundedPreceding, -1)
    weight = (F.col("n") - 1) * F.col("chars")
    nodes = nodes.join(below.withColumnRenamed("parent", "node"), "node", "left").select(
        "node", "parent", "depth", "owner", "n", weight.alias("w"), F.coalesce("n_children", F.lit(0)).alias("n_children"),
        F.coalesce(F.sum(weight).over(path), F.lit(0)).alias("above"))
    nodes = materialize(nodes, "trie-owned")

    # what a conversation owns in all, and whether it stands for a leaf
    owns = nodes.select(F.col("owner").alias("conv"), "w", (F.col("n_children") == 0).cast("long").alias("leaf")) \
        .union(single.filter("ends").select("conv", F.lit(0), F.lit(1))).groupBy("conv").agg(F.sum("w").alias("w"), F.sum("leaf").alias("leaf"))
    sums = shared.select("conv", "node").join(owns, "conv").groupBy("node").agg(F.sum("w").alias("w_all"), F.sum("leaf").alias("n_leaves"))
    ends = ends_digests(shared.filter("ends").select("node", "conv"))
    groups = nodes.join(sums, "node", "left").join(ends, "node", "left").select(
        F.col("owner").alias("conv_id"), "depth", "parent", F.col("n").alias("n_convs"), "n_children",
        F.coalesce("n_leaves", F.lit(0)).alias("n_leaves"), (F.coalesce("w_all", F.lit(0)) - F.col("above")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256"), (F.col("depth") > 0).alias("look"))
    tails = single.select(F.col("conv").alias("conv_id"), "depth", "parent", F.lit(1).alias("n_convs"),
                          (~F.col("ends")).cast("long").alias("n_children"), F.lit(1).alias("n_leaves"), F.lit(0).alias("saved_tokens"),
                          F.when(F.col("ends"), F.sha2(F.col("conv").cast("string"), 256)).otherwise(F.lit(NO_ENDS)).alias("ends_sha256"),
                          F.col("head").alias("look"))
    found = materialize(groups.unionByName(tails), "trie-rows")

    # the parent's smallest member: by broadcast for parents with very many children, by a join for the rest
    least = nodes.select(F.col("node").alias("parent"), F.col("owner").alias("parent_conv_id"), "n_children")
    limit = (nodes.agg(F.sum("n_children")).first()[0] or 0) / HOT_SHARE
    hot = F.broadcast(least.filter(F.col("n_children") > max(limit, 1)).drop("n_children"))
    look = found.filter("look")
    told = [look.join(hot, "parent"), look.join(hot, "parent", "left_anti").join(least.drop("n_children"), "parent", "left"),
            found.filter("NOT look").withColumn("parent_conv_id", F.lit(None).cast("long"))]
    # a row without a parent among the groups has a parent proven single: its own conversation's
    own = F.when(F.col("depth") > 0, F.coalesce("parent_conv_id", "conv_id")).alias("parent_conv_id")
    columns = ["conv_id", "depth", own, *[F.col(c).cast("long").alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")], "ends_sha256"]
    a, b, c = (x.select(*columns) for x in told)
    return a.union(b).union(c)
