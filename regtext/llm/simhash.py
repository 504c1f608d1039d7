"""Operator 2, SimHash near-duplicates with pigeonring filtering.

A document's fingerprint has a bit set where over half the XXH64 hashes of its word shingles have it
set (repeats included). Two documents are linked if their fingerprints differ in at most ``distance``
bits; the result is the connected components of that relation.

Pigeonring: the 64 bits are cut into ``SEGMENTS`` segments on a ring. If at most ``distance`` bits
differ, some segment starts a chain all of whose prefixes of length l differ in at most
``l * distance / SEGMENTS`` bits. The longest prefix whose budget is below one bit must therefore be
equal, which gives an equi-join key per start; the budgets of the longer prefixes then prune the
candidates of a key before the full Hamming check. No link is lost.

Equal fingerprints collapse to one representative before the search. Buckets are dealt to sorted
partitions and scanned row against row with an increasing offset, in vectorised blocks. A bucket with
more than ``BUCKET_ROWS`` fingerprints is cut into blocks and every pair of blocks becomes a group of
its own, so no task gathers a hot bucket. Inside a group only a spanning forest of the links is
emitted, never all pairs.

Defined cases: a NULL or blank text has the fingerprint zero and is linked like any other; fewer words
than a shingle make one shingle of the whole sequence; repeated rows share their component; a NULL id
stays in the result and never names a component unless the component has no other id (then it is
NULL); an empty table gives an empty result; extra columns are ignored (``keep_one`` passes them on).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import fresh
from .graph import components

SHINGLE_WORDS = 3
DISTANCE = 3
SEED = 42  # fixed value of the contract
SEGMENTS = 16
BUCKET_ROWS = 8192


def fingerprint_text(text: str | None, shingle: int = SHINGLE_WORDS) -> int:
    """The signed 64-bit fingerprint of one text."""
    import xxhash
    ws = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII whitespace only
    if not ws:
        return 0
    grams = [b" ".join(t) for t in zip(*(ws[i:] for i in range(shingle)))] if len(ws) >= shingle else [b" ".join(ws)]
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, dtype=np.int64)
    for lo in range(0, len(grams), 65536):
        h = np.fromiter((digest(g, SEED) for g in grams[lo:lo + 65536]), dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(grams), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, keep: list[str], text: str = "text", shingle: int = SHINGLE_WORDS) -> DataFrame:
    """``keep`` columns and the fingerprint (long) of every row."""
    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint_text(t, shingle) for t in texts], dtype="int64")

    return docs.select(*keep, of(F.col(text)).alias(fresh(keep, "fingerprint")))


def _chain(distance: int, segments: int) -> tuple[int, list[int]]:
    """How many leading segments must be equal, and the budget of every prefix length."""
    budgets = [length * distance // segments for length in range(1, segments + 1)]
    return sum(b == 0 for b in budgets), budgets


def _spanning(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of the links (a_i, b_i) join parts that the links before them leave apart."""
    parent: dict[int, int] = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    used = np.zeros(len(a), dtype=bool)
    for i, (x, y) in enumerate(zip(a.tolist(), b.tolist())):
        x, y = root(x), root(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
            used[i] = True
    return used


def links(distinct: DataFrame, distance: int = DISTANCE, segments: int = SEGMENTS,
          bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Links ``(u, v)`` between distinct fingerprints ``fp`` (longs): a spanning forest of every bucket."""
    equal, budgets = _chain(distance, segments)
    width = 64 // segments
    full = (1 << 64) - 1
    rotate = lambda c, r: c if r == 0 else F.shiftleft(c, 64 - r).bitwiseOR(F.shiftrightunsigned(c, r))
    low_mask = (1 << (width * equal)) - 1

    # key: the start of the chain and the bits of the segments that must be equal
    keyed = distinct.select("fp", F.explode(F.array(*[F.struct(
        F.lit(s).alias("start"), rotate(F.col("fp"), s * width).bitwiseAND(F.lit(low_mask)).alias("bits"))
        for s in range(segments)])).alias("k")).select("fp", "k.start", "k.bits")
    hot = keyed.groupBy("start", "bits").agg(F.count("*").alias("n")).filter(F.col("n") > bucket_rows) \
        .select("start", "bits", F.ceil(F.col("n") / bucket_rows).cast("int").alias("blocks"))
    marked = keyed.join(hot, ["start", "bits"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))) \
        .withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    # block pairs (own, other): a row goes to every pair that holds its block
    dealt = marked.select("fp", "start", "bits", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")) \
        .select("fp", "start", "own", F.xxhash64("start", "bits", F.least("own", "other"), F.greatest("own", "other")).alias("grp"),
                (F.col("own") != F.col("other")).alias("cross"))
    parts = dealt.repartition("grp").sortWithinPartitions("grp", "fp").select("grp", "start", "own", "cross", "fp")

    def search(batches):
        left = None
        for batch in batches:
            # the columns of a batch, after what the last group of the batch before has left
            cur = pd.concat([left, batch], ignore_index=True) if left is not None else batch
            g = cur["grp"].to_numpy()
            cut = int(np.searchsorted(g, g[-1])) if len(g) else 0
            if len(g):
                left = cur.iloc[cut:]
            yield from scan(cur.iloc[:cut])
        if left is not None:
            yield from scan(left)

    def scan(rows):
        if len(rows) < 2:
            return
        g, start, own = rows["grp"].to_numpy(), rows["start"].to_numpy(), rows["own"].to_numpy()
        cross, fp = rows["cross"].to_numpy(), rows["fp"].to_numpy().view(np.uint64)
        found_u, found_v = [], []
        alive = np.arange(len(g) - 1)
        offset = 1
        while len(alive):
            alive = alive[alive + offset < len(g)]
            alive = alive[g[alive] == g[alive + offset]]  # sorted: a row without a partner here has none further on
            i, j = alive, alive + offset
            i, j = (x[(start[i] == start[j]) & (~cross[i] | (own[i] != own[j]))] for x in (i, j))
            diff = fp[i] ^ fp[j]
            shift = (start[i] * width).astype(np.uint64)
            ring = np.where(shift == 0, diff, (diff >> shift) | (diff << ((np.uint64(64) - shift) & np.uint64(63))))
            for length in range(equal, segments + 1):  # the prefixes of the chain, the last is the Hamming check
                mask = np.uint64(full if length * width >= 64 else (1 << (length * width)) - 1)
                ok = np.bitwise_count(ring & mask) <= budgets[length - 1]
                i, j, ring = i[ok], j[ok], ring[ok]
            found_u.append(fp[i].view(np.int64))
            found_v.append(fp[j].view(np.int64))
            offset += 1
            if sum(map(len, found_u)) > 500_000:  # keep what joins parts, drop the rest
                u, v = np.concatenate(found_u), np.concatenate(found_v)
                used = _spanning(u, v)
                found_u, found_v = [u[used]], [v[used]]
        u, v = np.concatenate(found_u), np.concatenate(found_v)
        used = _spanning(u, v)
        if used.any():
            yield pd.DataFrame({"u": u[used], "v": v[used]})

    return parts.mapInPandas(search, "u long, v long")


def classes(prints: DataFrame, fp: str = "fingerprint", distance: int = DISTANCE) -> DataFrame:
    """``(fp, root)`` for every distinct fingerprint; ``root`` names its component."""
    distinct = prints.select(F.col(fp).alias("fp")).distinct()
    linked = components(links(distinct, distance)).select(F.col("node").alias("fp"), "root")
    return distinct.join(linked, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))


def _groups(prints: DataFrame, distance: int) -> DataFrame:
    """``(fp, root, component_id)`` for the distinct fingerprints of a written table ``prints(k, fingerprint)``."""
    per_print = prints.groupBy("fingerprint").agg(F.min("k").alias("least"))
    named = per_print.join(classes(prints, distance=distance), F.col("fingerprint") == F.col("fp")) \
        .select("fp", "root", "least")
    ids = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return materialize(named.join(ids, "root").select("fp", "root", "component_id"), "simhash-classes")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE_WORDS,
                    distance: int = DISTANCE) -> DataFrame:
    """One row per document: ``key``, ``fingerprint`` (16 hex digits), ``component_id`` (smallest key of
    the component)."""
    prints = materialize(fingerprints(docs.select(F.col(key).alias("k"), F.col(text).alias("t")), ["k"], "t", shingle), "simhash")
    return prints.join(_groups(prints, distance), F.col("fingerprint") == F.col("fp")).select(
        F.col("k").alias(key), F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE_WORDS,
             distance: int = DISTANCE) -> DataFrame:
    """One document of every component, all columns: the one with the smallest key. Of several rows of the
    component with that key the one with the smallest row hash stays, of equal rows one; of a component without any key,
    the row with the smallest hash.

    The rows are written once with their fingerprint and a number; heads are picked and the others' numbers
    found on narrow columns, and the texts are only read again to leave those rows out."""
    own = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("t"),
           F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]).alias("h")]
    rows = fingerprints(docs.select(*own), ["row", "k", "h"], "t", shingle).withColumn("n", F.monotonically_increasing_id())
    rows = materialize(rows, "simhash-rows")  # written: the numbers stand
    prints = rows.select("k", "fingerprint", "h", "n")
    order = F.struct(F.col("k").isNull().alias("none"), "k", "h", "n")
    heads = prints.join(_groups(prints, distance).select("fp", "root"), F.col("fingerprint") == F.col("fp")) \
        .groupBy("root").agg(F.min(order).alias("head")).select("head.n")
    others = prints.select("n").join(heads, "n", "left_anti")
    return rows.join(others, "n", "left_anti").select("row.*")
