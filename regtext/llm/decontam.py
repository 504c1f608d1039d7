"""Operator 9, benchmark decontamination by size-partitioned MinHash containment search.

Test items are partitioned by size (number of distinct shingles, classes of powers of two). For a class
of at most ``u`` shingles a document is cut into blocks of ``u`` shingles, and two neighbouring blocks
make a window, so any stretch as long as an item of the class lies whole in some window. With the
sizes of both sides bounded, containment ``t`` of the item in the document's stretch means a Jaccard
similarity of at least ``t*q / (2u + q - t*q)`` (0.19 for the smallest item of a class at t = 0.8)
with the window, however long the document is. ``PERMUTATIONS`` MinHash values with one row a band
then miss such a window with probability below 2e-6. A window's signature is the smaller of its two
blocks' signatures, so overlapping windows cost nothing extra. Candidates are verified exactly: the
share of the item's distinct shingles found among the shingles of the whole document, as strings.

Nothing of the documents is shuffled. Items are broadcast in blocks of at most about ``ITEM_BLOCK``
items or ``BLOCK_BYTES``: one pass over the documents a block, so what is broadcast is bounded whatever the benchmark's size.

Words are lower-cased runs of non-space characters without the punctuation ``PUNCTUATION``; a shingle
has ``SHINGLE_WORDS`` words (a shorter text is one shingle of all its words).

Defined cases: NULL, blank or punctuation-only texts and items have no shingles and match nothing;
repeated documents give a row each, items equal in id and text count once; NULL ids are carried as they are; an empty table on
either side gives an empty result; extra columns are ignored (``drop_contaminated`` passes them on).
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh

SHINGLE_WORDS = 5
CONTAINMENT = 0.8
PERMUTATIONS = 64
ITEM_BLOCK = 4096
BLOCK_BYTES = 16 << 20
PUNCTUATION = ".,;:!?\"'()[]"


def tokens(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "surrogatepass").translate(None, PUNCTUATION.encode()).split()


def shingles(ws: list, k: int = SHINGLE_WORDS) -> list:
    if not ws:
        return []
    return [b" ".join(t) for t in zip(*(ws[i:] for i in range(k)))] if len(ws) >= k else [b" ".join(ws)]


def _hashes(ws: list, k: int) -> np.ndarray:
    """32-bit hashes of a text's shingles, rolled from word hashes. They only pick candidates: a collision
    costs a verification, never a result."""
    import xxhash
    words = np.fromiter(map(xxhash.xxh3_64_intdigest, ws), dtype=np.uint64, count=len(ws))
    k = min(k, len(ws))
    n = len(ws) - k + 1
    h = np.zeros(n, dtype=np.uint64)
    for i in range(k):
        h = h * np.uint64(0x9E3779B97F4A7C15) + words[i:i + n]
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return (h >> np.uint64(32)).astype(np.uint32)


def _permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Multiply-add permutations of the 32-bit numbers (odd factors), a row each."""
    rng = np.random.default_rng(9)
    a, b = rng.integers(0, 1 << 32, (2, n), dtype=np.uint32)
    return (a | np.uint32(1))[:, None], b[:, None]


def _signature(h: np.ndarray, perms) -> np.ndarray:
    a, b = perms
    return (h[None, :] * a + b).min(axis=1)


def _block_minima(h: np.ndarray, perms, width: int) -> np.ndarray:
    """MinHash signatures of consecutive blocks of ``width`` shingles, a column each."""
    a, b = perms
    step = max(width, 1024 // width * width)  # what fits a core's cache, and bounds memory on long texts
    cols = []
    for lo in range(0, len(h), step):
        part = h[None, lo:lo + step] * a + b
        cols.append(np.minimum.reduceat(part, np.arange(0, part.shape[1], width), axis=1))
    return cols[0] if len(cols) == 1 else np.concatenate(cols, axis=1)


class SizeClass:
    """Signatures of the items of one size class. A table of the values' low bits, a row for each
    permutation, turns most look-ups away before the sorted values are searched."""

    def __init__(self, width: int, members: list[int], signatures: np.ndarray):
        n, permutations = signatures.shape
        self.width = width
        self.bits = max(14, n.bit_length() + 7)
        self.row = np.arange(permutations, dtype=np.uint64)[:, None]
        values = ((self.row.T << np.uint64(32)) | signatures).ravel()
        order = np.argsort(values, kind="stable")
        self.values, self.members = values[order], np.repeat(np.array(members), permutations)[order]
        self.table = np.zeros(permutations << self.bits, dtype=bool)
        self.table[self._slots(signatures.T).ravel()] = True

    def _slots(self, signatures: np.ndarray) -> np.ndarray:
        return (signatures & np.uint32((1 << self.bits) - 1)) + (self.row << np.uint64(self.bits)).astype(np.int64)

    def candidates(self, windows: np.ndarray) -> set[int]:
        out: set[int] = set()
        rows, cols = np.nonzero(self.table[self._slots(windows)])
        v = (rows.astype(np.uint64) << np.uint64(32)) | windows[rows, cols]
        lo = np.searchsorted(self.values, v)
        hit = self.values[np.minimum(lo, len(self.values) - 1)] == v
        for x, i in zip(v[hit].tolist(), lo[hit].tolist()):
            while i < len(self.values) and int(self.values[i]) == x:
                out.add(int(self.members[i]))
                i += 1
        return out


class ItemIndex:
    """The items of one block: signatures by size class, and the exact shingles."""

    def __init__(self, items: list[tuple], k: int, permutations: int):
        self.perms = _permutations(permutations)
        self.items = []
        classes: dict[int, list] = {}
        hashes = []
        for item_id, text in items:
            ws = tokens(text)
            grams = sorted(set(shingles(ws, k)))
            if grams:
                classes.setdefault(max(8, 1 << (len(grams) - 1).bit_length()), []).append(len(self.items))
                self.items.append((item_id, grams))
                hashes.append(_hashes(ws, k))
        self.classes = [SizeClass(width, members, np.stack([_signature(hashes[m], self.perms) for m in members]))
                        for width, members in sorted(classes.items())]

    def search(self, text: str | None, k: int, containment: float):
        """``(item position, shared)`` for every item contained in the text."""
        ws = tokens(text)
        if not ws or not self.items:
            return
        candidates: set[int] = set()
        fine = _block_minima(_hashes(ws, k), self.perms, self.classes[0].width)
        for c in self.classes:
            by = c.width // self.classes[0].width  # blocks of this class are minima of the finest ones
            blocks = fine if by == 1 else np.minimum.reduceat(fine, np.arange(0, fine.shape[1], by), axis=1)
            candidates |= c.candidates(np.minimum(blocks[:, :-1], blocks[:, 1:]) if blocks.shape[1] > 1 else blocks)
        if candidates:
            present = set(shingles(ws, k))
            for m in sorted(candidates):
                own = self.items[m][1]
                shared = sum(g in present for g in own)
                if shared >= containment * len(own) - 1e-9:
                    yield m, shared


def _item_blocks(items: DataFrame, item_key: str, item_text: str, item_block: int, block_bytes: int):
    """The distinct items as broadcast variables of at most about ``item_block`` items or ``block_bytes``."""
    listed = items.select(F.col(item_key).cast("long").alias("id"), F.col(item_text).alias("t")).distinct()
    n, size = listed.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()
    blocks = max(-(-n // item_block), -(-size // block_bytes), 1)
    numbered = listed.withColumn("b", F.pmod(F.xxhash64("id", "t"), F.lit(blocks)))
    for b in range(blocks):
        rows = [(r["id"], r["t"]) for r in numbered.filter(F.col("b") == b).collect()]
        yield items.sparkSession.sparkContext.broadcast(rows)


def _finder(block, k: int, containment: float, permutations: int):
    """A pandas UDF from text to the items of one block that it contains."""
    @F.pandas_udf("array<struct<item_id:long,n_shared:long,n_shingles:long>>")
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        index = ItemIndex(block.value, k, permutations)
        for texts in batches:
            yield pd.Series([[{"item_id": index.items[m][0], "n_shared": n, "n_shingles": len(index.items[m][1])}
                              for m, n in index.search(t, k, containment)] for t in texts], dtype="object")

    return find


def contained_items(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id",
                    item_text: str = "text", k: int = SHINGLE_WORDS, containment: float = CONTAINMENT,
                    permutations: int = PERMUTATIONS, item_block: int = ITEM_BLOCK, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``(key, item_id, n_shared, n_shingles, containment)`` for every item contained in a document."""
    parts = [docs.select(F.col(key).alias("k"), _finder(b, k, containment, permutations)(F.col(text)).alias("found"))
             for b in _item_blocks(items, item_key, item_text, item_block, block_bytes)]
    return reduce(DataFrame.unionByName, parts).select(F.col("k"), F.inline("found")).select(
        F.col("k").alias(key), "item_id", "n_shared", "n_shingles", (F.col("n_shared") / F.col("n_shingles")).alias("containment"))


def drop_contaminated(docs: DataFrame, items: DataFrame, text: str = "text", item_key: str = "item_id",
                      item_text: str = "text", k: int = SHINGLE_WORDS, containment: float = CONTAINMENT,
                      permutations: int = PERMUTATIONS, item_block: int = ITEM_BLOCK, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents that contain no item, all columns. The verdict is taken row by row in the pass of
    the search, so a repeated or NULL id needs no join."""
    flag = fresh(docs.columns, "found")
    columns = docs.columns
    for b in _item_blocks(items, item_key, item_text, item_block, block_bytes):
        docs = docs.withColumn(flag, _finder(b, k, containment, permutations)(F.col(text))) \
            .filter(F.size(flag) == 0).select(*columns)
    return docs
