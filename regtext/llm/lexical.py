"""Operator 11, ranked lexical search with per-term geometric blocking.

One pass over the texts writes a sparse vector for every document, restricted to the terms of a block of queries
(``QUERY_BLOCK`` items at a time, so what is broadcast is bounded). Corpus statistics are Spark aggregates over
these vectors. The vectors are then read in shards of bounded size, and every shard is an index of its own:

* a posting list is clustered by similarity: evenly picked documents of the list represent it, every other one
  joins the representative with the largest cosine, and clusters are cut into blocks of ``BLOCK_DOCS`` documents;
* a block keeps the coordinatewise maximum of its documents' score contributions, over the terms that the queries
  at hand ask for together with the list's own term;
* a query takes its lists from the rarest term on. A block is skipped only if the maximum's score for the query
  is below the query's tenth best score so far, which no document of the block can then reach; the list and all
  further ones are skipped once the largest contributions of the remaining terms together stay below it.

Nothing is estimated: bounds and scores are integers, a bound equal to the tenth score is not skipped, so ties go to
the smaller id. Best rows carry over from shard to shard within a task. Every task returns at most ``k`` rows an item, and
a ranking window with its per-task limit picks the best of them. Lists are split over shards, so a term that every
document holds never meets in one place.

Defined cases: NULL texts and texts without a term are no documents and rank nowhere; an item without terms
has no rows; items equal in id and text count once, items of one id with different texts are ranked each on its own
under that id; repeated documents rank each on its own, a NULL document id after all others; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import materialize

QUERY_BLOCK = 1024           # items answered in one pass over the texts ...
QUERY_TERMS = 1 << 18        # ... or as many as have this many terms together
SHARD_DOCS = 16384           # documents of a shard ...
SHARD_POSTINGS = 2_000_000   # ... or as many as have this many postings
LIST_PIECE = 4096            # documents of a posting list that are clustered together
BLOCK_DOCS = 32
COORDINATES = 512            # terms of a block's summary; more queries on one term are taken in groups

# every byte that is no ASCII letter or digit ends a term; bytes from 0x80 on belong to characters that do not
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))


def terms(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


def vectors(docs: DataFrame, vocabulary: dict[bytes, int], key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(has, doc, n, ids, tfs)`` for every document with a term: its number of terms, and the numbers and counts of
    those in ``vocabulary``, as little-endian 32-bit integers in ascending order of the numbers."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches):
        known = shared.value
        for batch in batches:
            rows = []
            for has, doc, t in zip(batch["has"].tolist(), batch["doc"].tolist(), batch["t"].tolist()):
                found = Counter(terms(t))
                if found:
                    hits = sorted((known[w], c) for w, c in found.items() if w in known)
                    rows.append((has, doc, found.total(), np.array([h[0] for h in hits], dtype="<i4").tobytes(),
                                 np.array([h[1] for h in hits], dtype="<i4").tobytes()))
            yield pd.DataFrame(rows, columns=["has", "doc", "n", "ids", "tfs"])

    k = F.col(f"`{key}`")
    rows = docs.filter(F.col(f"`{text}`").isNotNull()).select(k.isNotNull().alias("has"), F.coalesce(k.cast("long"), F.lit(0)).alias("doc"),
                                                              F.col(f"`{text}`").alias("t"))
    return rows.mapInPandas(count, "has boolean, doc long, n long, ids binary, tfs binary")


def document_frequencies(vecs: DataFrame, size: int) -> list[int]:
    def count(batches):
        total = np.zeros(size, dtype=np.int64)
        for batch in batches:
            total += np.bincount(np.frombuffer(b"".join(batch["ids"]), dtype="<i4"), minlength=size)
        at = np.flatnonzero(total)
        yield pd.DataFrame({"term": at, "df": total[at]})

    out = [0] * size
    for r in vecs.select("ids").mapInPandas(count, "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).toLocalIterator():
        out[r.term] = r.df
    return out


def term_weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def _spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The concatenated ranges ``starts[i] .. starts[i] + lengths[i]``."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


class Shard:
    """The index of some documents: score contributions by document and by term."""

    def __init__(self, n: np.ndarray, ids: list[bytes], tfs: list[bytes], weight: np.ndarray, n_docs: int, n_terms: int):
        size = np.fromiter((len(x) // 4 for x in ids), dtype=np.int64, count=len(ids))
        self.term = np.frombuffer(b"".join(ids), dtype="<i4")
        tf = np.frombuffer(b"".join(tfs), dtype="<i4").astype(np.int64)
        wide = int(n.max(initial=0)) * 75 * n_docs >= 1 << 63
        m = 25 + (n.astype(object) if wide else n) * 75 * n_docs // n_terms
        doc = np.repeat(np.arange(len(ids)), size)
        self.part = weight[self.term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m.astype(np.int64)[doc]))
        self.first, self.size = np.cumsum(size) - size, size
        order = np.argsort(self.term, kind="stable")
        self.by_term = doc[order]
        self.at = np.searchsorted(self.term[order], np.arange(len(weight) + 1))
        self.most = np.zeros(len(weight), dtype=np.int64)
        np.maximum.at(self.most, self.term, self.part)
        self.column = np.full(len(weight), -1)
        self.n_scored = 0

    def matrix(self, docs: np.ndarray, coordinates: np.ndarray) -> np.ndarray:
        """The documents' contributions in the given terms."""
        self.column[coordinates] = np.arange(len(coordinates))
        at = _spans(self.first[docs], self.size[docs])
        row, col = np.repeat(np.arange(len(docs)), self.size[docs]), self.column[self.term[at]]
        hit = col >= 0
        out = np.zeros((len(docs), len(coordinates)), dtype=np.int64)
        out[row[hit], col[hit]] = self.part[at[hit]]
        self.column[coordinates] = -1
        return out

    def search(self, queries: list[Query], ids: list) -> None:
        """Improve the queries' best rows with this shard's documents; ``ids`` are the documents' (has, doc) keys."""
        asked: dict[int, list] = {}
        for q in queries:
            q.rest = np.cumsum((q.count * self.most[q.term])[::-1])[::-1]  # most that a term and all later ones can give
            for i, t in enumerate(q.term.tolist()):
                asked.setdefault(t, []).append((q, i))
        for t in sorted(asked, key=lambda t: (asked[t][0][0].rarity[t], t)):
            docs = self.by_term[self.at[t]:self.at[t + 1]]
            open_ = [(q, i) for q, i in asked[t] if q.rest[i] >= q.least] if len(docs) else []
            for lo in range(0, len(docs) if open_ else 0, LIST_PIECE):
                for group in _groups([(q, i) for q, i in open_ if q.rest[i] >= q.least]):
                    self._list(docs[lo:lo + LIST_PIECE], group, ids)

    def _list(self, docs, group, ids):
        coordinates = np.unique(np.concatenate([q.term for q, _ in group]))
        m = self.matrix(docs, coordinates)
        order, starts = blocks(m)
        docs, m = docs[order], m[order]
        summary = np.maximum.reduceat(m, starts, axis=0)
        ends = np.append(starts[1:], len(docs))
        for q, i in group:
            col = np.searchsorted(coordinates, q.term)
            live = np.flatnonzero(summary[:, col] @ q.count >= q.least)
            rows = _spans(starts[live], (ends - starts)[live])
            # a document with an earlier term of the query was met in that term's list
            rows = rows[~m[np.ix_(rows, col[:i])].any(axis=1)]
            self.n_scored += len(rows)
            score = m[np.ix_(rows, col)] @ q.count
            good = np.flatnonzero(score >= q.least)
            if len(good) > q.k:
                good = good[score[good] >= np.partition(score[good], -q.k)[-q.k]]
            if len(good):
                q.add([(-int(score[r]), *ids[docs[rows[r]]]) for r in good])


class Query:
    """Terms of one item from the rarest on, with their repeats, and its best rows ``(-score, no id, id)`` so far."""

    def __init__(self, number: int, counts: dict[int, int], rarity: dict[int, int], k: int):
        order = sorted(counts, key=lambda t: (rarity[t], t))
        self.number, self.rarity, self.k = number, rarity, k
        self.term, self.count = np.array(order, dtype=np.int64), np.array([counts[t] for t in order], dtype=np.int64)
        self.best, self.least = [], 1

    def add(self, rows: list) -> None:
        self.best = sorted(self.best + rows)[:self.k]
        if len(self.best) == self.k:
            self.least = -self.best[-1][0]


def _groups(asked: list) -> list[list]:
    """Queries on one term, cut where their terms together pass the width of a summary."""
    out, seen = [], None
    for q, i in asked:
        more = set(q.term.tolist())
        if seen is None or len(seen | more) > COORDINATES:
            out.append([])
            seen = set()
        seen |= more
        out[-1].append((q, i))
    return out


def blocks(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of the rows of ``m`` that brings similar ones together, and the starts of the blocks in it."""
    n = len(m)
    if n <= BLOCK_DOCS:
        return np.arange(n), np.zeros(1, dtype=np.int64)
    x = m.astype(np.float32)
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-6)
    picks = np.linspace(0, n - 1, -(-n // BLOCK_DOCS)).astype(np.int64)
    nearest = np.argmax(x @ x[picks].T, axis=1)
    order = np.lexsort((-m.sum(axis=1), nearest))
    new = np.r_[True, nearest[order][1:] != nearest[order][:-1]]
    start = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    return order, np.flatnonzero((np.arange(n) - start) % BLOCK_DOCS == 0)


def _best(vecs: DataFrame, queries: list[tuple[int, dict[int, int]]], weight: list[int], n_docs: int, n_terms: int, k: int) -> DataFrame:
    shared = vecs.sparkSession.sparkContext.broadcast((queries, weight))

    def run(batches):
        asked, weight = shared.value
        rarity = {t: -weight[t] for _, c in asked for t in c}
        qs = [Query(i, c, rarity, k) for i, c in asked]
        w = np.array(weight, dtype=np.int64)

        def answer(rows):
            n = np.array([r[2] for r in rows], dtype=np.int64)
            Shard(n, [r[3] for r in rows], [r[4] for r in rows], w, n_docs, n_terms).search(qs, [(not r[0], r[1]) for r in rows])

        rows, postings = [], 0
        for batch in batches:
            for r in batch.itertuples(index=False, name=None):
                rows.append(r)
                postings += len(r[3]) // 4
                if len(rows) == SHARD_DOCS or postings >= SHARD_POSTINGS:
                    answer(rows)
                    rows, postings = [], 0
        if rows:
            answer(rows)
        found = [(q.number, not none, doc, -score) for q in qs for score, none, doc in q.best]
        yield pd.DataFrame(found, columns=["q", "has", "doc", "score"])

    return vecs.mapInPandas(run, "q long, has boolean, doc long, score long")


def _query_blocks(items: DataFrame, item_key: str, text: str):
    """Lists of ``(item, term counts)``, as many at a time as one pass over the texts answers."""
    block, size = [], 0
    rows = items.select(F.col(f"`{item_key}`").alias("i"), F.col(f"`{text}`").alias("t")).distinct()
    for r in rows.toLocalIterator():
        counts = Counter(terms(r.t))
        if counts:
            if block and (len(block) == QUERY_BLOCK or size + len(counts) > QUERY_TERMS):
                yield block
                block, size = [], 0
            block.append((r.i, counts))
            size += len(counts)
    if block:
        yield block


def search(docs: DataFrame, items: DataFrame, k: int = 10, key: str = "doc_id", text: str = "text",
           item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """``(item_key, rank, key, score)``: the ``k`` best documents of every item, score above 0, ties by smaller id."""
    spark = docs.sparkSession
    parts, named = [], []
    for block in _query_blocks(items, item_key, item_text):
        vocabulary = {w: i for i, w in enumerate(dict.fromkeys(w for _, c in block for w in c))}
        vecs = materialize(vectors(docs, vocabulary, key, text), "term-vectors")
        n_docs, n_terms = vecs.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        weight = [term_weight(n_docs, df) for df in document_frequencies(vecs, len(vocabulary))]
        queries = [(len(named) + i, {vocabulary[w]: c for w, c in counts.items()}) for i, (_, counts) in enumerate(block)]
        named += [(q, item) for (q, _), (item, _) in zip(queries, block)]
        parts.append(_best(vecs, queries, weight, n_docs, n_terms, k))
    item_type = items.schema[item_key].dataType.simpleString()
    if not parts:
        return spark.createDataFrame([], f"`{item_key}` {item_type}, rank int, `{key}` long, score long")
    names = spark.createDataFrame(named, f"q long, item {item_type}")
    order = W.partitionBy("q").orderBy(F.col("score").desc(), F.col("doc").asc_nulls_last())
    rows = reduce(DataFrame.union, parts).select("q", F.when(F.col("has"), F.col("doc")).alias("doc"), "score")
    best = rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return best.join(names, "q").select(F.col("item").alias(item_key), "rank", F.col("doc").alias(key), "score")
