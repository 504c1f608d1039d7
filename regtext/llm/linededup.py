"""Operator 10, line dedup by winnowing over line hashes (DataFrame functions only).

Lines are hashed, ``GRAM`` consecutive line hashes make a gram, and of every ``WINDOW`` consecutive
grams the smallest (the rightmost on ties) is selected: any run of ``GRAM + WINDOW - 1`` lines that
occurs twice has a selected gram in common. The first holder of a selected gram in (key, text hash,
position) order is its anchor; every later holder is joined to the anchor only, so a gram that many
documents share gives one row per holder and never all pairs. Each match is extended both ways along
its diagonal over the line hashes of the two documents, and the later run is deleted. A deleted line
always has an equal line earlier in the order, so the first copy of every line stays.

Beside the grams, every shortest window of consecutive lines with ``RUN_WORDS`` words or ``GRAM + WINDOW - 1``
lines is looked up, from each line forwards and backwards, and deleted unless it is the first of its kind. Any
run of that size that occurs earlier, in whatever document, is a union of such windows: its first window starts
it, its last one ends it, and the one from each line between lies inside it. So all of its lines go, whichever
documents hold its parts.

Within one (document, anchor document) pair, matches are taken in position order and one whose gram
already lies in a deleted run is skipped; this keeps texts of one endlessly repeated line linear.

Only line, gram and window hashes (8 bytes each) are shuffled for the search. The texts are dealt once by key, to
meet the runs to delete.

Defined cases: a NULL text stays NULL, an empty text has one blank line; lines are compared without
ASCII whitespace at their ends; grams and windows of blank lines only are never selected; a text with fewer
than ``GRAM`` lines has windows only, one with fewer than ``WINDOW`` grams has one window of grams; a
document whose lines are all deleted keeps an empty text; rows equal in key
and text are one document and get one result each; a NULL key sorts first; an empty table gives an
empty result; extra columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .common import SPACE_CHARS, bind, fresh, internal_id, or_empty, words

GRAM = 3
WINDOW = 3
RUN_WORDS = 50  # a repeated run of this many words is deleted, whatever its number of lines
NEVER = (1 << 63) - 1  # hash of a gram that is not to be selected


def line_hashes(text: Column) -> Column:
    return F.transform(F.split(or_empty(text), "\n"), lambda l: F.xxhash64(F.btrim(l, F.lit(SPACE_CHARS))))


def line_words(text: Column) -> Column:
    """The number of words of each line."""
    return F.transform(F.split(or_empty(text), "\n"), lambda l: F.size(words(l)))


def _grams(lines: Column, gram: int) -> Column:
    blank = F.xxhash64(F.lit(""))

    def one(i):
        part = F.slice(lines, i, F.lit(gram))
        return F.when(F.forall(part, lambda h: h == blank), F.lit(NEVER)).otherwise(F.xxhash64(part))

    return F.transform(F.sequence(F.lit(1), F.size(lines) - (gram - 1)), one)


def _selected(grams: Column, window: int) -> Column:
    """Positions of the window minima."""
    def pick(pairs):
        last = F.greatest(F.size(pairs) - (window - 1), F.lit(1))
        return F.array_distinct(F.transform(F.sequence(F.lit(1), last),
                                            lambda j: -F.array_min(F.slice(pairs, j, F.lit(window)))["back"]))

    return bind(F.transform(grams, lambda g, i: F.struct(g.alias("g"), (-i).alias("back"))), pick)


def fingerprints(hashed: DataFrame, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """``(id, th, pos, g)`` for the selected grams of ``hashed(id, th, lines)``."""
    long_enough = hashed.filter(F.size("lines") >= gram)
    g = long_enough.select("id", "th", _grams(F.col("lines"), gram).alias("grams"))
    chosen = bind(F.col("grams"), lambda a: F.transform(_selected(a, window), lambda p: F.struct(
        p.alias("pos"), F.get(a, p).alias("g"))))
    return g.select("id", "th", F.inline(chosen)).filter(F.col("g") != NEVER)


def _runs(mine: Column, theirs: Column, hits: Column, gram: int) -> Column:
    """Runs ``(s, e)`` of ``mine`` to delete: each hit ``(pos, apos)`` extended both ways along its diagonal."""
    def equal_ahead(x, y):  # how many leading elements of two arrays are equal
        n = F.least(F.size(x), F.size(y))
        miss = F.array_position(F.zip_with(F.slice(x, F.lit(1), n), F.slice(y, F.lit(1), n), lambda a, b: a == b), F.lit(False))
        return F.when(miss == 0, n).otherwise((miss - 1).cast("int"))

    def tail(x, p):
        return F.slice(x, p + 1, F.greatest(F.size(x) - p, F.lit(0)))

    def head(x, p):
        return F.reverse(F.slice(x, F.lit(1), p))

    def extended(h):
        return F.struct((h["pos"] - equal_ahead(head(mine, h["pos"]), head(theirs, h["apos"]))).alias("s"),
                        (h["pos"] + equal_ahead(tail(mine, h["pos"]), tail(theirs, h["apos"]))).alias("e"))

    def step(acc, h):
        inside = F.exists(acc, lambda r: (r["s"] <= h["pos"]) & (h["pos"] + gram <= r["e"]))
        return F.when(inside, acc).otherwise(F.array_append(acc, extended(h)))

    return F.aggregate(hits, F.array().cast("array<struct<s:int,e:int>>"), step)


def _windows(counts: Column, longest: int) -> Column:
    """``(s, n)`` of the shortest windows with ``RUN_WORDS`` words or ``longest`` lines that start
    or end at each line. Coded as one long each, since a union of structs compares all pairs."""
    def shortest(at, step):
        total, n = F.get(counts, at), None
        for k in range(1, longest + 1):
            enough = total >= RUN_WORDS if k < longest else total.isNotNull()
            n = F.when(enough, k) if n is None else n.when(enough, k)
            total = total + F.get(counts, at + step * k)
        return n.cast("long")

    code = longest + 1
    ahead = F.transform(counts, lambda c, i: i * code + shortest(i, 1))
    back = F.transform(counts, lambda c, i: bind(shortest(i, -1), lambda n: (i - n + 1) * code + n))
    return F.transform(F.array_compact(F.array_union(ahead, back)), lambda v: F.struct(
        F.floor(v / code).cast("int").alias("s"), (v % code).cast("int").alias("n")))


def repeated_windows(hashed: DataFrame, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """``(id, th, s, e)``: every window of lines that occurs earlier, in any document or its own."""
    found = F.filter(_windows(F.col("words"), gram + window - 1),
                     lambda w: F.exists(F.slice(F.col("words"), w["s"] + 1, w["n"]), lambda c: c > 0))
    marks = hashed.select("id", "th", F.inline(F.transform(found, lambda w: F.struct(
        w["s"].alias("s"), (w["s"] + w["n"]).alias("e"), F.xxhash64(F.slice(F.col("lines"), w["s"] + 1, w["n"])).alias("g")))))
    marks = materialize(marks, "line-windows")
    first = marks.groupBy("g").agg(F.min(F.struct("id", "th", "s")).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    return marks.join(first, "g").filter(F.struct("id", "th", "s") > F.col("first")).select("id", "th", "s", "e")


def repeated_runs(hashed: DataFrame, gram: int = GRAM, window: int = WINDOW) -> DataFrame:
    """``(id, th, runs)``: the runs of lines to delete from every document that has any."""
    marks = materialize(fingerprints(hashed, gram, window), "line-fingerprints")
    anchors = marks.groupBy("g").agg(F.min(F.struct("id", "th", "pos")).alias("a"), F.count("*").alias("n")) \
        .filter("n > 1").select("g", F.col("a.id").alias("aid"), F.col("a.th").alias("ath"), F.col("a.pos").alias("apos"))
    later = marks.join(anchors, "g").filter(~((F.col("id") == F.col("aid")) & (F.col("th") == F.col("ath"))
                                              & (F.col("pos") == F.col("apos"))))
    pairs = later.groupBy("id", "th", "aid", "ath").agg(F.sort_array(F.collect_list(F.struct("pos", "apos"))).alias("hits"))
    theirs = hashed.select(F.col("id").alias("aid"), F.col("th").alias("ath"), F.col("lines").alias("alines"))
    both = pairs.join(hashed, ["id", "th"]).join(theirs, ["aid", "ath"])
    runs = both.select("id", "th", _runs(F.col("lines"), F.col("alines"), F.col("hits"), gram).alias("runs"))
    runs = runs.unionByName(repeated_windows(hashed, gram, window).select(
        "id", "th", F.array(F.struct("s", "e")).alias("runs")))
    return runs.groupBy("id", "th").agg(F.flatten(F.collect_list("runs")).alias("runs"))


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", gram: int = GRAM, window: int = WINDOW,
                report: bool = False) -> DataFrame:
    """``docs`` with the later repeated runs of lines deleted from ``text``; with ``report`` also the
    columns ``n_lines`` and ``n_deleted`` (long)."""
    ident = lambda: (internal_id(F.col(key)).alias("id"), F.xxhash64(or_empty(F.col(text))).alias("th"))
    hashed = docs.filter(F.col(text).isNotNull()).select(*ident(), line_hashes(F.col(text)).alias("lines"),
                                                            line_words(F.col(text)).alias("words"))
    hashed = materialize(hashed, "line-hashes").dropDuplicates(["id", "th"])
    id_, th_, gone_ = (fresh(docs.columns, c) for c in ("id_", "th_", "gone_"))
    gone = repeated_runs(hashed, gram, window).select(F.col("id").alias(id_), F.col("th").alias(th_), F.array_distinct(
        F.flatten(F.transform("runs", lambda r: F.sequence(r["s"], r["e"] - 1)))).alias(gone_))
    joined = docs.join(gone, (internal_id(F.col(key)) == F.col(id_)) & (F.xxhash64(or_empty(F.col(text))) == F.col(th_))
                       & F.col(text).isNotNull(), "left")

    def rest(ls):
        left = F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), F.col(gone_))
        return F.array_join(F.transform(left, lambda i: F.get(ls, i)), "\n")

    new = F.when(F.col(gone_).isNull(), F.col(text)).otherwise(bind(F.split(F.col(text), "\n"), rest))
    counts = {"n_lines": F.coalesce(F.size(F.split(F.col(text), "\n")), F.lit(0)), "n_deleted": F.coalesce(F.size(gone_), F.lit(0))}
    return joined.select(*[new.alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns],
                         *[n.cast("long").alias(fresh(docs.columns, c)) for c, n in counts.items() if report])
