"""Text-pair operators: abbreviation expansion (J6) and longest shared passage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import let, py_split


def _occurrences(text: Column, sub: Column) -> Column:
    """Non-overlapping occurrences of ``sub`` in ``text`` (Python ``str.count``)."""
    return F.when(F.length(sub) > 0,
                  ((F.length(text) - F.length(F.replace(text, sub, F.lit("")))) / F.length(sub)).cast("bigint")) \
        .otherwise(F.lit(0).cast("bigint"))


def dictionary_table(spark: SparkSession, dictionary: dict[str, list[str]]) -> DataFrame:
    """A small dictionary as the table ``(token, expansions)`` that ``expand_abbreviations`` takes."""
    return spark.createDataFrame(sorted(dictionary.items()), "token string, expansions array<string>")


def expand_abbreviations(df: DataFrame, key: str, col: str, dictionary: DataFrame) -> DataFrame:
    """Replace every space-separated token of ``col`` found in ``dictionary(token, expansions)`` by its
    expansion; with several candidates, the one occurring most often in the same text wins (ties: first
    listed). NULL texts stay NULL.

    The distinct tokens of a row join the dictionary; only matches come back (a row's matches, not its
    tokens) and are looked up in a per-row map. The best expansion is found once per row and token.
    """
    text_hash = F.xxhash64(col)
    toks = df.select(F.col(key).alias("_k"), text_hash.alias("_h"), F.explode(F.array_distinct(F.split(col, " "))).alias("token"))
    hits = toks.join(dictionary.select("token", "expansions"), "token").groupBy("_k", "_h").agg(
        F.map_from_entries(F.collect_set(F.struct("token", "expansions"))).alias("_m"))
    init = F.struct(F.lit(-1).cast("bigint").alias("n"), F.lit(None).cast("string").alias("best"))

    def best_of(t, cands):
        return F.aggregate(cands, init, lambda acc, c: F.when(_occurrences(t, c) > acc["n"],
                                                               F.struct(_occurrences(t, c).alias("n"), c.alias("best")))
                           .otherwise(acc))["best"]

    def replaced(t):
        best = F.transform_values("_m", lambda _, cands: best_of(t, cands))
        # bound once per row: an expression inside the per-token lambda would be evaluated per token
        return let(best, lambda bm: F.array_join(
            F.transform(F.split(t, " "), lambda x: F.coalesce(F.try_element_at(bm, x), x)), " "))

    out = df.join(hits, F.col(key).eqNullSafe(F.col("_k")) & (text_hash == F.col("_h")), "left")
    new = F.when(F.col("_m").isNull(), F.col(col)).otherwise(let(F.col(col), replaced))
    return out.select(*[new.alias(c) if c == col else F.col(c) for c in df.columns])


def _tokens(df: DataFrame, text_col: str, unit: str) -> Column:
    return py_split(text_col) if unit == "word" else F.filter(F.split(F.col(text_col), ""), lambda x: x != "")


BUCKETS = 1 << 16  # counters of the frequency table that ranks seeds


def _hashed(df: DataFrame, key: str, text_col: str, k: int, g: int, unit: str) -> DataFrame:
    """``(_key, _h, _gs)``: the token hashes of every text and the hashes of its ``g``-grams (NULL below ``k`` tokens)."""
    tokens = df.select(F.col(key).alias("_key"), F.transform(_tokens(df, text_col, unit), lambda t: F.xxhash64(t)).alias("_h"))
    grams = F.transform(F.sequence(F.lit(1), F.size("_h") - F.lit(g - 1)), lambda i: F.xxhash64(F.slice(F.col("_h"), i, F.lit(g))))
    return tokens.withColumn("_gs", F.when(F.size("_h") >= k, grams))


def _bucket(gram: Column) -> Column:
    return gram.bitwiseAND(F.lit(BUCKETS - 1)).cast("int")


def _rarity(hashed: DataFrame) -> Column:
    """How frequent the grams of every bucket are in ``hashed``, one byte a bucket (the logarithm of their number), as a
    literal: what the driver holds is bounded by ``BUCKETS`` numbers. A gram with a far larger share than one
    bucket's stands out in it."""
    level = bytearray(BUCKETS)
    for r in hashed.select(F.explode_outer("_gs").alias("g")).filter("g IS NOT NULL").groupBy(_bucket(F.col("g")).alias("b")).agg(F.count(F.lit(1)).alias("n")).collect():
        level[r["b"]] = r["n"].bit_length()
    return F.lit(bytes(level))


def _seeds(hashed: DataFrame, rarity: Column, g: int, w: int) -> DataFrame:
    """``(_key, pos, g1, g2, before, after, left, right)``: of every ``w`` consecutive grams the rarest (ties by hash,
    then the last) is a seed. A text without any window whose buckets the second side all fills has no seeds at all. ``before`` and ``after`` tell which seed comes next to it and how far off, ``left`` and
    ``right`` the ``w - 1`` tokens around it."""
    ranked = F.transform("_gs", lambda x, i: F.struct(F.substring(rarity, _bucket(x) + 1, F.lit(1)).alias("n"), x.alias("g"), (-i).alias("back")))

    def pick(r):
        last = F.greatest(F.size(r) - F.lit(w - 1), F.lit(1))
        return F.array_distinct(F.transform(F.sequence(F.lit(1), last), lambda j: -F.array_min(F.slice(r, j, F.lit(w)))["back"]))

    at = lambda p: F.get(F.col("_gs"), p)
    link = lambda p, q: F.when(q.isNotNull(), F.xxhash64(at(q), q - p))

    def seed(sel):
        return F.transform(sel, lambda p, i: F.struct(
            p.alias("pos"), at(p).alias("g1"), F.xxhash64(F.lit(7), F.slice(F.col("_h"), p + 1, F.lit(g))).alias("g2"),
            F.when(i > 0, link(p, F.get(sel, i - 1))).alias("before"), link(p, F.get(sel, i + 1)).alias("after"),
            F.reverse(F.slice(F.col("_h"), F.greatest(p - (w - 2), F.lit(1)), F.least(p, F.lit(w - 1)))).alias("left"),
            F.slice(F.col("_h"), p + g + 1, F.lit(w - 1)).alias("right")))

    known = F.array_join(F.transform("_gs", lambda x: F.when(F.substring(rarity, _bucket(x) + 1, F.lit(1)) > F.lit(b"\0"), "+").otherwise("-")), "")
    sel = let(ranked, pick) if w > 1 else F.sequence(F.lit(0), F.size("_gs") - 1)
    chosen = hashed.select("_key", "_h", "_gs", F.when(known.contains("+" * w), sel).alias("_sel"))
    return chosen.select("_key", F.inline_outer(let(F.col("_sel"), seed))).filter("pos IS NOT NULL")


def _equal_ahead(x: Column, y: Column, most: int) -> Column:
    """How many leading elements of two arrays of at most ``most`` elements are equal."""
    n = F.lit(0)
    for i in reversed(range(most)):
        n = F.when(F.get(x, F.lit(i)) == F.get(y, F.lit(i)), n + 1).otherwise(F.lit(0))
    return n


def _differ(c: str) -> Column:
    """The two sides have no or another neighbour."""
    return F.col(c).isNull() | F.col(f"{c}_b").isNull() | (F.col(c) != F.col(f"{c}_b"))


def _hits(a: DataFrame, a_key: str, a_text: str, b: DataFrame, b_key: str, b_text: str, k: int, g: int, w: int, unit: str) -> DataFrame:
    """Pairs of equal seeds whose neighbours differ on some side: the ends of chains of seeds that both texts have."""
    hb = _hashed(b, b_key, b_text, k, g, unit)
    rarity = _rarity(hb)
    sa, sb = _seeds(_hashed(a, a_key, a_text, k, g, unit), rarity, g, w), _seeds(hb, rarity, g, w)
    sb = sb.select(*[F.col(c).alias(f"{c}_b") for c in sb.columns])
    return sa.join(sb, (F.col("g1") == F.col("g1_b")) & (F.col("g2") == F.col("g2_b")) & (_differ("before") | _differ("after")))


def longest_shared_passage(a: DataFrame, a_key: str, a_text: str, b: DataFrame, b_key: str, b_text: str,
                           k: int = 8, unit: str = "word") -> DataFrame:
    """For every (a, b) pair sharing a run of ``k`` tokens, the longest common run of consecutive
    tokens -> (a_key, b_key, start_a, start_b, size); ties: smallest start_a, then start_b.

    Only seeds are joined: of every ``w = k // 2`` consecutive grams of ``k - w + 1`` tokens the rarest one of the second
    side. Two texts that share ``k`` tokens share the grams of a whole window, so they share its seed, at most ``w - 1``
    tokens away from either end of the run. Along the run both texts have the same seeds; the join keeps the
    hits whose neighbours differ, the ends of such chains (a repetitive text gives rows for its runs, not for all
    pairs of equal grams), joins chains that overlap and adds the equal tokens at both ends, which the seeds carry
    along. Seeds are joined by two independent 64-bit hashes; no text is read twice or joined. The join's
    strategy and the split of hot seeds are AQE's.
    """
    w = max(k // 2, 1)
    g = k - w + 1
    hits = _hits(a, a_key, a_text, b, b_key, b_text, k, g, w, unit)
    mark = F.struct("pos", _differ("before").alias("first"), _differ("after").alias("last"),
                    _equal_ahead(F.col("left"), F.col("left_b"), w - 1).alias("more_left"), _equal_ahead(F.col("right"), F.col("right_b"), w - 1).alias("more_right"))
    marks = hits.groupBy(F.col("_key").alias("a"), F.col("_key_b").alias("b"), (F.col("pos_b") - F.col("pos")).alias("_d")) \
        .agg(F.sort_array(F.collect_list(mark)).alias("m"))

    # a run goes on over the next mark if that is inside a chain, or starts one that the tokens so far reach
    goes_on = lambda prev, m: ~m["first"] | (m["pos"] <= prev["pos"] + F.lit(g))
    starts = F.filter("m", lambda m, i: (i == 0) | ~goes_on(F.get(F.col("m"), i - 1), m))
    stops = F.filter("m", lambda m, i: F.coalesce(~goes_on(m, F.get(F.col("m"), i + 1)), F.lit(True)))
    run = F.arrays_zip(F.transform(starts, lambda m: m["pos"] - m["more_left"]).alias("s"), F.transform(stops, lambda m: m["pos"] + g + m["more_right"]).alias("e"))
    runs = marks.select("a", "b", "_d", F.inline(run).alias("s", "e")).filter(F.col("e") - F.col("s") >= k)
    best = runs.groupBy("a", "b").agg(F.max(F.struct((F.col("e") - F.col("s")).alias("size"), (-F.col("s")).alias("na"), (-F.col("s") - F.col("_d")).alias("nb"))).alias("_m"))
    return best.select(F.col("a").alias(a_key), F.col("b").alias(b_key if b_key != a_key else b_key + "_b"),
                       (-F.col("_m.na")).cast("bigint").alias("start_a"), (-F.col("_m.nb")).cast("bigint").alias("start_b"),
                       F.col("_m.size").cast("bigint").alias("size"))
