"""Operator 8, temperature mixing of sources, realised as budgeted block permutations.

Source s with token share p_s gets the weight w_s = p_s^a / sum p^a. The exponent a in [0, 1] is
bisected to the smallest value whose weights are no flatter than a target entropy and repeat no source
more than ``max_repeats`` times at the budget. Both conditions are monotone in a. Every round of
the search evaluates a grid of exponents in one aggregate over the per-source totals, so sources are
never collected, however many there are.

The weights are realised in whole tokens: source s gets ``floor(w_s * budget)``. That is a number of
whole epochs and a part of one more. Every epoch is its own permutation of the source's documents
(by a keyed md5), the last one cut where the budget ends. The source's stream of epochs is
spread evenly over ``blocks`` blocks, so every block holds every source at its weight; order inside a
block is the order of ``slot``.

Running totals in permutation order are two-level: totals per (source, epoch, hash bucket) first, then
inside a bucket, so a source with a third of all documents is never sorted by one task.

Defined cases: a NULL source is a source of its own; a NULL or blank text has no tokens and lies where
its hash puts it; a source without tokens has weight 0 and does not appear; repeated rows are documents
of their own; a NULL id hashes as the empty string; an empty table, or one without tokens, gives an
empty result; if even a = 1 breaks the repetition limit (budget over ``max_repeats`` times the corpus),
a = 1 is used; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import materialize
from .common import words

FLATTEN = 0.5        # where the target entropy lies between the corpus's (0) and the uniform one (1)
MAX_REPEATS = 4.0
BUDGET_RATIO = 2.0   # tokens of the mix per token of the corpus
BLOCKS = 64
SEED = 17
GRID = 32
ROUNDS = 8           # 32^-8: the exponent to about 1e-12
BUCKET_HEX = 3       # 4096 hash buckets a source and epoch


def token_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    return docs.select(F.col(key).alias("id"), F.col(source).alias("source"), F.size(words(F.col(text))).cast("long").alias("n"))


def exponent(shares: DataFrame, budget_ratio: float = BUDGET_RATIO, flatten: float = FLATTEN,
             max_repeats: float = MAX_REPEATS) -> float:
    """The exponent for ``shares(source, p)`` (positive shares that sum to 1)."""
    base = shares.agg(F.count("*"), F.sum(-F.col("p") * F.log("p")), F.min("p")).first()
    n, own, least = base
    if not n:
        return 1.0
    import math
    target = own + flatten * (math.log(n) - own)

    def fits(a, z, zl):  # zl: sum p^a ln p
        entropy = math.log(z) - a * zl / z
        return entropy <= target + 1e-12 and least ** (a - 1) / z * budget_ratio <= max_repeats + 1e-12

    lo, hi = 0.0, 1.0
    for _ in range(ROUNDS):
        grid = [lo + (hi - lo) * i / GRID for i in range(GRID + 1)]
        sums = shares.agg(*[f for a in grid for f in (F.sum(F.pow("p", F.lit(a))), F.sum(F.pow("p", F.lit(a)) * F.log("p")))]).first()
        good = [fits(a, sums[2 * i], sums[2 * i + 1]) for i, a in enumerate(grid)]
        first = good.index(True) if True in good else GRID
        lo, hi = grid[max(first - 1, 0)], grid[first]
    return hi


def _order_hash(seed: int, epoch: Column, key: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(key.cast("string"), F.lit(""))))


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source",
        budget_ratio: float = BUDGET_RATIO, flatten: float = FLATTEN, max_repeats: float = MAX_REPEATS,
        blocks: int = BLOCKS, seed: int = SEED, bucket_hex: int = BUCKET_HEX) -> DataFrame:
    """One row per drawn document: ``key``, ``source``, ``epoch``, ``block``, ``slot`` (order inside the
    block) and ``n_tokens``."""
    counted = materialize(token_counts(docs, key, text, source), "mix-tokens")
    totals = counted.groupBy("source").agg(F.sum("n").alias("tokens")).filter("tokens > 0")
    totals = materialize(totals, "mix-totals")
    whole = totals.agg(F.sum("tokens")).first()[0] or 0
    shares = totals.withColumn("p", F.col("tokens") / F.lit(float(max(whole, 1))))
    a = exponent(shares, budget_ratio, flatten, max_repeats)
    z = shares.agg(F.sum(F.pow("p", F.lit(a)))).first()[0] or 1.0
    plan = shares.select(F.col("source").alias("s"), "tokens", F.floor(
        F.pow("p", F.lit(a)) / F.lit(z) * F.lit(budget_ratio * whole)).cast("long").alias("target")) \
        .select("s", "target", F.floor(F.col("target") / F.col("tokens")).cast("long").alias("whole"), "tokens")

    rows = counted.join(plan, F.col("source").eqNullSafe(F.col("s"))).select(
        "id", "source", "n", "tokens", "target", F.explode(F.sequence(F.lit(0).cast("long"), F.col("whole"))).alias("epoch"))
    rows = rows.withColumn("h", _order_hash(seed, F.col("epoch"), F.col("id"))).withColumn("b", F.substring("h", 1, bucket_hex))
    group = ["source", "epoch"]
    per_bucket = rows.groupBy(*group, "b").agg(F.sum("n").alias("bn"))
    bases = per_bucket.select(F.col("source").alias("s_"), F.col("epoch").alias("e_"), F.col("b").alias("b_"), (F.sum("bn").over(
        W.partitionBy(*group).orderBy("b")) - F.col("bn")).alias("base"))
    inside = F.sum("n").over(W.partitionBy(*group, "b").orderBy("h", "id", "n").rowsBetween(W.unboundedPreceding, 0))
    placed = rows.withColumn("upto", inside).join(
        bases, F.col("source").eqNullSafe(F.col("s_")) & (F.col("epoch") == F.col("e_")) & (F.col("b") == F.col("b_")))
    upto = F.col("epoch") * F.col("tokens") + F.col("base") + F.col("upto")
    return placed.withColumn("end", upto).filter("end <= target").select(
        F.col("id").alias(key), "source", F.col("epoch").cast("int").alias("epoch"),
        F.least(F.expr(f"(end - n) * {blocks} div target"), F.lit(blocks - 1)).cast("int").alias("block"),
        F.md5(F.concat(F.lit(f"{seed}:"), F.col("h"))).alias("slot"), F.col("n").alias("n_tokens"))
