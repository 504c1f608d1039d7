"""Global order statistics without a single-partition window.

Two shared building blocks:

* ``rank_cut_points`` finds, for given 0-based ranks, the element holding that rank in a
  (hash, key) order. It counts rows per hash-prefix bucket (65,536 buckets, partial aggregation),
  then sorts only the one bucket that contains each cut. Nothing but bucket counts and the cut
  rows reach the driver, and no task sorts more than one bucket.
* ``global_offsets`` gives every row the sum of a weight over all rows before it (exclusive prefix
  sum). Rows are cut into ranges of equal counts by sampled quantiles of the order columns; range
  totals become range bases, and the in-range running sum is a window partitioned by range.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HASH_BUCKET_HEX = 4  # 16**4 = 65,536 buckets of the md5 order


def md5_key(seed, key_col) -> Column:
    """Deterministic order key: md5 of ``'<seed>:<key>'`` (hex, same in DuckDB)."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key_col).cast("string")))


def bucket_counts(units: DataFrame, hash_col: str) -> list[tuple[str, int]]:
    """Rows per hash-prefix bucket (at most 65,536 rows reach the driver), sorted by bucket."""
    bucket = F.substring(F.col(hash_col), 1, HASH_BUCKET_HEX)
    rows = units.groupBy(bucket.alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()
    return sorted((r["b"], r["n"]) for r in rows)


def rank_cut_points(units: DataFrame, hash_col: str, key_col: str, cuts: list[int],
                    counts: list[tuple[str, int]] | None = None) -> list[tuple | None]:
    """Element (hash, key) at each 0-based rank in ``cuts`` (None when the rank is past the end).

    Only the buckets holding a cut are ranked, all in one job: the window is partitioned by
    bucket, so no task sorts more than one bucket (1/65,536 of the units on even hashes).
    """
    counts = bucket_counts(units, hash_col) if counts is None else counts
    targets = {}
    for c in cuts:
        before = 0
        for b, n in counts:
            if c < before + n:
                targets[c] = (b, c - before + 1)
                break
            before += n
    if not targets:
        return [None for _ in cuts]
    bucket = F.substring(F.col(hash_col), 1, HASH_BUCKET_HEX)
    wanted = sorted(set(targets.values()))
    w = Window.partitionBy("_b").orderBy(F.col(hash_col), F.col(key_col))
    ranked = (units.withColumn("_b", bucket).filter(F.col("_b").isin(sorted({b for b, _ in wanted})))
              .select("_b", hash_col, key_col, F.row_number().over(w).alias("_rn")))
    hit = F.lit(False)
    for b, r in wanted:
        hit = hit | ((F.col("_b") == F.lit(b)) & (F.col("_rn") == F.lit(r)))
    found = {(row["_b"], row["_rn"]): (row[hash_col], row[key_col]) for row in ranked.filter(hit).collect()}
    return [found[targets[c]] if c in targets else None for c in cuts]


def before_cut(hash_col: str, key_col: str, cut) -> Column:
    """Row ordered strictly before the cut element (always true when the cut is past the end)."""
    if cut is None:
        return F.lit(True)
    h, k = cut
    return (F.col(hash_col) < F.lit(h)) | ((F.col(hash_col) == F.lit(h)) & (F.col(key_col) < F.lit(k)))


def range_bounds(df: DataFrame, order: list[str], n_rows: int, n_ranges: int, per_range: int = 50, seed: int = 17) -> list[tuple]:
    """Bounds that cut ``df`` into about ``n_ranges`` ranges of equal row counts in ``order``: quantiles of a
    sample of ``per_range`` rows a range (what the driver holds). Bounds are whole order tuples, so a
    key that many rows share is cut too as long as a later order column tells its rows apart."""
    if n_ranges <= 1:
        return []
    share = min(1.0, per_range * n_ranges / max(n_rows, 1))
    sample = sorted(tuple(r) for r in df.select(*order).sample(False, share, seed).collect())
    picks = [sample[len(sample) * i // n_ranges] for i in range(1, n_ranges)] if sample else []
    return sorted(set(picks))


def range_number(df: DataFrame, order: list[str], bounds: list[tuple]) -> Column:
    """How many bounds lie before a row: a binary search over a constant array."""
    if not bounds:
        return F.lit(0)
    types = [df.schema[c].dataType.simpleString() for c in order]
    schema = "array<struct<" + ",".join(f"o{i}:{t}" for i, t in enumerate(types)) + ">>"
    table = F.from_json(F.lit(json.dumps([{f"o{i}": v for i, v in enumerate(b)} for b in bounds])), schema)
    mine = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)])

    def halve(acc, _):
        mid = F.floor((acc["lo"] + acc["hi"]) / 2).cast("int")
        open_ = acc["lo"] < acc["hi"]
        right = F.get(table, mid) < mine
        return F.struct(F.when(open_ & right, mid + 1).otherwise(acc["lo"]).alias("lo"),
                        F.when(open_ & ~right, mid).otherwise(acc["hi"]).alias("hi"))

    start = F.struct(F.lit(0).alias("lo"), F.lit(len(bounds)).alias("hi"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(len(bounds).bit_length() + 1)), start, halve, lambda acc: acc["lo"])


def global_offsets(df: DataFrame, order: list[str], weight_col: str, rows_per_range: int = 1_000_000,
                   out_col: str = "offset") -> tuple[DataFrame, int]:
    """Add ``out_col`` = sum of ``weight_col`` over the rows before this one in ``order``; also return the
    grand total. Rows equal in all of ``order`` must be interchangeable.

    Rows are cut into ranges of about ``rows_per_range`` by sampled quantiles; the ranges' totals become
    their bases on the driver (a number a range), and the running sum inside a range is a window
    partitioned by range. ``df`` is read three times (two narrow passes): pass a written table.
    Other columns ride along, nothing is joined back."""
    st = df.agg(F.count(F.lit(1)).alias("n"), F.sum(weight_col).alias("total")).collect()[0]
    if st["n"] == 0:
        return df.withColumn(out_col, F.lit(0).cast("bigint")), 0
    bounds = range_bounds(df, order, st["n"], math.ceil(st["n"] / rows_per_range))
    tagged = df.withColumn("_rng", range_number(df, order, bounds))
    totals = {r["_rng"]: r["t"] or 0 for r in tagged.groupBy("_rng").agg(F.sum(weight_col).alias("t")).collect()}
    bases, run = [], 0
    for i in range(len(bounds) + 1):
        bases.append(run)
        run += totals.get(i, 0)
    base = F.get(F.from_json(F.lit(json.dumps(bases)), "array<bigint>"), F.col("_rng"))
    w = Window.partitionBy("_rng").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = tagged.withColumn(out_col, (base + F.coalesce(F.sum(weight_col).over(w), F.lit(0))).cast("bigint"))
    return out.drop("_rng"), int(st["total"] or 0)
