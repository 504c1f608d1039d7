"""Reproducible splits and exact fraction samples.

Rows are ordered by ``md5('<seed>:<key>')`` (ties by key); split sizes are exact floors of the
unit count, as in a positional split of a shuffled index, but the order is a pure function of the
key, so a re-run (or a lost executor) assigns every key the same side.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.constants import SPLIT_SEED, VALIDATION_SHARE
from .ranking import before_cut, bucket_counts, md5_key, rank_cut_points


def _units(df: DataFrame, unit: str, seed, keys_unique: bool) -> DataFrame:
    u = df.select(unit)
    if not keys_unique:
        u = u.dropDuplicates([unit])
    return u.filter(F.col(unit).isNotNull()).withColumn("_h", md5_key(seed, unit))


def random_split(df: DataFrame, key: str, validate: bool = True, train_ratio: float = 0.8,
                 seed: int = SPLIT_SEED, group_key: str | None = None, keys_unique: bool = False,
                 split_col: str = "split") -> DataFrame:
    """Add ``split`` in {train, validation, test}: 80/10/10 (or 80/20 without validation).

    ``group_key`` keeps all rows of a group (e.g. a patient) on one side; sizes count groups.
    """
    unit = group_key or key
    units = _units(df, unit, seed, keys_unique)
    counts = bucket_counts(units, "_h")
    n = sum(c for _, c in counts)
    c_train = int(math.floor(train_ratio * n))
    cuts = [c_train]
    if validate:
        cuts.append(int(math.floor(((1.0 - train_ratio) / 2 + train_ratio) * n)))
    pts = rank_cut_points(units, "_h", unit, cuts, counts)
    h = md5_key(seed, unit)
    out = df.withColumn("_h", h)
    label = F.when(before_cut("_h", unit, pts[0]), F.lit("train"))
    if validate:
        label = label.when(before_cut("_h", unit, pts[1]), F.lit("validation"))
    label = label.otherwise(F.lit("test"))
    return out.withColumn(split_col, F.when(F.col(unit).isNotNull(), label)).drop("_h")


def exact_sample(df: DataFrame, key: str, fraction: float, seed: int = SPLIT_SEED,
                 keys_unique: bool = False) -> DataFrame:
    """Exactly ``floor(fraction * n)`` keys, the first in md5 order (without replacement)."""
    units = _units(df, key, seed, keys_unique)
    counts = bucket_counts(units, "_h")
    n = sum(c for _, c in counts)
    pts = rank_cut_points(units, "_h", key, [int(math.floor(fraction * n))], counts)
    return df.withColumn("_h", md5_key(seed, key)).filter(before_cut("_h", key, pts[0])).drop("_h")


def hash_sample(df: DataFrame, key: str, fraction: float, seed: int = SPLIT_SEED) -> DataFrame:
    """R3 (approximate size, no extra job): keep a key when its 32-bit md5 slot is below ``fraction``."""
    slot = F.conv(F.substring(md5_key(seed, key), 1, 8), 16, 10).cast("bigint")
    return df.filter(slot < F.lit(fraction * 4294967296.0))


def cohort_split(df: DataFrame, key: str, site_col: str, site, version_col: str, test_version,
                 validate: bool = True, validation_share: float = VALIDATION_SHARE, seed: int = SPLIT_SEED,
                 keys_unique: bool = False, split_col: str = "split") -> DataFrame:
    """R2: site == ``site`` and version != ``test_version`` -> train; == -> test; other sites and
    null versions are left out. With ``validate``, ``round_half_even(share * n_train)`` train keys
    (first in md5 order) become validation."""
    at_site = (F.col(site_col) == F.lit(site)) & F.col(version_col).isNotNull()
    side = F.when(at_site & (F.col(version_col) != F.lit(test_version)), F.lit("train")) \
        .when(at_site & (F.col(version_col) == F.lit(test_version)), F.lit("test"))
    out = df.withColumn(split_col, side).filter(F.col(split_col).isNotNull())
    if not validate:
        return out
    train = out.filter(F.col(split_col) == "train")
    units = _units(train, key, seed, keys_unique)
    counts = bucket_counts(units, "_h")
    n = sum(c for _, c in counts)
    k = int(round(validation_share * n))  # Python round: half to even
    pts = rank_cut_points(units, "_h", key, [k], counts)
    is_val = (F.col(split_col) == "train") & before_cut("_h", key, pts[0])
    return (out.withColumn("_h", md5_key(seed, key))
            .withColumn(split_col, F.when(is_val, F.lit("validation")).otherwise(F.col(split_col)))
            .drop("_h"))
