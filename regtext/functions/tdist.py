"""Student-t critical values without scipy.

For whole degrees of freedom the probability of ``|T| <= t`` is a finite sum over powers of a cosine; it is
inverted by bisection. Values for 1..TABLE_DOF degrees of freedom are computed once on the
driver and used as a literal array; beyond that a Cornish-Fisher expansion in the normal
quantile is exact to well below 1e-6.
"""

from __future__ import annotations

import math
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

TABLE_DOF = 400


def central_share(t: float, dof: int) -> float:
    """P(|T| <= t) for ``t >= 0``. With the angle of t / sqrt(dof), even degrees of freedom give the sine times
    1 + 1/2 cos^2 + 3/8 cos^4 + ..., odd ones the angle plus the sine times cos + 2/3 cos^3 + ..., over a quarter turn."""
    angle = math.atan(t / math.sqrt(dof))
    sine, square = math.sin(angle), math.cos(angle) ** 2
    odd = dof % 2
    term = math.cos(angle) if odd else 1.0
    total = term if dof > 1 else 0.0
    for k in range(2 + odd, dof, 2):
        term *= square * (k - 1) / k
        total += term
    return (angle + sine * total) * 2.0 / math.pi if odd else sine * total


@lru_cache(maxsize=None)
def t_ppf(q: float, dof: int) -> float:
    """The quantile at ``q`` for whole degrees of freedom."""
    share = abs(2.0 * q - 1.0)
    low, high = 0.0, 1.0
    while central_share(high, dof) < share:
        high *= 2.0
    for _ in range(100):
        middle = (low + high) / 2.0
        if central_share(middle, dof) < share:
            low = middle
        else:
            high = middle
    return math.copysign((low + high) / 2.0, q - 0.5)


def normal_ppf(q: float) -> float:
    lo, hi = -40.0, 40.0
    for _ in range(200):
        mid = (lo + hi) / 2.0
        if 0.5 * math.erfc(-mid / math.sqrt(2.0)) < q:
            lo = mid
        else:
            hi = mid
    return (lo + hi) / 2.0


@lru_cache(maxsize=None)
def t_table(confidence: float = 0.95) -> list[float]:
    q = 1.0 - (1.0 - confidence) / 2.0
    return [t_ppf(q, d) for d in range(1, TABLE_DOF + 1)]


def cornish_fisher_terms(confidence: float = 0.95) -> tuple[float, float, float, float]:
    z = normal_ppf(1.0 - (1.0 - confidence) / 2.0)
    g1 = (z ** 3 + z) / 4.0
    g2 = (5 * z ** 5 + 16 * z ** 3 + 3 * z) / 96.0
    g3 = (3 * z ** 7 + 19 * z ** 5 + 17 * z ** 3 - 15 * z) / 384.0
    return z, g1, g2, g3


def t_critical(dof_col: Column, confidence: float = 0.95) -> Column:
    """Two-sided critical t value for an integer degrees-of-freedom column (NULL for dof < 1)."""
    tab = F.array(*[F.lit(v) for v in t_table(confidence)])
    z, g1, g2, g3 = cornish_fisher_terms(confidence)
    v = dof_col.cast("double")
    approx = F.lit(z) + F.lit(g1) / v + F.lit(g2) / (v * v) + F.lit(g3) / (v * v * v)
    return (F.when(dof_col < 1, F.lit(None).cast("double"))
            .when(dof_col <= TABLE_DOF, F.element_at(tab, dof_col.cast("int")))
            .otherwise(approx))
