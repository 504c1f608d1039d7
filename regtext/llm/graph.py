"""Connected components of an undirected graph given as an edge table, as Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize


def _minima(both: DataFrame) -> DataFrame:
    return both.groupBy("u").agg(F.min("v").alias("m"))


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(node, root)`` for every node of ``edges(u, v)`` (longs); ``root`` is the smallest node of its
    component.

    Alternating large-star and small-star steps: every node hands its smaller neighbour to its other
    neighbours until each component is a star around its minimum, in O(log^2 n) rounds. A step is one
    partial aggregate (the neighbourhood minimum) and one equi-join, so a node with many neighbours
    is never gathered in one place: the aggregate combines before it shuffles, and the join reads two
    written tables, so that AQE may split a hot key. Every round is written under the shared folder; the
    driver sees a count and a checksum.
    """
    e = edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).filter("u < v").distinct()
    e = materialize(e, "components")
    before = _state(e)
    for _ in range(max_rounds if before[0] else 0):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = materialize(_minima(both).select("u", F.least("u", "m").alias("m")), "component-minima")
        large = both.join(low, "u").filter("v > u").select(F.col("m").alias("u"), "v").filter("u < v").distinct()
        large = materialize(large, "components-large")
        # small-star: every node keeps its neighbours below itself and links them and itself to the least
        down = large.select(F.col("v").alias("u"), F.col("u").alias("v"))
        low = materialize(_minima(down), "component-minima")
        small = down.join(low, "u").select(F.col("m").alias("u"), F.col("v")).filter("u < v") \
            .union(low.select(F.col("m").alias("u"), F.col("u").alias("v"))).distinct()
        e = materialize(small, "components")
        now = _state(e)
        if now == before:
            break
        before = now
    else:
        if before[0]:
            raise RuntimeError(f"components did not settle within {max_rounds} rounds")
    return e.select(F.col("v").alias("node"), F.col("u").alias("root")) \
        .union(e.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct())
