"""Operator 3, Merkle fixity audit of WARC replicas.

A replica is described by a record index ``(file, offset, length, digest, id)``. Leaves of a file's tree
are ranges of ``leaf_bytes`` of offsets; a leaf's digest hashes the ordered (offset, length, digest)
triples of the records that start in its range, an inner node the ordered digests of its at most
``fanout`` children. Trees of all files are built together, a grouped aggregate per level, and written
once. The audit compares the roots, then only the children of nodes that differ, level by level, and at
last the records of the differing leaves.

No group grows with a file: a leaf holds the records of a fixed range and a node ``fanout`` children, so
a file with a third of all records is only more groups.

Defined cases: repeated index rows count once; a NULL payload or URL is an empty one; a NULL file is a
file of its own; a record is placed by its offset (a NULL offset or negative one lies in leaf 0);
records at the same place with different content are all compared; empty tables give no findings; a
file that only one replica has is reported record by record; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import materialize
from .common import or_empty

LEAF_BYTES = 64 * 1024
FANOUT = 16
PAGES_PER_FILE = 500


def record(key: Column, url: Column, payload: Column) -> Column:
    """One WARC/1.0 resource record as text."""
    body = or_empty(payload)
    return F.concat(F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"), or_empty(key.cast("string")),
                    F.lit(">\r\nWARC-Target-URI: "), or_empty(url), F.lit("\r\nContent-Type: text/html\r\nContent-Length: "),
                    F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"))


def index_pages(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html",
                pages_per_file: int = PAGES_PER_FILE, copies: dict[str, Column] | None = None) -> DataFrame:
    """Record index of pages packed in key order into files of ``pages_per_file`` keys. ``copies`` names
    further payloads (of replicas) whose record digest and length are computed in the same scan as
    ``digest_<name>`` and ``length_<name>`` (NULL where the payload is NULL: no such record). Offsets are
    running lengths; only lengths and digests are shuffled for them."""
    rec = record(F.col(key), F.col(url), F.col(payload))
    extra = []
    for name, body in (copies or {}).items():
        there = lambda c, body=body: F.when(body.isNotNull(), c)
        other = record(F.col(key), F.col(url), body)
        extra += [there(F.sha2(other, 256)).alias(f"digest_{name}"), there(F.octet_length(other)).alias(f"length_{name}")]
    narrow = pages.select(F.floor(F.col(key) / pages_per_file).cast("long").alias("file"), F.col(key).alias("id"),
                          F.octet_length(rec).cast("long").alias("length"), F.sha2(rec, 256).alias("digest"), *extra)
    upto = F.sum("length").over(W.partitionBy("file").orderBy("id", "digest").rowsBetween(W.unboundedPreceding, 0))
    return narrow.withColumn("offset", upto - F.col("length"))


def _leaf(leaf_bytes: int) -> Column:
    return F.floor(F.greatest(F.coalesce("offset", F.lit(0)), F.lit(0)) / leaf_bytes).cast("long")


def height(indexes: list[DataFrame], leaf_bytes: int = LEAF_BYTES, fanout: int = FANOUT) -> int:
    """Levels above the leaves that bring every file to a single root."""
    last = max((i.agg(F.max(_leaf(leaf_bytes))).first()[0] or 0) for i in indexes)
    levels = 0
    while last > 0:
        last //= fanout
        levels += 1
    return levels


def tree(index: DataFrame, levels: int, leaf_bytes: int = LEAF_BYTES, fanout: int = FANOUT) -> DataFrame:
    """``(file, level, node, digest)`` for all nodes of all files; the root is node 0 of ``levels``."""
    item = F.concat_ws(":", F.coalesce(F.col("offset").cast("string"), F.lit("-")), F.col("length").cast("string"), F.col("digest"))
    entries = F.sort_array(F.collect_set(F.struct(F.col("offset").alias("o"), item.alias("i"))))
    node = index.groupBy("file", _leaf(leaf_bytes).alias("node")).agg(
        F.sha2(F.array_join(F.transform(entries, lambda e: e["i"]), "\n"), 256).alias("digest"))
    node = materialize(node.select("file", F.lit(0).alias("level"), "node", "digest"), "merkle-level")
    all_levels = node
    for level in range(1, levels + 1):
        children = F.sort_array(F.collect_list(F.struct("node", "digest")))
        node = node.groupBy("file", F.floor(F.col("node") / fanout).cast("long").alias("node")).agg(F.sha2(F.array_join(
            F.transform(children, lambda c: F.concat_ws(":", c["node"].cast("string"), c["digest"])), "\n"), 256).alias("digest")) \
            .select("file", F.lit(level).alias("level"), "node", "digest")
        node = materialize(node, "merkle-level")
        all_levels = all_levels.union(node)
    return all_levels


def _differing(a: DataFrame, b: DataFrame) -> DataFrame:
    """``(file, node)`` where the digests differ or one side has no node."""
    x = a.select(F.col("file").alias("fa"), F.col("node").alias("na"), F.col("digest").alias("da"))
    y = b.select(F.col("file").alias("fb"), F.col("node").alias("nb"), F.col("digest").alias("db"))
    both = x.join(y, F.col("fa").eqNullSafe(F.col("fb")) & (F.col("na") == F.col("nb")), "full")
    return both.filter(~F.col("da").eqNullSafe(F.col("db"))).select(
        F.when(F.col("na").isNull(), F.col("fb")).otherwise(F.col("fa")).alias("file"), F.coalesce("na", "nb").alias("node"))


def _under(nodes: DataFrame, parents: DataFrame, fanout: int) -> DataFrame:
    p = parents.select(F.col("file").alias("pf"), F.col("node").alias("pn"))
    return nodes.join(p, F.col("file").eqNullSafe(F.col("pf")) & (F.floor(F.col("node") / fanout) == F.col("pn")), "left_semi")


def differing_leaves(a: DataFrame, b: DataFrame, levels: int, fanout: int = FANOUT) -> DataFrame:
    """Leaves ``(file, node)`` reached from differing roots through differing nodes only."""
    bad = _differing(a.filter(F.col("level") == levels), b.filter(F.col("level") == levels))
    for level in range(levels - 1, -1, -1):
        bad = materialize(bad, "merkle-bad")
        at = F.col("level") == level
        bad = _differing(_under(a.filter(at), bad, fanout), _under(b.filter(at), bad, fanout))
    return bad


def audit(a: DataFrame, b: DataFrame, leaf_bytes: int = LEAF_BYTES, fanout: int = FANOUT) -> DataFrame:
    """Findings ``(file, offset, id, status, length_a, length_b)``: records ``missing`` from or ``extra`` in
    replica ``b``, and those ``resized`` or ``changed`` there."""
    levels = height([a, b], leaf_bytes, fanout)
    bad = materialize(differing_leaves(tree(a, levels, leaf_bytes, fanout), tree(b, levels, leaf_bytes, fanout),
                                       levels, fanout), "merkle-leaves")

    def suspects(index, side):
        p = bad.select(F.col("file").alias("pf"), F.col("node").alias("pn"))
        rows = index.join(p, F.col("file").eqNullSafe(F.col("pf")) & (_leaf(leaf_bytes) == F.col("pn")), "left_semi")
        return rows.select(*[F.col(c).alias(f"{c}_{side}") for c in ("file", "offset", "length", "digest", "id")]).distinct()

    same_place = F.col("file_a").eqNullSafe(F.col("file_b")) & F.col("offset_a").eqNullSafe(F.col("offset_b")) \
        & F.col("id_a").eqNullSafe(F.col("id_b"))
    both = suspects(a, "a").join(suspects(b, "b"), same_place, "full")
    in_a, in_b = F.col("digest_a").isNotNull(), F.col("digest_b").isNotNull()
    status = F.when(~in_b, "missing").when(~in_a, "extra").when(F.col("length_a") != F.col("length_b"), "resized") \
        .when(F.col("digest_a") != F.col("digest_b"), "changed")
    pick = lambda c: F.when(in_a, F.col(f"{c}_a")).otherwise(F.col(f"{c}_b")).alias(c)
    return both.withColumn("status", status).filter("status IS NOT NULL").select(
        pick("file"), pick("offset"), pick("id"), "status", F.col("length_a").cast("long"), F.col("length_b").cast("long"))
