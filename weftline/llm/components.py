"""Connected components: a counted, bounded number of edges in one task, more by
alternating large-star and small-star rounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise

#: Edges (16 bytes each) that one task takes at most.  A round is eight shuffles, whose
#: tasks take far longer to start than so few edges take to join.
FEW_EDGES = 1_000_000


def _join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, component) of all edges (u, v): a root goes below the smallest root that it
    meets until none meets another, which takes rounds in the logarithm of the nodes."""
    read = [b for b in batches if b.num_rows]
    if not read:
        return
    u, v = (np.concatenate([b.column(c).to_numpy() for b in read]) for c in ("u", "v"))
    nodes, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = ends[: len(u)], ends[len(u) :]
    root = np.arange(len(nodes))
    while len(a):
        np.minimum.at(root, np.maximum(root[a], root[b]), np.minimum(root[a], root[b]))
        while (root != (up := root[root])).any():
            root = up
        apart = root[a] != root[b]
        a, b = a[apart], b[apart]
    yield from pa.table({"node": nodes, "component": nodes[root]}).to_batches(max_chunksize=1 << 16)


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star round over edges (u, v) with u > v.

    The smallest neighbour of a node is a partial aggregate, and the join back
    to the node's edges is one that adaptive execution can split, so a hub with
    millions of neighbours is no single task."""
    near = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = near.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    moved = near.join(least, "u")
    if large:
        out = moved.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = moved.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        out = out.unionByName(least.select("u", F.col("m").alias("v")))
    return out.distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``edges``: columns u, v (long).  Returns (node, component) for every node
    with an edge to another; the component is its smallest node.

    Null ends and loops are ignored; an empty input gives an empty result.  The edges
    are read twice, the second time by one task where they are at most FEW_EDGES, so
    they should be a written frame."""
    e = edges.where("u is not null and v is not null and u <> v")
    e = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    if e.count() <= FEW_EDGES:
        return e.coalesce(1).mapInArrow(_join, "node long, component long")
    e, mark = materialise(e.distinct(), "cc"), None
    for _ in range(max_rounds):
        row = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.hash("u", "v"))).head()
        if tuple(row) == mark or not row[0]:
            break
        mark, before = tuple(row), e
        e = materialise(_star(_star(e, True), False), "cc")
        discard(before)
    else:
        raise RuntimeError(f"no fixed point in {max_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
