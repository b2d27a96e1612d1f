"""Connected components of an edge table, by alternating large-star and small-star steps.

Each round is a few aggregations and joins keyed by node; edges per node go down to one star edge. A hub's
neighbours are never gathered: a star step needs their minimum only, which partial aggregation finds, and which goes
to a hub's edges where they are (``join_hot``). A table of at most FEW_EDGES edges is solved by union-find in one task
instead, which holds so many at most; the result is the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, join_hot

FEW_EDGES = 300_000


def _united(edges: DataFrame) -> DataFrame:
    """(node, component) of few edges (u, v), in one task."""

    def run(part: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict = {}
        kind = None

        def find(x):
            while (up := parent.setdefault(x, x)) != x:
                parent[x] = parent[up]
                x = up
            return x

        for batch in part:
            kind = batch.schema.field(0).type
            for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                p, q = find(u), find(v)
                if p != q:
                    parent[max(p, q)] = min(p, q)
        nodes = list(parent)
        for at in range(0, len(nodes), 50_000):
            some = nodes[at : at + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(some, kind), pa.array([find(x) for x in some], kind)], names=["node", "component"])

    kind = edges.schema["u"].dataType.simpleString()
    return edges.select("u", "v").coalesce(1).mapInArrow(run, f"node {kind}, component {kind}")


def _star(edges: DataFrame, large: bool, n: int) -> DataFrame:
    """One star step over at most n (u, v) rows with u > v."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("edges")).withColumn("m", F.least("m", "u"))
    joined = join_hot(both, least, ["u"], "edges", total=2 * n)
    if large:
        moved = joined.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return moved.filter(F.col("u") != F.col("v")).distinct()


def connected_components(edges: DataFrame, scratch: Scratch, rounds: int = 60) -> DataFrame:
    """(node, component) of the nodes of edges (a, b); the component is its smallest node.

    Self-links and nulls are ignored. Raises if the rounds don't suffice (they grow with the logarithm of the nodes).
    """
    now = edges.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now = scratch.save(now, "cc0")
    seen, n = None, now.count()
    if n <= FEW_EDGES:
        return scratch.save(_united(now), "united")
    for i in range(1, rounds + 1):
        # A large step leaves one edge for each, a small step one more for each of its nodes at most.
        new = scratch.save(_star(_star(now, True, n), False, n), f"cc{i}")
        state = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        scratch._remove(f"{scratch.root}/cc{i - 1}")
        now, n = new, state[0]
        if state == seen:
            nodes = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
            return nodes.union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        seen = state
    raise RuntimeError(f"components didn't settle in {rounds} rounds")
