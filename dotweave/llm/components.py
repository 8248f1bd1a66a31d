"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dotweave.llm.common import cut_lineage


def _print(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())


#: Up to so many edges are joined in one task, as shuffles of so few rows only cost files and tasks.
FEW = 200_000


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The smallest node that each node of a few edges is connected with."""
    up: dict = {}

    def top(x):
        root = x
        while up.setdefault(root, root) != root:
            root = up[root]
        while up[x] != root:
            up[x], x = root, up[x]
        return root

    kind = None
    for batch in batches:
        kind = batch.column(0).type
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            x, y = top(a), top(b)
            if x != y:
                up[max(x, y)] = min(x, y)
    if kind is not None:
        nodes = list(up)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, kind), pa.array([top(x) for x in nodes], kind)], names=["node", "root"])


def components(edges: DataFrame, few: int = FEW) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); the root is the smallest node of its component.

    Every step is a grouped minimum and a join, each round is cut by a
    checkpoint, and the driver sees two numbers a round; what is left is joined in
    one task as soon as it is at most ``few`` edges. An empty edge table gives an
    empty result.
    """
    kind = edges.schema["a"].dataType.simpleString()
    now = cut_lineage(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = _print(now)
    while mark[0]:
        if mark[0] <= few:
            return now.coalesce(1).mapInArrow(_joined, f"node {kind}, root {kind}")
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b"))).distinct()
        now = cut_lineage(small)
        before, mark = mark, _print(now)
        if mark == before:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", "b").distinct())
