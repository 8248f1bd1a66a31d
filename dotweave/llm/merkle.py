"""Merkle manifest of a table, and proofs by descent through a content-addressed graph.

Every row is a leaf, every group of rows (``group``) a tree over its leaves in the
order of ``order``, and the roots of the groups, in the order of their names, are
the leaves of one more tree. A node is the SHA-256 of its children's hex digests, put
one behind another; ``fanout`` children make a node, the last node of a level may
have fewer, even one.

Trees are built and stored in segments: the nodes that stand over up to ``SEGMENT``
consecutive ones make one segment, which is folded in one task, so no group, however
large, lies in one. The store holds a record (segment, digest, children) for every
inner node; equal segments are stored once. A proof starts at the root: the digits of
a leaf's rank select a child in each record, the other children are collected, and
the segments' pieces of path, which run downwards, are reversed into the order in
which a verifier folds them. Only requests of one segment meet its records.

Edge cases: null values are marked in the leaf, so they differ from empty ones; a
null group is a group of its own, before all others; null order values come first;
rows alike in group and order stand in the order of their leaves, and equal rows are
leaves of their own; texts of any length are hashed whole inside the JVM; other
columns, whatever their names, are not read; an empty table has no proofs.
"""

from __future__ import annotations

import hashlib
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dotweave.llm.common import shared_folder

#: At most so many neighbouring nodes are folded, or asked for, in one task at a time.
SEGMENT = 4096
#: Copies of a segment's records that are dealt out where very many equal segments are asked for.
COPIES = 16

PROOF = "array<struct<place:int,others:array<string>>>"
RECORDS = "segment string, digest string, children array<string>"


def leaf(values: list[Column]) -> Column:
    """The digest of one row: each value as `-` if it is null, else its number of UTF-8 bytes, `:` and itself."""
    parts = [F.coalesce(F.concat(F.octet_length(v.cast("string")).cast("string"), F.lit(":"), v.cast("string")), F.lit("-")) for v in values]
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def group_key(group: Column) -> Column:
    """A group's name that is never null and sorts like the name, null first."""
    return F.coalesce(F.concat(F.lit("+"), group.cast("string")), F.lit(""))


def written(df: DataFrame) -> DataFrame:
    """``df`` as a table in the shared folder."""
    place = f"{shared_folder(df.sparkSession)}/merkle-{uuid.uuid4().hex}"
    df.write.parquet(place)
    return df.sparkSession.read.parquet(place)


def ranked(nodes: DataFrame, order: list[str]) -> DataFrame:
    """``nodes`` with ``rank`` (from 0, by ``order``, then digest) and ``n`` in their group.

    Rows are dealt to ranges and counted per range; a range's offset is the sum
    over the ranges before it. Equal rows may be split between ranges anywhere.
    """
    by = ["group", *order, "digest"]
    ranges = nodes.withColumn("salt", F.monotonically_increasing_id()).repartitionByRange(*by, "salt").drop("salt").withColumn("part", F.spark_partition_id())
    held = written(ranges)  # ranges are drawn from a sample, so they must not be drawn twice
    from pyspark.sql import Window

    counts = held.groupBy("group", "part").agg(F.count("*").alias("here"))
    whole = Window.partitionBy("group")
    offsets = counts.select("group", "part", (F.sum("here").over(whole.orderBy("part")) - F.col("here")).alias("before"), F.sum("here").over(whole).alias("n"))
    within = Window.partitionBy("group", "part").orderBy(*order, "digest")
    return held.withColumn("at", F.row_number().over(within) - 1).join(offsets, ["group", "part"]).withColumn("rank", F.col("before") + F.col("at")).drop("part", "before", "at")


def _levels(n: int, fanout: int) -> int:
    count = 0
    while n > 1:
        n, count = -(-n // fanout), count + 1
    return count


def _depth(fanout: int) -> int:
    """The levels of a segment."""
    if not 2 <= fanout <= SEGMENT:
        raise ValueError(f"a node needs 2 to {SEGMENT} children")
    depth = 1
    while fanout ** (depth + 1) <= SEGMENT:
        depth += 1
    return depth


@dataclass
class Tree:
    """``roots`` (group, n, digest), the store's ``records`` and the number of segments from leaf to root."""

    fanout: int
    segments: int
    records: DataFrame
    roots: DataFrame


def build(nodes: DataFrame, fanout: int = 2) -> Tree:
    """The trees over ``nodes`` (group, rank, n, digest)."""
    spark = nodes.sparkSession
    depth = _depth(fanout)
    width = fanout**depth

    def fold(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        group, n, block = (k.as_py() for k in key)
        level = rows.sort_by("rank").column("digest").to_pylist()
        kept: dict[str, list[str]] = {}
        for _ in range(min(depth, _levels(n, fanout))):
            level = [level[i : i + fanout] for i in range(0, len(level), fanout)]
            made = [hashlib.sha256("".join(children).encode()).hexdigest() for children in level]
            kept.update(zip(made, level))
            level = made
        k = len(kept)
        return pa.table({
            "group": pa.array([group] * k, pa.string()), "n": pa.array([n] * k, pa.int64()), "block": pa.array([block] * k, pa.int64()), "segment": pa.array(level * k, pa.string()),
            "digest": pa.array(list(kept), pa.string()), "children": pa.array(list(kept.values()), pa.list_(pa.string())),
        })

    level, records, roots = nodes.select("group", "rank", "n", "digest"), [], []
    while True:
        roots.append(level.where("n = 1").select("group", "digest"))
        level = level.where("n > 1")
        if level.isEmpty():
            break
        made = written(level.withColumn("block", F.expr(f"rank div {width}")).groupBy("group", "n", "block").applyInArrow(fold, "group string, n bigint, block bigint, " + RECORDS))
        tops = made.where("digest = segment")
        once = tops.groupBy("segment").agg(F.min(F.struct("group", "block")).alias("first")).select("first.*")
        records.append(made.join(once, ["group", "block"], "left_semi").select("segment", "digest", "children"))
        level = tops.select("group", F.col("block").alias("rank"), F.ceil(F.col("n") / width).alias("n"), F.col("segment").alias("digest"))
    store = spark.createDataFrame([], RECORDS)
    for one in records:
        store = store.unionAll(one)
    found = roots[0]
    for one in roots[1:]:
        found = found.unionAll(one)
    return Tree(fanout, len(records), store, found)


def _occurrences(paths: DataFrame, records: DataFrame) -> DataFrame:
    """Every path with the records of the segment that begins at its node; segments that many paths share are dealt out."""
    times = paths.groupBy("digest").agg(F.count("*").alias("times")).where(F.col("times") > COPIES)
    asked = paths.join(times, "digest", "left").withColumn("part", F.when(F.col("times").isNotNull(), F.pmod("block", F.lit(COPIES))).otherwise(0)).drop("times")
    copied = records.join(times.withColumnRenamed("digest", "segment"), "segment", "left")
    copied = copied.select("segment", F.col("digest").alias("node"), "children", F.explode(F.when(F.col("times").isNotNull(), F.sequence(F.lit(0), F.lit(COPIES - 1))).otherwise(F.array(F.lit(0)))).alias("part"))
    met = asked.join(copied, (asked["digest"] == copied["segment"]) & (asked["part"] == copied["part"]), "left")
    top = F.col("node").isNull() | (F.col("node") == F.col("segment"))
    above = [F.when(top, F.col(c)).alias(c) for c in ("digest", "above")]
    return met.select("group", "block", "n", "node", "children", *above)


def prove(tree: Tree, requests: DataFrame, paths: DataFrame) -> DataFrame:
    """``requests`` (group, rank and other columns) with the ``digest`` at that rank and its ``proof``.

    ``paths`` (group, n, digest, above) gives each group's size, root and the
    proof of that root in the tree above. A proof lists, from the leaf to
    the root, a node's ``place`` among its parent's children and the
    ``others``. Requests for a group or rank that isn't there are left out.
    """
    fanout, depth = tree.fanout, _depth(tree.fanout)
    width = fanout**depth
    sizes = paths.select("group", "n")
    paths = paths.withColumn("block", F.lit(0).cast("bigint"))
    for s in reversed(range(max(tree.segments, 1))):
        if s:
            wanted = requests.select("group", F.expr(f"rank div {width**s}").alias("rank")).distinct()
        else:
            wanted = requests
        here = paths.withColumn("n", F.ceil(F.col("n") / width**s))
        paths = _walk(wanted, _occurrences(here, tree.records), fanout, depth)
        if s:
            paths = written(paths).join(sizes, "group").select("group", F.col("rank").alias("block"), "n", "digest", F.col("proof").alias("above"))
    return paths


def _walk(wanted: DataFrame, known: DataFrame, fanout: int, depth: int) -> DataFrame:
    """``wanted`` with the node at their rank and its proof; all requests of a segment walk down it together, a level at a time."""
    width = fanout**depth
    # Named anew, as both sides may stem from one table.
    left = wanted.select(*[F.col(f"`{c}`").alias(c) for c in wanted.columns], F.expr(f"rank div {width}").alias("block"))
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in wanted.schema)}, digest string, proof {PROOF}"
    kind = pa.list_(pa.struct([("place", pa.int32()), ("others", pa.list_(pa.string()))]))
    names = wanted.columns

    def walk(asked: pa.Table, records: pa.Table) -> pa.Table:
        ranks = asked.column("rank").to_numpy()
        tops = [(n, d, a) for n, d, a in zip(records.column("n").to_pylist(), records.column("digest").to_pylist(), records.column("above").to_pylist()) if d is not None]
        if not tops:
            asked, ranks = asked.slice(0, 0), ranks[:0]
            n, top, above = 0, "", []
        else:
            n, top, above = tops[0]
        inside = (ranks >= 0) & (ranks < n)
        asked, ranks = asked.filter(pa.array(inside)), ranks[inside]
        digests: list[str] = [top]
        number: dict[str, int] = {top: 0}
        children = dict(zip(records.column("node").to_pylist(), records.column("children").to_pylist()))
        for some in children.values():
            for d in some or ():
                if d not in number:
                    number[d] = len(digests)
                    digests.append(d)
        table = np.full((len(digests), fanout), -1)
        for node, some in children.items():
            if node is not None:
                table[number[node], : len(some)] = [number[d] for d in some]
        m, at, levels = len(ranks), np.zeros(len(ranks), dtype=np.int64), min(depth, _levels(n, fanout))
        places, others = [], []
        for k in reversed(range(levels)):  # downwards by the digits of the rank
            digit = (ranks // fanout**k) % fanout
            below = table[at]
            places.append(digit)
            rest = below.copy()
            rest[np.arange(m), digit] = -1
            others.append(rest)
            at = below[np.arange(m), digit]
        # Reversed: upwards, request by request; then what lies above the segment.
        place = np.stack(places[::-1], axis=1) if levels else np.zeros((m, 0), dtype=np.int64)
        other = np.stack(others[::-1], axis=1) if levels else np.zeros((m, 0, fanout), dtype=np.int64)
        over_place = np.array([p["place"] for p in above], dtype=np.int64)
        over = np.full((len(above), fanout), -1)
        for i, p in enumerate(above):
            for j, d in enumerate(p["others"]):
                over[i, j] = len(digests)
                digests.append(d)
        place = np.concatenate([place, np.tile(over_place, (m, 1))], axis=1)
        other = np.concatenate([other, np.tile(over, (m, 1, 1))], axis=1)
        steps = place.shape[1]
        flat = other.reshape(m * steps, fanout)
        some = flat >= 0
        names_of = pa.array(digests, pa.string())
        lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(some.sum(axis=1))]).astype(np.int32), names_of.take(pa.array(flat[some])))
        pairs = pa.StructArray.from_arrays([pa.array(place.reshape(-1), pa.int32()), lists], ["place", "others"])
        proof = pa.ListArray.from_arrays((np.arange(m + 1) * steps).astype(np.int32), pairs).cast(kind)
        out = asked.select(names)
        return out.append_column("digest", names_of.take(pa.array(at))).append_column("proof", proof)

    return left.groupBy("group", "block").cogroup(known.groupBy("group", "block")).applyInArrow(walk, schema)


def folded(start: Column, proof: Column) -> Column:
    """The root that a leaf and its proof lead to."""

    def up(h: Column, step: Column) -> Column:
        others = step["others"]
        before = F.array_join(F.slice(others, F.lit(1), step["place"]), "")
        behind = F.array_join(F.slice(others, step["place"] + 1, F.greatest(F.size(others) - step["place"], F.lit(0))), "")
        return F.sha2(F.concat(before, h, behind).cast("binary"), 256)

    return F.aggregate(proof, start, up)


def proof_digest(proof: Column) -> Column:
    """The digest of all the other children in order."""
    return F.sha2(F.array_join(F.flatten(F.transform(proof, lambda s: s["others"])), "").cast("binary"), 256)


def manifest(leaves: DataFrame, order: list[str], fanout: int = 2) -> DataFrame:
    """``leaves`` (group, digest, ``order`` and other columns) with ``subroot``, ``root`` and ``proof`` of each."""
    at = written(ranked(leaves, order))
    trees = build(at, fanout)
    sizes = at.groupBy("group").agg(F.max("n").alias("n"))
    subroots = trees.roots.select(F.lit("").alias("group"), F.col("group").alias("name"), "digest")
    named = written(ranked(subroots, ["name"]))
    over = build(named, fanout)
    ends = over.roots.crossJoin(named.agg(F.max("n").alias("n")))  # one row with one row
    above = written(prove(over, named.select("group", "rank", "name"), ends.select("group", "n", "digest", F.array().cast(PROOF).alias("above"))))
    paths = above.select(F.col("name").alias("group"), "digest", F.col("proof").alias("above")).join(sizes, "group")
    proofs = prove(trees, at.drop("n").withColumnRenamed("digest", "leaf"), paths.select("group", "n", "digest", "above"))
    tops = above.select(F.col("name").alias("group"), F.col("digest").alias("subroot")).crossJoin(F.broadcast(over.roots.select(F.col("digest").alias("root"))))  # the root is one row
    return proofs.join(tops, "group").drop("digest", "rank")
