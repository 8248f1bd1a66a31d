"""Exact radius and nearest-neighbour joins of point tables, image by image.

Both forms give the same rows. ``plain`` joins on the image and tests the
distance; it suits images of a few thousand points. ``grid`` cuts space into
squares (cubes) of the radius, deals every left point to the squares around it
and joins on the square, so an image of any size spreads over the cluster and a
point only meets points of the squares beside it. The nearest of a ``plain`` image
are found in its task, so that pairs beyond the nearest are never rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Images up to so many points are joined whole.
PLAIN_LIMIT = 2_000


def distance(dims: Sequence[str], left: str = "l", right: str = "r") -> Column:
    total = None
    for d in dims:
        delta = F.col(f"{left}.{d}") - F.col(f"{right}.{d}")
        total = delta * delta if total is None else total + delta * delta
    return F.sqrt(total)


def largest_image(points: DataFrame) -> int:
    return points.groupBy("image_id").count().agg(F.max("count")).first()[0] or 0


def radius_pairs(left: DataFrame, right: DataFrame, radius: float, dims: Sequence[str] = ("x", "y"), method: str = "auto", carry: Sequence[str] = ()) -> DataFrame:
    """(image_id, src, dst, distance, carry of dst) of all pairs of points (image_id, id, dims) up to ``radius`` apart."""
    if method == "auto":
        method = "plain" if largest_image(right) <= PLAIN_LIMIT else "grid"
    a = left.select("image_id", "id", *dims)
    b = right.select("image_id", "id", *dims, *carry)
    keys = ["image_id"]
    if method == "grid":
        cells = [f"c{k}" for k in range(len(dims))]
        b = b.withColumns({c: F.floor(F.col(d) / radius) for c, d in zip(cells, dims)})
        for c, d in zip(cells, dims):
            here = F.floor(F.col(d) / radius)
            a = a.withColumn(c, F.explode(F.array(here - 1, here, here + 1)))
        keys += cells
    elif method != "plain":
        raise ValueError("method: plain, grid or auto")
    condition = None
    for k in keys:
        equal = F.col(f"l.{k}") == F.col(f"r.{k}")
        condition = equal if condition is None else condition & equal
    met = a.alias("l").join(b.alias("r"), condition & (distance(dims) <= radius))
    return met.select(F.col("l.image_id").alias("image_id"), F.col("l.id").alias("src"), F.col("r.id").alias("dst"), distance(dims).alias("distance"), *[F.col(f"r.{c}").alias(c) for c in carry])


def nearest(pairs: DataFrame, k: int) -> DataFrame:
    """The k nearest per source, the smaller id first among equals; planned as a partial and a final top-k."""
    rank = F.expr("row_number() OVER (PARTITION BY image_id, src ORDER BY distance, dst)")
    return pairs.withColumn("rank", rank).where(F.col("rank") <= k).drop("rank")


#: Pairs of an image that its task holds at a time.
AT_ONCE = 1 << 20


def nearest_pairs(a: np.ndarray, b: np.ndarray, k: int, radius: float, same: tuple[np.ndarray, np.ndarray] | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, distance) of the k points of ``b`` (n, dims) nearest to each of ``a``, smaller j first among equals, some rows of ``a`` at a time; ``same``: numbers of both, of which equal ones don't meet."""
    by = np.argsort(b[:, 0], kind="stable")
    xs = b[by, 0]
    wide = radius + 1e-9 * (np.abs(a[:, 0]) + radius)
    lo, hi = np.searchsorted(xs, a[:, 0] - wide, "left"), np.searchsorted(xs, a[:, 0] + wide, "right")
    n = np.maximum(hi - lo, 0)
    ends = np.cumsum(n)
    start = 0
    while start < len(a):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + AT_ONCE, "right")))
        some = n[start:stop]
        i = np.repeat(np.arange(start, stop), some)
        j = by[np.arange(some.sum()) - np.repeat(np.cumsum(some) - some, some) + np.repeat(lo[start:stop], some)]
        total = np.zeros(len(i))
        for c in range(a.shape[1]):
            delta = a[i, c] - b[j, c]
            total = total + delta * delta
        d = np.sqrt(total)
        keep = d <= radius
        if same is not None:
            keep &= same[0][i] != same[1][j]
        i, j, d = i[keep], j[keep], d[keep]
        order = np.lexsort((j, d, i))
        i, j, d = i[order], j[order], d[order]
        first = np.flatnonzero(np.diff(i, prepend=-1))
        keep = np.arange(len(i)) - np.repeat(first, np.diff(first, append=len(i))) < k
        yield i[keep], j[keep], d[keep]
        start = stop


def coordinates(points: pa.Table, dims: Sequence[str]) -> np.ndarray:
    return np.stack([points.column(d).cast(pa.float64()).to_numpy() for d in dims], axis=1)


def by_image(left: DataFrame, right: DataFrame, run: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """``run`` over the points of each image; where both tables are one, it comes to the task once."""
    left_of = left.where("image_id IS NOT NULL").groupBy("image_id")
    if left is right:
        return left_of.applyInArrow(lambda rows: run(rows, rows), schema)
    return left_of.cogroup(right.where("image_id IS NOT NULL").groupBy("image_id")).applyInArrow(run, schema)


def _kind(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def _knn_of_images(left: DataFrame, right: DataFrame, k: int, radius: float, dims: Sequence[str], carry: Sequence[str], own: Sequence[str], include_self: bool) -> DataFrame:
    """``knn`` with an image's points in one task, of which only the nearest pairs leave."""
    one = left is right
    needed = list(dict.fromkeys(["image_id", "id", *dims, *own, *(carry if one else ())]))
    a = left.select(*needed)
    b = a if one else right.select(*dict.fromkeys(["image_id", "id", *dims, *carry]))
    names = ["image_id", "src", "dst", "distance", *carry, *(f"src_{c}" for c in own)]
    kinds = [_kind(left, "image_id"), _kind(left, "id"), _kind(right, "id"), "double", *(_kind(right, c) for c in carry), *(_kind(left, c) for c in own)]

    def run(x: pa.Table, y: pa.Table) -> pa.Table:
        y = y.take(pc.sort_indices(y, sort_keys=[("id", "ascending")]))
        number = lambda t: pc.fill_null(pc.index_in(t.column("id"), value_set=y.column("id").combine_chunks()), -1).to_numpy()
        same = None if include_self else (number(x), number(y))
        parts = list(nearest_pairs(coordinates(x, dims), coordinates(y, dims), k, radius, same)) if x.num_rows and y.num_rows else []
        i, j, d = (np.concatenate([p[c] for p in parts]) if parts else np.zeros(0, kind) for c, kind in enumerate((int, int, float)))
        mine, other = x.take(pa.array(i)), y.take(pa.array(j))
        columns = [mine.column("image_id"), mine.column("id"), other.column("id"), pa.chunked_array([pa.array(d)]), *(other.column(c) for c in carry), *(mine.column(c) for c in own)]
        return pa.table(columns, names)

    return by_image(a, b, run, ", ".join(f"`{n}` {t}" for n, t in zip(names, kinds)))


def knn(left: DataFrame, right: DataFrame, k: int, radius: float, dims: Sequence[str] = ("x", "y"), method: str = "auto", carry: Sequence[str] = (), include_self: bool = True, own: Sequence[str] = ()) -> DataFrame:
    """At most k neighbours within the radius; a point is its own first neighbour unless ``include_self`` is off.

    ``carry``: columns of the neighbour; ``own``: columns of the point itself, with src_ before their names.
    """
    if method == "auto":
        method = "plain" if largest_image(right) <= PLAIN_LIMIT else "grid"
    if method == "plain":
        return _knn_of_images(left, right, k, radius, dims, carry, own, include_self)
    pairs = radius_pairs(left, right, radius, dims, method, carry)
    if not include_self:
        pairs = pairs.where("src <> dst")
    found = nearest(pairs, k)
    if own:
        found = found.join(left.select("image_id", F.col("id").alias("src"), *[F.col(c).alias(f"src_{c}") for c in own]), ["image_id", "src"])
    return found


def as_points(spots: DataFrame) -> DataFrame:
    return spots.withColumnRenamed("spot_id", "id")
