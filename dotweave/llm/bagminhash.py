"""Near-duplicate classes of texts by BagMinHash over bags of five-word shingles.

Each shingle of a bag carries its count as weight. Weights are discretised at
the dyadic levels 0, 1, 2, 4, ...; every level of every shingle owns a Poisson
process in time whose rate is the width of the level. A point of a process is
placed inside its level by descending a binary splitting of the level (the bits
of one uniform number) and counts for the bags whose weight reaches it. Each
point goes to one of the signature's components, which keep their first point,
so two components agree with probability equal to the weighted Jaccard
similarity. A bag of total weight W only needs the points up to a time of about
m (ln m + 3) / W; the few bags with an empty component double their time.

Bands of the signature give candidate buckets. Every bucket compares its members
with one pivot, the member met most often in other buckets; links are verified on
whole bags and joined into components. Buckets that still hold two components
are then compared in full, in blocks, so nothing is capped and members already in
one component are never paired again; of a large bucket only those links leave
a block that join two components.

Equal texts are one row before any text moves: each task gives one text a key.
What a hot pivot or a hot text is joined with is dealt to as many parts as it needs.

Edge cases: texts are compared whole, however long (a task holds some texts, or one
long one, at a time), nulls as the empty text; equal texts are one class before any
signature; a text under five words is one shingle; texts without words have no
shingle and only join their equals; ids may be null or repeated, a class takes the
smallest id it has (null if it has none); of equal rows one is kept; an empty table
gives an empty table; other columns pass through ``keep_one`` whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dotweave.llm.common import cut_lineage, deal
from dotweave.llm.components import components

WORDS = 5
SIMILARITY = 0.8
BANDS, ROWS = 24, 5
SIZE = BANDS * ROWS
#: A pair is verified on its bags if its signatures agree at least so far: four standard deviations below the similarity asked for.
SLACK = 4.0
#: Buckets up to so many rows give their likely pairs; larger ones are compared in blocks of so many rows, where only links leave the task.
FEW = 48
BLOCK = 1024
#: Bytes of text that a task turns into bags at a time, and elements that it compares.
BATCH_BYTES = 1_000_000
BATCH_ELEMENTS = 500_000
#: A pivot's pairs are dealt to parts of so many.
PART = 256

_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
_C = [np.uint64(x) for x in _ODD]


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; works on its argument in place."""
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _times(k: int, odd: int) -> np.uint64:
    return np.uint64(k * odd & 0xFFFFFFFFFFFFFFFF)


def _uniform(x: np.ndarray) -> np.ndarray:
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def _slices(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of neighbours of at most ``most`` together, or single ones."""
    ends = np.cumsum(sizes)
    at = 0
    while at < len(ends):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
        yield at, to
        at = to


def shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, shingle, count) of the bags of some texts, sorted by text and shingle."""
    split = pc.utf8_split_whitespace(texts)
    words = split.flatten()
    real = pc.not_equal(words, "")
    doc = pc.list_parent_indices(split).filter(real).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = words.filter(real).dictionary_encode()
    if not len(doc):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    names = np.fromiter((xxhash.xxh64_intdigest(w) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    length = np.bincount(doc, minlength=len(texts))
    # A text of fewer words is filled up to one shingle.
    filled = np.where((length > 0) & (length < WORDS), WORDS, length)
    begins = np.cumsum(filled) - filled
    h = np.zeros(filled.sum(), np.uint64)
    h[begins[doc] + np.arange(len(doc)) - (np.cumsum(length) - length)[doc]] = names[coded.indices.to_numpy(zero_copy_only=False)]
    doc = np.repeat(np.arange(len(texts)), filled)
    n = len(h) - WORDS + 1
    s = np.zeros(n, np.uint64)
    for k in range(WORDS):
        s += (h[k : k + n] ^ (h[k : k + n] >> np.uint64(29))) * _C[k]
    s = _mix(s)
    inside = doc[:n] == doc[WORDS - 1 :]
    doc, s = doc[:n][inside], s[inside]
    order = np.lexsort((s, doc))
    doc, s = doc[order], s[order]
    first = np.flatnonzero(np.concatenate(([True], (s[1:] != s[:-1]) | (doc[1:] != doc[:-1]))))
    return doc[first], s[first], np.diff(np.append(first, len(s)))


def signatures(doc: np.ndarray, shingle: np.ndarray, count: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(total weight, first-point times) of ``n`` bags; a bag without shingles has no finite time."""
    total = np.bincount(doc, count, n).astype(np.int64)
    times = np.full((n, SIZE), np.inf)
    limit = SIZE * (np.log(SIZE) + 3) / np.maximum(total, 1)
    todo = total > 0
    while todo.any():
        flat = np.full(n * SIZE, np.inf)
        live = todo[doc]
        d, s, c = doc[live], shingle[live], count[live].astype(np.float64)
        level = 0
        while len(d):
            low, width = (0.0, 1.0) if level == 0 else (2.0 ** (level - 1), 2.0 ** (level - 1))
            _points(flat, d, s, c, limit, level, low, width)
            more = c > low + width
            d, s, c = d[more], s[more], c[more]
            level += 1
        found = flat.reshape(n, SIZE)
        full = np.isfinite(found).all(axis=1) & todo
        times[full] = found[full]
        todo &= ~full
        limit[todo] *= 2
    return total, times


def _points(flat, d, s, c, limit, level: int, low: float, width: float) -> None:
    """Adds the points of one level's processes up to each bag's time."""
    t = np.zeros(len(d))
    end = limit[d]
    base = s + _times(level + 1, _ODD[3])
    i = 0
    while len(d):
        x = _mix(base ^ _times(i + 1, _ODD[4]))
        t = t - np.log(_uniform(x)) / width
        live = t <= end
        d, c, t, end, base, x = d[live], c[live], t[live], end[live], base[live], x[live]
        y = _mix(x + _C[0])
        kept = slice(None) if level == 0 else low + width * _uniform(y) < c
        z = _mix(y + _C[1]) % np.uint64(SIZE)
        np.minimum.at(flat, d[kept] * SIZE + z[kept].astype(np.int64), t[kept])
        i += 1


def _rows(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """A binary column of so many bytes of ``values`` each."""
    ends = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(np.ascontiguousarray(values).tobytes())])


def _numbers(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of a binary column end to end, and how many each row has."""
    sizes = pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64) // np.dtype(kind).itemsize
    _, ends, data = column.cast(pa.binary()).buffers()
    begin = int(np.frombuffer(ends, np.int32)[column.offset]) if len(column) else 0
    values = np.frombuffer(data, np.uint8)[begin : begin + int(sizes.sum()) * np.dtype(kind).itemsize] if data is not None else np.zeros(0, np.uint8)
    return values.view(kind), sizes


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The signature and bands of each text; of equal texts that are neighbours in a task only the first has them."""
    for batch in batches:
        for at, to in _slices(pc.binary_length(batch.column("body")).to_numpy(zero_copy_only=False), BATCH_BYTES):
            part = batch.slice(at, to - at)
            codes = part.column("key").dictionary_encode().indices.to_numpy(zero_copy_only=False)
            first = np.zeros(len(codes), bool)
            first[np.unique(codes, return_index=True)[1]] = True
            total, times = signatures(*shingles(part.column("body").filter(pa.array(first))), int(first.sum()))
            sig = (_mix(times.view(np.uint64).copy()) & np.uint64(0xFFFF)).astype("<u2")
            band = np.zeros((len(sig), BANDS), np.uint64)
            for r in range(ROWS):
                band = _mix(band * _C[2] + sig[:, r::ROWS].astype(np.uint64))
            band = _mix(band ^ (np.arange(1, BANDS + 1, dtype=np.uint64) * _C[0])).view(np.int64)
            every, own = np.zeros(len(codes), np.int64), np.flatnonzero(first)
            every[own] = BANDS * (total > 0)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(every))), pa.int32()), pa.array(band[total > 0].ravel()))
            width = np.where(first, 2 * SIZE, 0)
            yield pa.RecordBatch.from_arrays([part.column("key"), part.column("id"), pc.if_else(pa.array(first), _rows(sig, width), None), pc.if_else(pa.array(first), lists, None)], names=["key", "id", "sig", "bands"])


def _agree(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Similarity estimated from rows of 16-bit components."""
    return (a == b).mean(axis=-1)


def _first_band(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The first band that two rows of components share."""
    same = (a == b).reshape(*a.shape[:-1], BANDS, ROWS) if a.ndim >= b.ndim else (a == b).reshape(len(b), BANDS, ROWS)
    return same.all(axis=-1).argmax(axis=-1)


def _sigs(column) -> np.ndarray:
    return np.frombuffer(b"".join(column), "<u2").reshape(-1, SIZE)


def _least(similarity: float) -> float:
    return similarity - SLACK * (similarity * (1 - similarity) / SIZE) ** 0.5


def overlaps(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Exact weighted Jaccard similarity of the bags a[i] and b[i], given as ``elements``."""
    (x, n), (y, m) = _numbers(a, "<u4"), _numbers(b, "<u4")
    pair = np.concatenate((np.repeat(np.arange(len(n)), n), np.repeat(np.arange(len(m)), m)))
    both = np.sort((pair.astype(np.uint64) << np.uint64(32)) | np.concatenate((x, y)).astype(np.uint64), kind="stable")
    shared = np.bincount((both[1:][both[1:] == both[:-1]] >> np.uint64(32)).astype(np.int64), minlength=len(n))
    whole = n + m - shared
    return np.where(whole > 0, shared / np.maximum(whole, 1), 1.0)


def _close(pairs: DataFrame, known: DataFrame, similarity: float) -> DataFrame:
    """Of the pairs (key, pivot, n) the links (a, b): those whose bags have the similarity, after a look at their signatures.

    ``n`` says how many meet the pivot, which is dealt to as many parts as that needs.
    """
    least = _least(similarity)

    def sure(batches):
        for batch in batches:
            x, y = (_numbers(batch.column(c), "<u2")[0].reshape(-1, SIZE) for c in ("sig", "psig"))
            batch = batch.filter(pa.array(_agree(x, y) >= least))
            sizes = sum(pc.binary_length(batch.column(c)).to_numpy(zero_copy_only=False) for c in ("elements", "pelements")) // 4
            for at, to in _slices(sizes, BATCH_ELEMENTS):
                part = batch.slice(at, to - at)
                keep = pa.array(overlaps(part.column("elements"), part.column("pelements")) >= similarity)
                yield part.select(["key", "pivot"]).filter(keep)

    parts = F.ceil(F.col("n") / PART).cast("int")
    dealt = pairs.withColumn("part", F.pmod(F.xxhash64("key"), parts).cast("int"))
    most = pairs.groupBy("pivot").agg(F.max(parts).alias("parts"))
    pivots = known.select(F.col("key").alias("pivot"), F.col("sig").alias("psig"), F.col("elements").alias("pelements")).join(most, "pivot")
    pivots = pivots.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
    met = dealt.join(known, "key").join(pivots, ["pivot", "part"]).select("key", "pivot", "sig", "psig", "elements", "pelements")
    return cut_lineage(met.mapInArrow(sure, "key binary, pivot binary").toDF("a", "b"))


def _pairs(similarity: float):
    """The likely pairs of a small bucket, of different components, that meet in no earlier band."""
    least = _least(similarity)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        sig, key, root, pivot = _sigs(rows["sig"]), rows["key"].to_numpy(), pd.factorize(rows["root"])[0], rows["pivot"].to_numpy()
        band = rows["band"].iloc[0]
        i, j = np.triu_indices(len(rows), 1)
        live = (root[i] != root[j]) & ~pivot[i] & ~pivot[j]
        i, j = i[live], j[live]
        live = (_agree(sig[i], sig[j]) >= least) & (_first_band(sig[i], sig[j]) == band) if len(i) else live[:0]
        return pd.DataFrame([(min(key[x], key[y]), max(key[x], key[y])) for x, y in zip(i[live], j[live])], columns=["a", "b"])

    return run


def _elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each bag as a sorted set of 32-bit numbers, one for each occurrence of a shingle."""
    for batch in batches:
        for at, to in _slices(pc.binary_length(batch.column("body")).to_numpy(zero_copy_only=False), BATCH_BYTES):
            part = batch.slice(at, to - at)
            doc, s, c = shingles(part.column("body"))
            nth = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
            e = _mix(np.repeat(s, c) + nth.astype(np.uint64) * _C[1]) & np.uint64(0xFFFFFFFF)
            doc = np.repeat(doc, c)
            e = np.sort((doc.astype(np.uint64) << np.uint64(32)) | e).astype("<u4")
            yield pa.RecordBatch.from_arrays([part.column("key"), part.column("sig"), _rows(e, 4 * np.bincount(doc, minlength=to - at))], names=["key", "sig", "elements"])


def _partners(similarity: float):
    """The rows of two blocks of a large bucket that are likely to have a link to another component."""
    least = _least(similarity)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        sig, root, block = _sigs(rows["sig"]), pd.factorize(rows["root"])[0], rows["block"].to_numpy()
        band = rows["band"].iloc[0]
        left, right = np.flatnonzero(block == block.min()), np.flatnonzero(block == block.max())
        live = np.zeros(len(rows), bool)
        for i in left:
            j = right[root[right] != root[i]]
            if len(j):
                j = j[_agree(sig[j], sig[i]) >= least]
            if len(j):
                j = j[_first_band(sig[j], sig[i]) == band]
            if len(j):
                live[i] = True
                live[j] = True
        return rows.loc[live, ["h", "key"]]

    return run


def _links(similarity: float):
    """The links between two blocks of a large bucket that join components; at most one less than its rows."""
    least = _least(similarity)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        sig, key, root, block = _sigs(rows["sig"]), rows["key"].to_numpy(), pd.factorize(rows["root"])[0], rows["block"].to_numpy()
        sets = [np.frombuffer(x, "<u4") for x in rows["elements"]]
        band = rows["band"].iloc[0]
        one = block.min() == block.max()
        left = np.flatnonzero(block == block.min())
        right = left if one else np.flatnonzero(block == block.max())
        found = []
        for n, i in enumerate(left):
            j = right[n + 1 :] if one else right
            j = j[root[j] != root[i]]
            if len(j):
                j = j[_agree(sig[j], sig[i]) >= least]
            if len(j):
                j = j[_first_band(sig[j], sig[i]) == band]
            if not len(j):
                continue
            sizes = np.array([len(sets[k]) for k in j])
            every = np.concatenate([sets[k] for k in j])
            at = np.minimum(np.searchsorted(sets[i], every), len(sets[i]) - 1)
            shared = np.bincount(np.repeat(np.arange(len(j)), sizes), sets[i][at] == every, len(j))
            for k in j[shared >= similarity * (sizes + len(sets[i]) - shared)]:
                if root[k] != root[i]:
                    found.append((min(key[i], key[k]), max(key[i], key[k])))
                    root[root == root[k]] = root[i]
        return pd.DataFrame(found, columns=["a", "b"])

    return run


def classes(df: DataFrame, id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """(key, class_id, class_size, chosen, copies) for every different text of ``df``; key is ``text_key`` of the text, one text a class is chosen."""
    source = df.select(F.col(f"`{id}`").alias("id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("body"))
    keyed = source.select(text_key("body").alias("key"), "id", "body")
    sketch = keyed.mapInArrow(_sketch, f"key binary, id {df.schema[id].dataType.simpleString()}, sig binary, bands array<bigint>")
    nodes = cut_lineage(sketch.groupBy("key").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"), F.any_value("sig", True).alias("sig"), F.any_value("bands", True).alias("bands")))

    met = nodes.select("key", F.posexplode("bands").alias("band", "h"))
    shared = met.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    buckets = cut_lineage(met.join(shared, "h"))
    central = buckets.groupBy("key").agg(F.sum("n").alias("met"))
    pivots = buckets.join(central, "key").groupBy("h").agg(F.max(F.struct("met", "key")).alias("p")).select("h", F.col("p.key").alias("pivot"))
    buckets = cut_lineage(buckets.join(pivots, "h"))
    tried = buckets.where("key <> pivot").groupBy("key", "pivot").agg(F.max("n").alias("n"))

    # The bags of those that share a bucket, once; of equal texts each task gives one.
    texts = keyed.groupBy("key").agg(F.any_value("body").alias("body"))
    near = nodes.select("key", "sig").join(central.select("key"), "key", "left_semi")
    known = cut_lineage(texts.join(near, "key").mapInArrow(_elements, "key binary, sig binary, elements binary"))

    links = _close(tried, known, similarity)
    roots = cut_lineage(components(links))
    rooted = buckets.join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    mixed = rooted.where("n > 2").groupBy("h").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("h")
    rest = cut_lineage(rooted.join(mixed, "h"))
    signed = rest.join(known.select("key", "sig"), "key")
    few = signed.where(F.col("n") <= FEW).select("h", "band", "key", "root", "sig", (F.col("key") == F.col("pivot")).alias("pivot"))
    late = few.groupBy("h").applyInPandas(lambda rows: _pairs(similarity)(rows), "a binary, b binary")
    late = late.groupBy(F.col("a").alias("key"), F.col("b").alias("pivot")).agg(F.lit(FEW).alias("n"))

    # Of large buckets, signatures say first which rows have anyone to be compared with; only those send their bags.
    large = _blocks(signed.where(F.col("n") > FEW).select("h", "band", "key", "root", "n", "sig"))
    live = large.groupBy("h", "i", "j").applyInPandas(lambda rows: _partners(similarity)(rows), "h bigint, key binary").distinct()
    many = cut_lineage(rest.where(F.col("n") > FEW).join(live, ["h", "key"]).select("h", "band", "key", "root"))
    left = many.groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    dealt = _blocks(many.join(left, "h").join(known, "key"))
    joined = dealt.groupBy("h", "i", "j").applyInPandas(lambda rows: _links(similarity)(rows), "a binary, b binary")
    more = _close(cut_lineage(late), known, similarity).union(joined)

    # What is found late joins components, not nodes.
    a, b = roots.toDF("a", "ra"), roots.toDF("b", "rb")
    between = more.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
    last = components(between).toDF("root", "last")
    every = nodes.select("key", "id", "copies").join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    every = cut_lineage(every.join(last, "root", "left").select("key", "id", "copies", F.coalesce("last", "root").alias("root")))
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key"))
    sizes = every.groupBy("root").agg(first.alias("first"), F.sum("copies").alias("class_size"))
    return every.join(sizes, "root").select("key", F.col("first.id").alias("class_id"), "class_size", (F.col("key") == F.col("first.key")).alias("chosen"), "copies")


def _blocks(rows: DataFrame) -> DataFrame:
    """The rows of each bucket h, of n rows, dealt to all pairs (i, j) of its blocks."""
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    dealt = rows.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("key"), "blocks").cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    return dealt.withColumns({"i": F.least("block", "other"), "j": F.greatest("block", "other")}).drop("other", "blocks", "n")


def text_key(column: str):
    """128 bits that stand for a text."""
    return F.unhex(F.md5(F.coalesce(F.col(column).cast("string"), F.lit(""))))


def near_duplicates(df: DataFrame, id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """One row for each row of ``df``: its id, the class it belongs to and how many rows that class has.

    A text that many rows hold is dealt to many parts, so no task meets all its rows.
    """
    found = cut_lineage(classes(df, id, text, similarity).drop("chosen")).withColumnRenamed("key", "__key")
    rows = df.select(F.col(f"`{id}`"), text_key(text).alias("__key"))
    left, right = deal(rows, found, "__key", "copies", F.xxhash64(F.col(f"`{id}`")))
    return left.join(right, ["__key", "__part"]).drop("__key", "__part", "copies")


def keep_one(df: DataFrame, id: str = "doc_id", text: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """One row of each class with all columns of ``df``: that of the smallest id, then of the smallest text key, then of the smallest other atomic values."""
    named = lambda c: F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit(""))
    chosen = classes(df, id, text, similarity).where("chosen").select("key", named(F.col("class_id")).alias("id"))
    plain = [F.col(f"`{f.name}`") for f in df.schema if f.dataType.simpleString() not in ("variant",) and not f.dataType.simpleString().startswith(("map", "array", "struct"))]
    row = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.struct(*plain).alias("rank"), named(F.col(f"`{id}`")).alias("id"), text_key(text).alias("key"))
    # The id is part of the join key, so a large group of copies is dealt over all tasks; repeated rows meet in one.
    return row.join(chosen, ["key", "id"]).groupBy("key", "id").agg(F.min_by("row", "rank").alias("row")).select("row.*")
