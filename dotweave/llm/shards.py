"""Training-order materialisation of token ids as fixed-stride binary shards.

Texts are encoded once, in storage order, into one stream with a mark behind each
text; the stream is cut into sequences of equal length. A keyed Feistel network
with cycle walking permutes the sequence numbers, so every sequence knows its
place in training order without a sort, a table or a counter. Places are split
into ranges; each range is a run of shards whose sequences lie at multiples of
one stride, so any place is one seek away and reading resumes anywhere.

Shards are written by Spark's own writer (one record a sequence, its bytes and one
byte that ends it), so they may lie in any store Spark writes to, and a task that is
lost or runs twice leaves one copy. They are read back by Spark's binary reader.

With ``window`` the permutation acts inside windows of that many sequences, so an
order made before (a mix of sources) still holds from window to window.

Edge cases: null and empty texts give their mark alone; a text of any length is
encoded whole and spread over as many sequences as it fills; the last sequence is
filled with marks; an empty table gives no sequence and no shard; repeated rows are
encoded each; ids and other columns are not read, so their names don't matter. Where
a table isn't in the order of its files (behind a repartition, say), texts go by file
split, then by task, then as they stand in it.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dotweave.llm.common import cut_lineage, shared_folder

LENGTH = 1024
PER_SHARD = 4096
ROUNDS = 6
KEY = 20260101
MARK = 50256
#: Fixed value: the split pattern that the vocabulary was made with.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
MASK = (1 << 64) - 1


@lru_cache(maxsize=2)
def _encoding(path: str):
    import base64

    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def _round(x: np.ndarray, key: int) -> np.ndarray:
    x = x + np.uint64(key)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def permute(index: np.ndarray, size: int, key: int = KEY, rounds: int = ROUNDS) -> np.ndarray:
    """A keyed permutation of range(size): a balanced Feistel network over the next even power of two, walked until it is inside."""
    half = max(1, (max(size - 1, 1).bit_length() + 1) // 2)
    low = np.uint64((1 << half) - 1)
    keys = [(key * 0x9E3779B97F4A7C15 + r * 0xC2B2AE3D27D4EB4F) & MASK for r in range(1, rounds + 1)]
    out = np.asarray(index, np.uint64).copy()
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> np.uint64(half), out[todo] & low
        for k in keys:
            left, right = right, left ^ (_round(right, k) & low)
        out[todo] = (left << np.uint64(half)) | right
        todo = todo[out[todo] >= np.uint64(size)]
    return out.astype(np.int64)


def training_slot(index: np.ndarray, size: int, key: int = KEY, window: int | None = None) -> np.ndarray:
    """The place of each sequence; with a window, the last one is as long as what is left."""
    if window is None or window >= size:
        return permute(index, size, key)
    index = np.asarray(index, np.int64)
    out = np.empty(len(index), np.int64)
    which = index // window
    tail = which == size // window
    if (~tail).any():
        # Every window has its own turn of the same permutation.
        turned = (index[~tail] % window + _turn(which[~tail], window, key)) % window
        out[~tail] = which[~tail] * window + permute(turned, window, key)
    if tail.any():
        out[tail] = which[tail] * window + permute(index[tail] % window, size % window, key)
    return out


def _turn(which: np.ndarray, window: int, key: int) -> np.ndarray:
    return (_round(which.astype(np.uint64), key & MASK) % np.uint64(window)).astype(np.int64)


def encode(df: DataFrame, path: str, text: str = "text") -> DataFrame:
    """(segment, part, task, start, n, ids): little-endian 16-bit ids of each text and its mark, and where they start in what the task has read of their file split.

    (segment, part) orders the splits as they are stored; a table that isn't read
    from files has none.
    """
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("body")
    try:
        source = df.select(F.col("_metadata.file_path").alias("segment"), F.col("_metadata.file_block_start").alias("part"), body)
    except AnalysisException:
        source = df.select(F.lit("").alias("segment"), F.lit(0).cast("bigint").alias("part"), body)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoding(path)
        task = TaskContext.get().partitionId()
        totals: dict[tuple, int] = {}
        for batch in batches:
            segments, parts = batch.column("segment").to_pylist(), batch.column("part").to_pylist()
            starts, sizes, ids = [], [], []
            for place, one in zip(zip(segments, parts), batch.column("body").to_pylist()):
                got = np.array(encoder.encode_ordinary(one) + [MARK], "<u2")
                starts.append(totals.get(place, 0))
                sizes.append(len(got))
                ids.append(got.tobytes())
                totals[place] = starts[-1] + len(got)
            yield pa.RecordBatch.from_arrays([batch.column("segment"), batch.column("part"), pa.array([task] * len(ids), pa.int32()), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()), pa.array(ids, pa.binary())], names=["segment", "part", "task", "start", "n", "ids"])

    return source.mapInArrow(run, "segment string, part bigint, task int, start bigint, n bigint, ids binary")


#: How hard the stream is compressed, which costs less than the disk it takes.
LEVEL = 9
#: Where the parts of the stream begin is sent to all executors up to so many parts.
SMALL = 1_000_000


def _dealt(df: DataFrame, folder: str, path: str, text: str, length: int, per_shard: int, key: int, window: int | None, parts: int | None) -> tuple[DataFrame | None, dict]:
    """The sequences (slot, ids), partitions one after another in training order, rows inside them too; and what is to be known of them.

    The encoded stream is written once to ``folder``, so texts are encoded once and
    a lost executor repeats only its own part; one shuffle deals the pieces to the
    ranges of their slots.
    """
    spark = df.sparkSession
    encode(df, path, text).write.option("compression", "zstd").option("parquet.compression.codec.zstd.level", LEVEL).parquet(folder)
    stream = spark.read.parquet(folder)
    # One row a file split and task that read of it; in a scan that is one row a split.
    runs = cut_lineage(stream.groupBy("segment", "part", "task").agg(F.sum("n").alias("n")))
    # One row a split, as many as Spark's own task list on the driver has.
    splits = runs.groupBy("segment", "part").agg(F.sum("n").alias("n")).select("segment", "part", F.expr("sum(n) OVER (ORDER BY segment, part) - n").alias("before"))
    base = runs.join(splits, ["segment", "part"]).select("segment", "part", "task", (F.col("before") + F.expr("sum(n) OVER (PARTITION BY segment, part ORDER BY task) - n")).alias("base"))
    total = runs.agg(F.sum("n")).first()[0] or 0
    size = -(-total // length)
    if not size:
        return None, {"size": 0}
    shards = -(-size // per_shard)
    parts = parts or max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    last, rest = int(training_slot(np.array([size - 1]), size, key, window)[0]), total - (size - 1) * length
    # Whole shards a partition, so each file of the writer is one shard.
    per_part = -(-shards // parts) * per_shard
    parts = -(-size // per_part)
    base = F.broadcast(base) if runs.count() <= SMALL else base
    met = stream.join(base, ["segment", "part", "task"]).select((F.col("base") + F.col("start")).alias("at"), "ids")

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Cuts runs of neighbouring texts at the bounds of sequences; pieces are shuffled compressed."""
        packer = zstandard.ZstdCompressor()
        for batch in batches:
            at = batch.column("at").to_numpy()
            ids = batch.column("ids").to_pylist()
            ends = at + np.array([len(x) // 2 for x in ids], np.int64)
            cuts = np.concatenate(([0], np.flatnonzero(at[1:] != ends[:-1]) + 1, [len(at)]))
            index, offset, body = [], [], []
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                run = b"".join(ids[a:b])
                first, last = int(at[a]), int(ends[b - 1])
                bounds = [first, *range((first // length + 1) * length, last, length), last]
                for x, y in zip(bounds[:-1], bounds[1:]):
                    index.append(x // length)
                    offset.append(x % length)
                    body.append(packer.compress(run[2 * (x - first) : 2 * (y - first)]))
            slot = training_slot(np.array(index, np.int64), size, key, window)
            for i in range(0, len(index), 4096):
                yield pa.RecordBatch.from_arrays([pa.array((slot[i : i + 4096] // per_part).astype(np.int32)), pa.array(slot[i : i + 4096]), pa.array(offset[i : i + 4096], pa.int32()), pa.array(body[i : i + 4096], pa.binary())], names=["target", "slot", "offset", "body"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sets the sorted pieces of each sequence together; a sequence may reach over batches."""
        first = None
        seen = 0
        slots: list[int] = []
        bodies: list[bytes] = []
        packer = zstandard.ZstdDecompressor()
        now, held = None, []

        def out() -> pa.RecordBatch:
            nonlocal first, seen
            slot = np.array(slots, np.int64)
            first = slots[0] if first is None else first
            seen += len(slots)
            wrong = [s for s, b in zip(slots, bodies) if len(b) != 2 * (rest if s == last else length)]
            if wrong:
                raise ValueError(f"sequence at {wrong[0]} has not the length that the splits add up to")
            made = pa.RecordBatch.from_arrays([pa.array(slot), pa.array([b + MARK.to_bytes(2, "little") * (length - len(b) // 2) for b in bodies], pa.binary())], names=["slot", "ids"])
            slots.clear()
            bodies.clear()
            return made

        for batch in batches:
            for slot, body in zip(batch.column("slot").to_pylist(), batch.column("body").to_pylist()):
                if slot != now:
                    if now is not None:
                        slots.append(now)
                        bodies.append(b"".join(held))
                    now, held = slot, []
                held.append(packer.decompress(body))
            if len(slots) >= 2048:
                yield out()
        if now is not None:
            slots.append(now)
            bodies.append(b"".join(held))
            yield out()
            low = first // per_part * per_part
            if first != low or seen != min(per_part, size - low):
                raise ValueError(f"{seen} sequences from {first} on where the splits add up to {min(per_part, size - low)}")

    dealt = met.mapInArrow(pieces, "target int, slot bigint, offset int, body binary").repartitionById(parts, "target").sortWithinPartitions("slot", "offset")
    facts = {"size": size, "last": last, "rest": rest, "length": length, "per_shard": per_shard, "shards_a_part": per_part // per_shard}
    return dealt.select("slot", "body").mapInArrow(join, "slot bigint, ids binary"), facts


def write_shards(df: DataFrame, path: str, folder: str, text: str = "text", length: int = LENGTH, per_shard: int = PER_SHARD, key: int = KEY, window: int | None = None, parts: int | None = None) -> None:
    """Encodes ``df`` and writes its shards below ``folder``: files of ``per_shard`` records of ``stride(length)`` bytes in training order, and what is to be known of them."""
    spark = df.sparkSession
    scratch = f"{folder}-tokens"
    found, facts = _dealt(df, scratch, path, text, length, per_shard, key, window, parts)
    if found is not None:
        found.select(F.col("ids").cast("string").alias("value")).write.option("lineSep", "\n").option("maxRecordsPerFile", per_shard).text(f"{folder}/shards")
    spark.createDataFrame([(json.dumps(facts),)], "value string").coalesce(1).write.text(f"{folder}/facts")
    release(spark, scratch)  # the stream has served


def release(spark: SparkSession, folder: str) -> None:
    """Empties a folder of Parquet files that was written for one job only."""
    spark.createDataFrame([], "done int").write.mode("overwrite").parquet(folder)


def stride(length: int) -> int:
    return 2 * length + 1


def read_shards(spark: SparkSession, folder: str, first: int = 0, count: int | None = None) -> DataFrame:
    """(slot, shard, byte_offset, n_tokens, ids) of the sequences from place ``first`` on, as a reader resumes: only the shards that hold them are listed."""
    facts = json.loads(spark.read.text(f"{folder}/facts").first()[0])
    size = facts["size"]
    end = size if count is None else min(size, first + count)
    if first >= end:
        return spark.createDataFrame([], "slot bigint, shard bigint, byte_offset bigint, n_tokens int, ids binary")
    length, per_shard, each = facts["length"], facts["per_shard"], facts["shards_a_part"]
    files = spark.read.format("binaryFile")
    if (first, end) != (0, size) and end - first <= 64 * per_shard:
        names = [f"part-{k // each:05d}-*-c{k % each:03d}.txt" for k in range(first // per_shard, (end - 1) // per_shard + 1)]
        files = files.option("pathGlobFilter", f"{{{','.join(names)}}}")
    last, rest, step = facts["last"], facts["rest"], stride(length)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
                split, nth = map(int, re.search(r"part-(\d+)-.*-c(\d+)\.txt$", path).groups())
                shard = split * each + nth
                data = np.frombuffer(content.as_buffer(), np.uint8)
                held = len(data) // step
                if held != min(per_shard, size - shard * per_shard) or len(data) != held * step:
                    raise ValueError(f"shard {shard} holds {len(data)} bytes")
                data = data.reshape(held, step)[:, :-1]
                for i in range(0, held, 2048):
                    some = np.ascontiguousarray(data[i : i + 2048])
                    n = len(some)
                    slot = shard * per_shard + i + np.arange(n)
                    ids = pa.BinaryArray.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1, dtype=np.int32) * (step - 1)).tobytes()), pa.py_buffer(some.tobytes())])
                    yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(np.full(n, shard)), pa.array((i + np.arange(n)) * step), pa.array(np.where(slot == last, rest, length).astype(np.int32)), ids], names=["slot", "shard", "byte_offset", "n_tokens", "ids"])

    out = files.load(f"{folder}/shards").select("path", "content").mapInArrow(rows, "slot bigint, shard bigint, byte_offset bigint, n_tokens int, ids binary")
    return out if (first, end) == (0, size) else out.where((F.col("slot") >= first) & (F.col("slot") < end))


def sequences(df: DataFrame, path: str, text: str = "text", length: int = LENGTH, per_shard: int = PER_SHARD, key: int = KEY, window: int | None = None, parts: int | None = None) -> DataFrame:
    """Writes the shards to a new folder in the shared place and gives what they hold, read back."""
    folder = f"{shared_folder(df.sparkSession)}/shards-{uuid.uuid4().hex}"
    write_shards(df, path, folder, text, length, per_shard, key, window, parts)
    return read_shards(df.sparkSession, folder)
