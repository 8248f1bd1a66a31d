"""Alignment of two tokenizers' tokens over the same bytes, and how sure an alignment is.

A is a byte-level vocabulary of the library tokenizers, B a sentencepiece model whose
dummy prefix is the space that is put before A's text. The spans that both libraries
give (characters in A, bytes in B) are the coarse ends of their tokens; a token that
ends inside a character (A) or is a byte of the fallback (B) has no end of its own
there and is refined with the decoded bytes of its run. Places where tokens of both
end cut the text into groups, and every A token of a group is linked with every B
token of it. How many documents hold a pair of ids linked is counted over the whole
corpus, and each document's links are compared with the highest count of their A id.

A single space between other signs is a place where both vocabularies begin a token
whatever stands around it: the byte-level pre-tokenizer starts a piece there, and no
piece of the model holds a space behind another sign (both are looked up; otherwise
texts stay whole). Texts are cut there, and of the parts of many texts each distinct
one is encoded and aligned once.

All this happens in one pass over the texts, which writes each document's distinct pairs of
ids and how often it links them. Counts are grouped sums over those. They come back to
the documents by broadcast while there are at most ``FEW`` pairs (which vocabularies,
not documents, limit) and by a join beyond, in which pairs that very many documents
hold are dealt to parts; both give the same rows.

Edge cases: a null or empty text, or one that either vocabulary can't give back byte by
byte, has no tokens; strings of special tokens are plain text; every row is a
document, so repeated rows count each; equal counts all are the highest; a text
is encoded whole, so memory grows with the longest one; groups of very many tokens
are linked by distinct ids; only the kept columns and the text are read, so others
may have any name (kept ones must not be named like those added); an empty table
gives an empty one.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from dotweave.llm.common import deal, shared_folder

#: Characters of texts whose parts are looked up together, and of parts that are encoded in one call.
BATCH_CHARS = 1_000_000
TOGETHER = 20_000
#: Parts that a task remembers, some 100 MB.
MEMO = 300_000
#: Links of a group beyond which its distinct ids are linked instead of its tokens.
LARGE = 4096
#: Pairs of ids whose counts are broadcast, some 40 MB.
FEW = 1_000_000

ADDED = "n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, pairs array<struct<pair:bigint,times:bigint>>"


class Vocabulary:
    """Each id's bytes, their number, whether they are whole characters with an end of their own, and its decimal name with either sign behind it."""

    def __init__(self, tokens: list[bytes], whole: list[bool], inner: str, last: str):
        self.tokens = tokens
        self.length = np.array([len(t) for t in tokens], dtype=np.int64)
        self.whole = np.array(whole)
        self.names = np.array([f"{i}{sign}".encode() for i in range(len(tokens)) for sign in (inner, last)])


def _is_text(token: bytes) -> bool:
    try:
        token.decode()
    except UnicodeDecodeError:
        return False
    return True


@lru_cache(maxsize=2)
def byte_level(path: str):
    """The tokenizer and its vocabulary; in a byte-level entry a character stands for a byte."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(path)
    made.encode_special_tokens = True
    made.no_truncation()
    made.no_padding()
    # Printable bytes of Latin-1 stand for themselves, the others for characters from 256 on.
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    byte = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
    tokens = []
    for i in range(made.get_vocab_size()):
        entry = made.id_to_token(i) or ""
        tokens.append(bytes(byte[c] for c in entry) if all(c in byte for c in entry) else entry.encode())
    return made, Vocabulary(tokens, [_is_text(t) for t in tokens], ",", "|")


@lru_cache(maxsize=2)
def pieces(path: str):
    """The sentencepiece model and its vocabulary."""
    import sentencepiece

    made = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(made.get_piece_size())
    tokens = [bytes([int(made.id_to_piece(i)[3:5], 16)]) if made.is_byte(i) else made.id_to_piece(i).replace("▁", " ").encode() for i in ids]
    return made, Vocabulary(tokens, [not made.is_byte(i) for i in ids], ",", ";")


def _refined(coarse: np.ndarray, ids: np.ndarray, vocabulary: Vocabulary) -> np.ndarray:
    """Byte ends of tokens: those of the spans, or the last such end and the decoded bytes since."""
    own = vocabulary.whole[ids]
    if own.all():
        return coarse
    before = np.maximum.accumulate(np.where(own, np.arange(len(ids)), -1))
    read = np.cumsum(vocabulary.length[ids])
    since = np.where(before >= 0, coarse[before] - read[before], 0)
    return np.where(own, coarse, since + read)


#: A single space between other signs.
CUT = re.compile(r"(?<=\S) (?=\S)")


@lru_cache(maxsize=2)
def separable(path_a: str, path_b: str) -> bool:
    """Whether both vocabularies begin a token at every such space."""
    with open(path_a, encoding="utf-8") as file:
        told = json.load(file)
    before = told.get("pre_tokenizer") or {}
    plain = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and told.get("normalizer") is None
    made = pieces(path_b)[0]
    return plain and not any(re.search("[^▁]▁", made.id_to_piece(i)) for i in range(made.get_piece_size()))


def encode(texts: list[str], a: tuple, b: tuple) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bytes] | None]:
    """For each text A's ids and span ends (characters), B's ids and span ends (bytes), and its bytes with the space; None where it has no tokens."""
    (first, va), (second, vb) = a, b
    spaced = [" " + t for t in texts]
    out: list = []
    protos = second.encode(texts, return_type="proto", num_threads=1)
    for text, left, right in zip(spaced, first.encode_batch(spaced, add_special_tokens=False), protos):
        whole = text.encode()
        ia = left.ids
        told = [(p.id, p.end) for p in right.pieces]
        ib = [i for i, _ in told]
        if b"".join(map(va.tokens.__getitem__, ia)) != whole or b"".join(map(vb.tokens.__getitem__, ib)) != whole:
            out.append(None)
            continue
        ends = np.array([e for _, e in left.offsets], dtype=np.int64)
        out.append((np.array(ia, dtype=np.int64), ends, np.array(ib, dtype=np.int64), np.array([e for _, e in told], dtype=np.int64), whole))
    return out


def align(encoded: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, bytes]], stops: np.ndarray, va: Vocabulary, vb: Vocabulary):
    """Over encoded texts, put one behind another and cut into parts at the bytes ``stops``: per part (n_a, n_b, n_groups, n_links), its groups' string, and (part, pair, times) of its distinct pairs, in this order."""
    data = b"".join(e[4] for e in encoded)
    size = np.array([len(e[4]) for e in encoded])
    begin = np.cumsum(size) - size
    number_a, number_b = [len(e[0]) for e in encoded], [len(e[2]) for e in encoded]
    ids_a, ids_b = np.concatenate([e[0] for e in encoded]), np.concatenate([e[2] for e in encoded])
    starts = np.append(np.flatnonzero((np.frombuffer(data, dtype=np.uint8) & 0xC0) != 0x80), len(data))
    characters = np.searchsorted(starts, begin)
    ends_a = _refined(starts[np.concatenate([e[1] for e in encoded]) + np.repeat(characters, number_a)], ids_a, va)
    ends_b = _refined(np.concatenate([e[3] for e in encoded]) + 1 + np.repeat(begin, number_b), ids_b, vb)

    mark = np.zeros((2, len(data) + 1), dtype=bool)
    mark[0, ends_a] = True
    mark[1, ends_b] = True
    last_a, last_b = mark[1, ends_a], mark[0, ends_b]
    group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
    cuts = ends_b[last_b]
    n, m = len(cuts), len(stops)
    in_a, in_b = np.bincount(group_a, minlength=n), np.bincount(group_b, minlength=n)
    part = np.searchsorted(stops, cuts)
    sizes = np.zeros((m, 4), dtype=np.int64)
    for k, values in enumerate((in_a, in_b, 1, in_a * in_b)):
        np.add.at(sizes[:, k], part, values)

    # In order: the A tokens of a group, its B tokens, the next group.
    before_a, before_b = np.cumsum(in_a) - in_a, np.cumsum(in_b) - in_b
    order = np.empty(len(ids_a) + len(ids_b), dtype=max(va.names.dtype, vb.names.dtype))
    order[np.arange(len(ids_a)) + before_b[group_a]] = va.names[2 * ids_a + last_a]
    order[np.arange(len(ids_b)) + (before_a + in_a)[group_b]] = vb.names[2 * ids_b + last_b]
    length = np.char.str_len(order)
    ends = np.concatenate([[0], np.cumsum(length)])[np.cumsum(sizes[:, 0] + sizes[:, 1])].tolist()
    named = order.tobytes().replace(b"\0", b"")
    strings = [named[lo : hi - 1] for lo, hi in zip([0, *ends], ends)]

    large = in_a * in_b > LARGE
    some = ~large[group_a]
    times = in_b[group_a[some]]
    nth = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    key_a = part[group_a[some]] * len(va.tokens) + ids_a[some]
    keys, counts = np.unique(np.repeat(key_a, times) * len(vb.tokens) + ids_b[np.repeat(before_b[group_a[some]], times) + nth], return_counts=True)
    if large.any():
        more_keys, more_counts = [keys], [counts]
        for g in np.flatnonzero(large).tolist():
            ua, ca = np.unique(ids_a[before_a[g] : before_a[g] + in_a[g]], return_counts=True)
            ub, cb = np.unique(ids_b[before_b[g] : before_b[g] + in_b[g]], return_counts=True)
            more_keys.append((((part[g] * len(va.tokens) + ua) * len(vb.tokens))[:, None] + ub).reshape(-1))
            more_counts.append((ca[:, None] * cb).reshape(-1))
        keys, counts = _summed(np.concatenate(more_keys), np.concatenate(more_counts))
    return sizes, strings, (*np.divmod(keys, len(va.tokens) * len(vb.tokens)), counts)


def _summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, dtype=np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


class Memo:
    """Parts of texts that were aligned already: number, sizes, groups' string, and where their pairs lie; it starts anew when it has grown too large."""

    def __init__(self):
        self.number: dict[str, int] = {}
        self.strings: list[bytes] = []
        self.characters = 0
        self.sizes = np.zeros((0, 4), dtype=np.int64)
        self.low = self.many = self.pair = self.times = np.zeros(0, dtype=np.int64)
        self.missing = np.zeros(0, dtype=bool)

    def full(self) -> bool:
        return len(self.strings) > MEMO or self.characters > 16 * MEMO

    def add(self, parts: list[str], a: tuple, b: tuple, split: bool) -> None:
        """Aligns new parts; those without spaces at their ends many at a time."""
        together: list[list[int]] = []
        room = 0
        for i, p in enumerate(parts):
            if not split or p[0].isspace() or p[-1].isspace():
                together.append([i])
                room = 0
            elif room >= len(p):
                together[-1].append(i)
                room -= len(p) + 1
            else:
                together.append([i])
                room = TOGETHER - len(p)
        encoded = encode([" ".join(parts[i] for i in some) for some in together], a, b)
        again = [[i] for some, e in zip(together, encoded) if e is None and len(some) > 1 for i in some]
        units = [(some, e) for some, e in zip(together + again, encoded + encode([parts[i] for i, in again], a, b)) if e is not None]
        held = [i for some, _ in units for i in some]
        sizes, strings = np.zeros((len(parts), 4), dtype=np.int64), [b""] * len(parts)
        low, many, missing = np.zeros(len(parts), dtype=np.int64), np.zeros(len(parts), dtype=np.int64), np.ones(len(parts), dtype=bool)
        if held:
            stops = np.cumsum([1 + len(parts[i].encode()) for i in held])
            sizes[held], some, (whose, pair, times) = align([e for _, e in units], stops, a[1], b[1])
            for i, one in zip(held, some):
                strings[i] = one
            many[held] = found = np.bincount(whose, minlength=len(held))
            low[held] = np.cumsum(found) - found + len(self.pair)
            missing[held] = False
            self.pair, self.times = np.concatenate([self.pair, pair]), np.concatenate([self.times, times])
        first = len(self.strings)
        self.number.update(zip(parts, range(first, first + len(parts))))
        self.strings += strings
        self.characters += sum(map(len, parts))
        self.sizes, self.missing = np.concatenate([self.sizes, sizes]), np.concatenate([self.missing, missing])
        self.low, self.many = np.concatenate([self.low, low]), np.concatenate([self.many, many])


def aligned(texts: list[str], a: tuple, b: tuple, split: bool, memo: Memo):
    """For each text (n_a, n_b, n_groups, n_links, digest), zeros where it has no tokens; and (text, pair, times) of their distinct pairs, in this order."""
    split_texts = [CUT.split(t) if split else [t] for t in texts]
    lengths = np.array([len(some) for some in split_texts])
    coded = pa.array(chain.from_iterable(split_texts), pa.large_string()).dictionary_encode()
    parts, used = coded.dictionary.to_pylist(), coded.indices.to_numpy()
    del split_texts, coded
    memo.add([p for p in parts if p not in memo.number], a, b, split)
    used = np.array([memo.number[p] for p in parts])[used]
    of = np.repeat(np.arange(len(texts)), lengths)
    bad = np.zeros(len(texts), dtype=bool)
    bad[of[memo.missing[used]]] = True
    stop = np.cumsum(lengths).tolist()
    digests = ["" if wrong else hashlib.sha256(b";".join(map(memo.strings.__getitem__, used[lo:hi].tolist()))).hexdigest() for wrong, lo, hi in zip(bad.tolist(), [0, *stop], stop)]
    good = ~bad[of]
    of, flat = of[good], used[good]

    both, often = np.unique(of * len(memo.strings) + flat, return_counts=True)
    of, flat = np.divmod(both, len(memo.strings))
    total = np.zeros((len(texts), 4), dtype=np.int64)
    np.add.at(total, of, memo.sizes[flat] * often[:, None])
    n = memo.many[flat]
    at = np.repeat(memo.low[flat], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    width = len(a[1].tokens) * len(b[1].tokens)
    keys, counts = _summed(np.repeat(of, n) * width + memo.pair[at], np.repeat(often, n) * memo.times[at])
    whose, key = np.divmod(keys, width)
    left, right = np.divmod(key, len(b[1].tokens))
    return [(*row, digest) for row, digest in zip(total.tolist(), digests)], (whose, (left << 32) + right, counts)


def linked(df: DataFrame, keep: list[str], path_a: str, path_b: str, text: str = "text") -> DataFrame:
    """``keep``, the row's number ``row``, the columns of ADDED: each document's sizes, digest and distinct linked pairs (A's id in the upper 32 bits). No shuffle."""
    new = T.StructType.fromDDL(ADDED)
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField("row", T.LongType())] + list(new))
    out = to_arrow_schema(schema)
    n = len(keep) + 1
    source = df.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], F.monotonically_increasing_id().alias("row"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("body"))

    def some(rows: pa.RecordBatch, memo: Memo) -> pa.RecordBatch:
        a, b = byte_level(path_a), pieces(path_b)
        texts = rows.column(n).to_pylist()
        asked = [i for i, t in enumerate(texts) if t]
        made = [(0, 0, 0, 0, "")] * len(texts)
        sizes = np.zeros(len(texts), dtype=np.int64)
        pair = times = np.zeros(0, dtype=np.int64)
        if asked:
            found, (whose, pair, times) = aligned([texts[i] for i in asked], a, b, separable(path_a, path_b), memo)
            for i, one in zip(asked, found):
                made[i] = one
            sizes[asked] = np.bincount(whose, minlength=len(asked))
        columns = [pa.array(c, type=out.field(n + k).type) for k, c in enumerate(zip(*made))]
        structs = pa.StructArray.from_arrays([pa.array(pair, pa.int64()), pa.array(times, pa.int64())], ["pair", "times"])
        lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), structs).cast(out.field("pairs").type)
        return pa.RecordBatch.from_arrays([rows.column(k).cast(out.field(k).type) for k in range(n)] + columns + [lists], schema=out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = Memo()
        for batch in batches:
            sizes = pc.fill_null(pc.utf8_length(batch.column(n)), 0).to_pylist()
            begin = total = 0
            for i, size in enumerate(sizes):
                if i > begin and total + size > BATCH_CHARS:
                    yield some(batch.slice(begin, i - begin), memo)
                    begin, total, memo = i, 0, Memo() if memo.full() else memo
                total += size
            if begin < batch.num_rows:
                yield some(batch.slice(begin), memo)

    return source.mapInArrow(run, schema)


def _written(df: DataFrame, place: str) -> DataFrame:
    df.write.parquet(place)
    return df.sparkSession.read.parquet(place)


def score(df: DataFrame, keep: list[str], path_a: str, path_b: str, text: str = "text", few: int = FEW) -> DataFrame:
    """``keep`` plus n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every row."""
    folder = f"{shared_folder(df.sparkSession)}/alignment-{uuid.uuid4().hex}"
    docs = _written(linked(df, keep, path_a, path_b, text), f"{folder}/links")
    links = docs.select("row", F.inline("pairs"))
    counts = _written(links.groupBy("pair").agg(F.count("*").alias("docs")), f"{folder}/counts")
    a = F.shiftright("pair", 32)
    highest = counts.groupBy(a.alias("a")).agg(F.max("docs").alias("highest"))
    judged = counts.join(highest, a == F.col("a")).select("pair", "docs", (F.col("docs") == F.col("highest")).alias("best"))
    if counts.count() <= few:
        met = links.join(F.broadcast(judged), "pair")
    else:
        left, right = deal(links, judged, "pair", "docs", F.col("row"))
        met = left.join(right, ["pair", "__part"])
    sums = met.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("docs")).alias("count_sum"))
    zero = F.lit(0).cast("bigint")
    kept = [F.col(f"`{c}`") for c in keep]
    return docs.drop("pairs").join(sums, "row", "left").select(*kept, "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256")
