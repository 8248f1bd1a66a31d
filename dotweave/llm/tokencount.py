"""Token counts of whole texts, huge ones by overlap resynchronisation.

A text up to ``chunk`` characters is encoded whole. A longer one is encoded in
chunks that overlap; each chunk's token offsets are compared with those of the
chunk before, and the two are spliced at a boundary proven stable: both have a
token that begins there, and the pre-tokeniser always starts a piece there, whatever
stands before. It takes runs of letters, of numbers or of other signs, each with a
space before it, so a piece starts wherever one such run follows another directly
(but letters behind an apostrophe) and at the single space between two runs; scripts
without spaces are spliced at their punctuation. Where an overlap holds no such
boundary it is doubled, and where the whole chunk holds none the chunk is, so the
work stays in proportion to the text; a run of one kind of sign is one piece and
has to be encoded in one call.

Edge cases: a null or empty text has no tokens; special strings inside a text
are read as the library's defaults read them; repeated rows are counted each; an
empty table gives an empty one; only the kept columns and the text are read, so
others may have any name.
"""

from __future__ import annotations

import unicodedata
from bisect import bisect_left
from functools import lru_cache

from pyspark.sql import DataFrame

from dotweave.llm.common import map_text

CHUNK = 32_768
OVERLAP = 512
BATCH_CHARS = 2_000_000


@lru_cache(maxsize=4)
def tokenizer(path: str):
    """One tokenizer a Python worker, single-threaded: Spark's tasks are the parallelism."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(path)
    made.no_truncation()
    made.no_padding()
    return made


def _kind(c: str) -> str:
    """The pre-tokeniser's class of a character."""
    if c.isspace():
        return " "
    top = unicodedata.category(c)[0]
    return top if top in "LN" else "."


def _stable(text: str, at: int) -> bool:
    """Whether a piece starts at ``at`` whatever stands before the character in front of it."""
    before, here = _kind(text[at - 1]), _kind(text[at])
    if here == " ":
        return text[at] == " " and before != " " and _kind(text[at + 1]) != " "
    return before not in (" ", here) and not (here == "L" and text[at - 1] == "'")


def _starts(encoder, text: str, begin: int, end: int) -> list[int]:
    """Where the tokens of a chunk begin in the text; the pieces of one character share its place."""
    return [begin + a for a, _ in encoder.encode(text[begin:end], add_special_tokens=False).offsets]


def count_long(encoder, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """The tokens of ``text``; ``chunk`` must exceed twice ``overlap``."""
    n, total, begin, size = len(text), 0, 0, chunk
    while True:
        end = min(n, begin + size)
        left = _starts(encoder, text, begin, end)
        if end == n:
            return total + len(left)
        lap = overlap
        splice = None
        while splice is None and lap < end - begin:
            start = end - lap
            # The outer eighth on either side may depend on where the chunk was cut.
            margin = max(2, lap // 8)
            near = [p for p in left[bisect_left(left, start + margin) : bisect_left(left, end - margin)] if _stable(text, p)]
            if near:
                right = set(_starts(encoder, text, start, min(n, end + lap)))
                splice = next((p for p in reversed(near) if p in right), None)
            lap *= 2
        if splice is None:
            size *= 2
            continue
        total += bisect_left(left, splice)
        begin, size = splice, chunk


def count(df: DataFrame, keep: list[str], path: str, text: str = "text", limit: int = 1024, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """``keep`` plus n_bytes (UTF-8), n_tokens and over_limit (more than ``limit`` tokens); no shuffle."""

    def rows(texts: list[str]):
        encoder = tokenizer(path)
        counts = [0] * len(texts)
        batch: list[int] = []
        size = 0

        def flush():
            nonlocal size
            for i, found in zip(batch, encoder.encode_batch_fast([texts[i] for i in batch], add_special_tokens=False)):
                counts[i] = len(found)
            batch.clear()
            size = 0

        for i, one in enumerate(texts):
            if len(one) > chunk:
                counts[i] = count_long(encoder, one, chunk, overlap)
                continue
            batch.append(i)
            size += len(one)
            if size > BATCH_CHARS:
                flush()
        flush()
        for one, n in zip(texts, counts):
            yield len(one.encode("utf-8", "surrogatepass")), n, n > limit

    return map_text(df, keep, text, "n_bytes bigint, n_tokens bigint, over_limit boolean", rows)
