"""Languages of documents as mixtures: expectation-maximisation over n-gram likelihoods.

Each language is a smoothed distribution over hashed character n-grams, counted over
all its training documents by partial sums in tasks and a grouped sum. A document is a
bag of n-grams drawn from a mixture of languages; expectation-maximisation finds the
proportions of all languages at once, and of the sets that the largest of them make
(one, two, three, ...). A set's likelihood is penalised for each language beyond the
first, as neighbouring n-grams overlap by a factor; the best set gives the document's
languages. The score is the predicted language's share, averaged over the sets by
their penalised likelihoods, so a short text of doubtful language has a low score.

Edge cases: a text that is null or has no letter is ``und`` with score 0 and no
languages, and so is every text where nothing could be learned; whole texts are read,
of any length; equal likelihoods go to the language that sorts first; rows without a
language or an id teach nothing; repeated rows teach each; only the named columns
are read, so others may have any name; an empty table gives an empty one. The model is
one number a language and bucket: buckets are halved while it would exceed
``MODEL_BYTES``, which takes more than a thousand languages.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dotweave.llm.common import map_text

#: Lengths of n-grams in characters, within words and with the spaces around them.
SIZES = (1, 2, 3, 4)
BUCKETS = 1 << 16
MODEL_BYTES = 1 << 28
#: Added to the count of each bucket, in parts of the mean count.
SMOOTH = 0.05
#: What one more language costs, in nats for each doubling of the number of letters.
PENALTY = 4.0
ROUNDS = 30
UNKNOWN = "und"

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def _grams(text: str, buckets: int) -> np.ndarray:
    """The bucket of every n-gram of the lower-cased words of ``text``; empty if it has no letter."""
    lower = text.lower()
    kept = "".join(c if c.isalpha() else " " for c in set(lower))  # the letters among its characters
    letters = kept.replace(" ", "")
    if not letters:
        return np.zeros(0, dtype=np.int64)
    code = np.frombuffer(f" {lower} ".encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    known = np.zeros(int(code.max()) + 1, dtype=bool)
    known[[ord(c) for c in letters]] = True
    is_letter = known[code]
    # Runs of other signs are one space.
    keep = is_letter | np.concatenate([[True], is_letter[:-1]])
    code, is_letter = np.where(is_letter, code, np.uint64(32))[keep], is_letter[keep]
    found = []
    hashed = np.zeros(len(code), dtype=np.uint64)
    inside = is_letter.copy()
    for size in range(1, max(SIZES) + 1):
        if len(code) < size:
            break
        m = len(code) - size + 1
        hashed = (hashed[:m] * np.uint64(1_000_003)) ^ code[size - 1 :]
        if size == 1:
            some = is_letter
        else:
            # A space may only begin or end an n-gram.
            some = np.ones(m, dtype=bool)
            for k in range(1, size - 1):
                some &= is_letter[k : k + m]
            if size == 2:
                some &= is_letter[:m] | is_letter[1:]
        if size in SIZES:
            mixed = (hashed[some] + np.uint64(size)) * _MULTIPLIER
            found.append((mixed >> np.uint64(40)).astype(np.int64) % buckets)
    return np.concatenate(found)


@dataclass
class Model:
    """``names`` sorted; ``logs`` (buckets, languages): the logarithm of each n-gram's probability in each language."""

    names: list[str]
    logs: np.ndarray


def _buckets(languages: int) -> int:
    buckets = BUCKETS
    while buckets > 64 and buckets * languages * 4 > MODEL_BYTES:
        buckets //= 2
    return buckets


def fit(docs: DataFrame, part: Column, text: str = "text", lang: str = "lang") -> Model:
    """The model of the languages of the rows where ``part`` is true; a row of its counts is a language's."""
    rows = docs.where(part & F.col(f"`{lang}`").isNotNull()).select(F.col(f"`{lang}`").cast("string").alias("lang"), F.col(f"`{text}`").cast("string").alias("body"))
    buckets = _buckets(rows.agg(F.count_distinct("lang")).first()[0])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for name, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                grams = _grams(body or "", buckets)
                if len(grams):
                    if name not in sums:
                        sums[name] = np.zeros(buckets, dtype=np.int64)
                    sums[name] += np.bincount(grams, minlength=buckets)
        for name, total in sums.items():
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(some), pa.string()), pa.array(some, pa.int32()), pa.array(total[some], pa.int64())], names=["lang", "bucket", "n"])

    parts = rows.mapInArrow(count, "lang string, bucket int, n bigint")
    learned = parts.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).groupBy("lang").agg(F.collect_list(F.struct("bucket", "n")).alias("counts"))
    names, table = [], []
    for one in learned.orderBy("lang").toLocalIterator():  # a language at a time; all of them are at most MODEL_BYTES
        counts = np.zeros(buckets)
        for bucket, n in one["counts"]:
            counts[bucket] = n
        names.append(one["lang"])
        counts += SMOOTH * counts.mean()
        table.append(np.log(counts / counts.sum()).astype(np.float32))
    return Model(names, np.stack(table, axis=1) if table else np.zeros((buckets, 0), dtype=np.float32))


def _counted(grams: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values and their counts; beyond some length counting buckets is quicker than sorting."""
    if len(grams) < 2000:
        return np.unique(grams, return_counts=True)
    counts = np.bincount(grams, minlength=buckets)
    some = np.flatnonzero(counts)
    return some, counts[some]


def _mixture(likelihood: np.ndarray, times: np.ndarray, share: np.ndarray, least: float = -np.inf) -> tuple[np.ndarray, float]:
    """Proportions of the columns of ``likelihood`` (scaled rows) and the logarithm of the likelihood they reach; given up once none can reach ``least``."""
    total = times.sum()
    reached = -np.inf
    for _ in range(ROUNDS):
        mixed = likelihood @ share
        now = float(times @ np.log(mixed))
        slope = (times / mixed) @ likelihood / total
        # The logarithm is concave in the shares, so its slopes bound what any shares reach.
        if now - reached < 1e-3 or now + total * (float(slope.max()) - 1) <= least:
            return share, now
        reached, share = now, share * slope
    return share, reached


def infer(text: str, model: Model) -> tuple[str, float, list[tuple[str, float]]]:
    """The predicted language, its score, and the languages of the selected set with their shares, largest first."""
    grams = _grams(text, len(model.logs)) if model.names else ()
    if not len(grams):
        return UNKNOWN, 0.0, []
    buckets, times = _counted(grams, len(model.logs))
    times = times / len(SIZES)  # an n-gram of each length begins at nearly every letter
    logs = model.logs[buckets].astype(np.float64)
    single = times @ logs
    first = int(np.argmax(single))
    n = len(model.names)
    price = PENALTY * np.log2(2 + times.sum())
    sets: list[tuple[float, dict[int, float]]] = [(float(single[k]), {k: 1.0}) for k in range(n)]
    if n > 1:
        scale = logs[:, first]
        likelihood, base = np.exp(logs - scale[:, None]), float(single[first])
        start = np.full(n, 0.1 / (n - 1))
        start[first] = 0.9
        share, reached = _mixture(likelihood, times, start, price)
        if reached > price:
            order = np.argsort(-share, kind="stable")
            for k in range(2, n + 1):
                chosen = order[:k]
                if share[chosen[-1]] < 1e-3:
                    break
                part, value = _mixture(likelihood[:, chosen], times, share[chosen] / share[chosen].sum())
                sets.append((base + value - (k - 1) * price, dict(zip(chosen.tolist(), part.tolist()))))
    best = max(s[0] for s in sets)
    weights = np.exp([s[0] - best for s in sets])
    weights /= weights.sum()
    selected = next(s[1] for s in sets if s[0] == best)
    ranking = sorted(selected, key=lambda k: (-selected[k], k))
    score = float(sum(w * s[1].get(ranking[0], 0.0) for w, s in zip(weights, sets)))
    return model.names[ranking[0]], min(max(score, 0.0), 1.0), [(model.names[k], selected[k]) for k in ranking]


def predict(docs: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` plus lang_pred, score and ``languages`` (those of the selected set with their shares). No shuffle."""
    context = docs.sparkSession.sparkContext
    shared = context.broadcast((model.names, model.logs))  # at most MODEL_BYTES

    def rows(texts: list[str]):
        held = Model(*shared.value)
        for one in texts:
            name, score, mixture = infer(one, held)
            yield name, score, [{"lang": k, "share": v} for k, v in mixture]

    return map_text(docs, keep, text, "lang_pred string, score double, languages array<struct<lang:string,share:double>>", rows)
