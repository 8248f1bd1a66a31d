"""Toxicity scores by a convolutional text classifier, trained in numpy.

A word is the sum of hashed embeddings of itself and of its first letters, so
inflected and compounded words share what they begin with. Filters of one, two
and three words run over the whole text, the largest response of each filter is
kept, and a logistic layer on those gives the score. Rare hash buckets are left
out of training. The score is calibrated on held-back labelled rows; a threshold
for each language is calibrated beside it, drawn toward the common one where a
language has few rows.

Edge cases: null and empty texts, and texts without words, score what a text
without any filter response scores; without labels of both kinds every score is
the base rate; repeated rows score alike; the score reads nothing but the text.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dotweave.llm.common import map_text

#: At most so many labelled rows, each of at most so many characters, are fitted.
SAMPLE = 8_000
SAMPLE_CHARS = 200_000
BUCKETS = 1 << 16
WIDTH = 12
FILTERS = 8
SIZES = (1, 2, 3)
PREFIXES = (3, 4, 5, 6, 7)
LEAST_TEXTS = 4
EPOCHS = 8
BATCH = 64
RATE = 0.01
DECAY = 1e-5
BATCH_CHARS = 4_000_000
TAPS = sum(SIZES) * FILTERS
EDGE = " \t\r\n.,;:!?\"'()[]{}*#$%&|<>-_/\\"


def _buckets(words: list[str]) -> np.ndarray:
    """Buckets of each word and of its beginnings; 0 is no bucket."""
    bare = [w.strip(EDGE).lower() for w in words]
    length = np.array([len(w) for w in bare])
    out = np.zeros((len(bare), 1 + len(PREFIXES)), np.int64)
    for i, k in enumerate((0, *PREFIXES)):
        parts = np.array([w[:k] for w in bare] if k else bare, dtype=object)
        # The length asked for is part of the hash: a word is not its own beginning.
        h = pd.util.hash_array(parts, categorize=False) + np.uint64(k * 0x9E3779B97F4A7C15 % 2**64)
        out[:, i] = np.where(length >= max(k, 1), 1 + (h ^ (h >> np.uint64(31))) % np.uint64(BUCKETS - 1), 0)
    return out


def coded(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word code of every word, words of each text, buckets of each code); words are held some texts at a time."""
    sizes = np.zeros(len(texts), np.int64)
    known: dict[str, int] = {}
    parts, held = [], 0
    words: list[str] = []
    for i, text in enumerate(texts):
        own = text.split()
        sizes[i] = len(own)
        words += own
        held += len(text)
        if held > BATCH_CHARS or i + 1 == len(texts):
            if words:
                codes, names = pd.factorize(np.array(words, dtype=object))
                parts.append(np.array([known.setdefault(n, len(known)) for n in names], np.int32)[codes])
            words, held = [], 0
    if not parts:
        return np.zeros(0, np.int64), sizes, np.zeros((0, 1 + len(PREFIXES)), np.int64)
    return np.concatenate(parts), sizes, _buckets(list(known))


def _responses(taps: np.ndarray, codes: np.ndarray, sizes: np.ndarray, where: bool = False):
    """Largest response of each filter in each text (and where its window begins); texts under a filter's width have none (-inf).

    taps: for each word code, what it adds at each place of each filter.
    """
    n = len(sizes)
    ends = np.cumsum(sizes)
    begins = ends - sizes
    best = np.full((n, len(SIZES) * FILTERS), -np.inf, np.float32)
    at = np.zeros((n, len(SIZES) * FILTERS), np.int64)
    column = 0
    for k, size in enumerate(SIZES):
        total = len(codes) - size + 1
        if total > 0:
            out = taps[codes[:total], column : column + FILTERS]
            for j in range(1, size):
                out = out + taps[codes[j : j + total], column + j * FILTERS : column + (j + 1) * FILTERS]
            has = np.flatnonzero(sizes >= size)
            if len(has):
                # Windows that reach into the next text fall between the ranges.
                cuts = np.stack([begins[has], ends[has] - size + 1], 1).ravel()
                tail = cuts[-1] == total
                top = np.maximum.reduceat(out, cuts[:-1] if tail else cuts, axis=0)[::2]
                best[has, k * FILTERS : (k + 1) * FILTERS] = top
                if where:
                    for i, t in zip(has, top):
                        span = out[begins[i] : ends[i] - size + 1]
                        at[i, k * FILTERS : (k + 1) * FILTERS] = begins[i] + np.argmax(span == t, axis=0)
        column += size * FILTERS
    return (best, at) if where else best


def _taps(model: dict, buckets: np.ndarray) -> np.ndarray:
    return model["embedding"][buckets].sum(axis=1) @ model["filters"]


def _logit(model: dict, best: np.ndarray) -> np.ndarray:
    return np.maximum(best + model["bias"], 0) @ model["weights"] + model["offset"]


def train(texts: list[str], y: np.ndarray, seed: int = 1, epochs: int = EPOCHS) -> dict:
    """Adam on the log loss; only the winning window of each filter carries a gradient."""
    rng = np.random.default_rng(seed)
    codes, sizes, buckets = coded(texts)
    rate = float((y.sum() + 1) / (len(y) + 2)) if len(y) else 0.5
    if len(set(y.tolist())) < 2:
        return {"rate": rate}
    doc = np.repeat(np.arange(len(sizes)), sizes)
    first = np.unique(doc * np.int64(len(buckets)) + codes) % max(len(buckets), 1)
    seen = np.bincount(buckets.ravel(), np.repeat(np.bincount(first, minlength=len(buckets)), buckets.shape[1]), BUCKETS)
    del doc, first
    known = seen >= LEAST_TEXTS
    known[0] = False
    buckets = np.where(known[buckets], buckets, 0)
    m = {
        "embedding": (rng.normal(size=(BUCKETS, WIDTH)) * 0.1).astype(np.float32) * known[:, None],
        "filters": (rng.normal(size=(WIDTH, TAPS)) * (1 / WIDTH) ** 0.5).astype(np.float32),
        "bias": np.zeros(len(SIZES) * FILTERS, np.float32),
        "weights": (rng.normal(size=len(SIZES) * FILTERS) * 0.3).astype(np.float32),
        "offset": np.float32(np.log(rate / (1 - rate))),
    }
    m["offset"] = np.array([m["offset"]], np.float32)
    first_m, second_m = {k: np.zeros_like(v) for k, v in m.items()}, {k: np.zeros_like(v) for k, v in m.items()}
    ends = np.cumsum(sizes)
    # Where the taps of each filter lie: filter f of size k at place j.
    columns, column = [], 0
    for size in SIZES:
        columns += [[column + j * FILTERS + f for j in range(size)] for f in range(FILTERS)]
        column += size * FILTERS
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for b in range(0, len(order), BATCH):
            own = order[b : b + BATCH]
            span = np.concatenate([codes[ends[i] - sizes[i] : ends[i]] for i in own])
            use, local = np.unique(span, return_inverse=True)
            if not len(use):
                continue
            bk = buckets[use]
            vectors = m["embedding"][bk].sum(axis=1)
            taps = vectors @ m["filters"]
            best, at = _responses(taps, local, sizes[own], where=True)
            pre = best + m["bias"]
            h = np.maximum(pre, 0)
            p = 1 / (1 + np.exp(-np.clip(h @ m["weights"] + m["offset"], -30, 30)))
            g = ((p - y[own]) / len(own)).astype(np.float32)
            grads = {"offset": np.array([g.sum()], np.float32), "weights": h.T @ g}
            gh = np.where(pre > 0, g[:, None] * m["weights"][None], 0).astype(np.float32)
            grads["bias"] = gh.sum(axis=0)
            gt = np.zeros_like(taps)
            for f, cs in enumerate(columns):
                live = np.flatnonzero(gh[:, f])
                for j, c in enumerate(cs):
                    np.add.at(gt[:, c], local[at[live, f] + j], gh[live, f])
            rows = np.flatnonzero(gt.any(axis=1))
            grads["filters"] = vectors[rows].T @ gt[rows]
            gv = gt[rows] @ m["filters"].T
            ids, back = np.unique(bk[rows], return_inverse=True)
            ge = np.zeros((len(ids), WIDTH), np.float32)
            np.add.at(ge, back.reshape(len(rows), -1), gv[:, None, :])
            ge[ids == 0] = 0
            step += 1
            fix = (1 - 0.999**step) ** 0.5 / (1 - 0.9**step)
            for name, grad in grads.items():
                first_m[name] = 0.9 * first_m[name] + 0.1 * grad
                second_m[name] = 0.999 * second_m[name] + 0.001 * grad**2
                m[name] = m[name] - RATE * fix * first_m[name] / (second_m[name] ** 0.5 + 1e-8) - (DECAY * m[name] if name != "offset" else 0)
            # Of the embeddings only those met move.
            a = first_m["embedding"][ids] = 0.9 * first_m["embedding"][ids] + 0.1 * ge
            v = second_m["embedding"][ids] = 0.999 * second_m["embedding"][ids] + 0.001 * ge**2
            m["embedding"][ids] -= RATE * fix * a / (v**0.5 + 1e-8) + DECAY * m["embedding"][ids]
    return m | {"rate": rate}


def logits(model: dict, texts: list[str]) -> np.ndarray:
    """Over whole texts, some at a time; empty texts have no response at all."""
    if "embedding" not in model:
        return np.full(len(texts), np.log(model["rate"] / (1 - model["rate"])))
    parts, at = [], 0
    while at < len(texts):
        to, size = at, 0
        while to < len(texts) and (to == at or size + len(texts[to]) <= BATCH_CHARS):
            size += len(texts[to])
            to += 1
        codes, sizes, buckets = coded(texts[at:to])
        taps = _taps(model, buckets) if len(buckets) else np.zeros((0, TAPS), np.float32)
        parts.append(_logit(model, _responses(taps, codes, sizes)))
        at = to
    return np.concatenate(parts).astype(float) if parts else np.zeros(0)


def calibrate(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Platt scaling: slope (positive) and offset by Newton's method."""
    if len(set(y.tolist())) < 2:
        return 1.0, 0.0
    x = np.stack([np.clip(z, -30, 30), np.ones(len(z))], 1)
    w = np.array([1.0, 0.0])
    target = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), x.T @ (target - p) - 1e-3 * (w - [1, 0]))
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return float(max(w[0], 0.05)), float(w[1])


def thresholds(score: np.ndarray, y: np.ndarray, lang: list, prior: float = 50.0) -> dict:
    """For each language the threshold of the best F1, weighted against the common one by its number of rows."""

    def best(s, t):
        if len(set(t.tolist())) < 2:
            return 0.5
        order = np.argsort(-s, kind="stable")
        hit = np.cumsum(t[order])
        f1 = 2 * hit / (np.arange(1, len(s) + 1) + t.sum())
        f1[:-1][s[order][1:] == s[order][:-1]] = 0
        k = int(f1.argmax())
        low = s[order][k + 1] if k + 1 < len(s) else 0.0
        return float((s[order][k] + low) / 2)

    common = best(score, y)
    out = {None: common}
    names = np.array([x if x is not None else "" for x in lang])
    for name in sorted(set(x for x in lang if x is not None)):
        own = names == name
        out[name] = (own.sum() * best(score[own], y[own]) + prior * common) / (own.sum() + prior)
    return out


def fit(df: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "toxic", lang: str = "lang", part: Column | None = None, rows: int = SAMPLE) -> dict:
    """Trains on at most ``rows`` labelled rows (smallest checksums of ids); every fifth of them calibrates."""
    known = labels.select(F.col(f"`{id}`").alias("i"), F.col(f"`{label}`").cast("int").alias("y")).where("i IS NOT NULL AND y IS NOT NULL")
    known = known.groupBy("i").agg(F.max("y").alias("y"))
    if part is not None:
        known = known.where(part)
    check = F.crc32(F.concat(F.lit("fit"), F.col("i").cast("string")).cast("binary"))
    # ``rows`` bounds what is broadcast, and what the driver gets.
    chosen = known.orderBy(check, "i").limit(rows)
    body = F.coalesce(F.col(f"`{text}`").cast("string"), F.lit(""))
    texts = df.select(F.col(f"`{id}`").alias("i"), F.col(f"`{lang}`").alias("lang"), body.alias("t")).where(F.length("t") <= SAMPLE_CHARS)
    got = texts.join(F.broadcast(chosen), "i").select("y", "lang", "t", check.alias("c")).limit(rows).toArrow()
    y = got.column("y").to_numpy().astype(int)
    c = got.column("c").to_numpy()
    t, names = got.column("t").to_pylist(), got.column("lang").to_pylist()
    order = np.argsort(c, kind="stable")
    back = order[np.arange(len(order)) % 5 == 4]
    fore = order[np.arange(len(order)) % 5 != 4]
    model = train([t[i] for i in fore], y[fore])
    z = logits(model, [t[i] for i in back])
    model["slope"], model["shift"] = calibrate(z, y[back]) if "embedding" in model else (1.0, 0.0)
    model["thresholds"] = thresholds(scores(model, z), y[back], [names[i] for i in back])
    return model


def scores(model: dict, z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(model["slope"] * z + model["shift"], -30, 30)))


def score(df: DataFrame, model: dict, keep: list[str], text: str = "text", lang: str = "lang") -> DataFrame:
    """``keep`` plus score, predicted (at 0.5) and toxic (at the language's threshold), without a shuffle."""
    weights = df.sparkSession.sparkContext.broadcast(model)  # a few MB, whatever the data

    def rows(texts: list[str]):
        return [(p,) for p in scores(weights.value, logits(weights.value, texts)).tolist()]

    named = keep + [lang] * (lang not in keep)
    out = map_text(df, named, text, "score double", rows)
    known = {k: v for k, v in model["thresholds"].items() if k is not None}
    limit = F.lit(model["thresholds"][None])
    for name, value in known.items():
        limit = F.when(F.col(f"`{lang}`") == name, F.lit(float(value))).otherwise(limit)
    return out.select(*[F.col(f"`{c}`") for c in keep], "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), (F.col("score") >= limit).alias("toxic"))
