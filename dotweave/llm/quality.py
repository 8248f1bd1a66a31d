"""Quality scores by hierarchical empirical Bayes.

A document classifier (logistic regression on binned surface features, fitted in
numpy on a bounded sample of labelled rows) gives each document its evidence.
Grouped sums of that evidence give each host, and each path below it, a posterior
mean: a path shrinks toward its host, a host toward the global mean, each by a
prior strength estimated from the spread between groups (method of moments), so a
site with few documents stays near the global prior. A document's score is its
own odds with the global prior exchanged for its path's, which leaves the
document itself out.

Edge cases: a null text is the empty text; texts are read whole, however long; columns
that aren't named are passed through (``reject``) or not read, whatever their names; null
hosts and paths are groups of their own; an empty table gives an empty one; without labels of both kinds every score is the base rate (0.5 if
there is none) and nothing is rejected; repeated rows count as often as they
occur.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dotweave.llm.common import cut_lineage, deal, map_text

#: At most so many labelled rows are fitted.
SAMPLE = 20_000
BINS = 10
RIDGE = 1.0
#: A document is rejected below this probability of being good; under one half, as losing a good document costs more.
KEEP = 0.3
#: A table of groups up to so many rows is sent to every executor.
SMALL = 50_000
NAMES = ("letters", "digits", "spaces", "symbols", "upper", "word_length", "repeated", "distinct", "line_words", "bare", "log_words", "longest_run")


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    """0 letter, 1 capital, 2 digit, 3 space, 4 other, for each code point of the basic plane; the last stands for all beyond."""
    out = np.full(65537, 4, np.uint8)
    for i in range(65536):
        c = chr(i)
        if c.isalpha():
            out[i] = 1 if c.isupper() else 0
        elif c.isdigit():
            out[i] = 2
        elif c.isspace():
            out[i] = 3
    return out


def features(text: str) -> list[float]:
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    n = max(1, len(codes))
    letters, capitals, digits, spaces, others = (np.bincount(_kinds()[np.minimum(codes, 65536)], minlength=5) / n).tolist()
    words = text.split()
    m = max(1, len(words))
    repeated = run = longest = 0
    last = None
    for w in words:
        if w == last:
            repeated += 1
            run += 1
            if run > longest:
                longest = run
        else:
            run = 0
            last = w
    bare = sum(1 for w in words if not w[0].isalnum()) if words else 0
    return [letters + capitals, digits, spaces, others, capitals / max(1e-9, letters + capitals), len(codes) / m, repeated / m, len(set(words)) / m ** 0.8, m / (1 + text.count("\n")), bare / m, float(np.log1p(len(words))), longest / m]


def _rows(texts: list[str]):
    for one in texts:
        yield (features(one),)


def sample(df: DataFrame, labels: DataFrame, id: str, text: str, label: str, rows: int = SAMPLE, part: Column | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of at most ``rows`` labelled rows, those whose id has the smallest checksum."""
    known = labels.select(F.col(f"`{id}`").alias("i"), F.col(f"`{label}`").cast("int").alias("y")).where("i IS NOT NULL AND y IS NOT NULL")
    known = known.groupBy("i").agg(F.max("y").alias("y"))
    if part is not None:
        known = known.where(part)
    # ``rows`` bounds what is broadcast, and what the driver gets.
    chosen = known.orderBy(F.crc32(F.col("i").cast("string").cast("binary")), "i").limit(rows)
    texts = df.select(F.col(f"`{id}`").alias("i"), F.col(f"`{text}`").alias("t")).join(F.broadcast(chosen), "i")
    got = map_text(texts, ["i", "y"], "t", "f array<double>", _rows).select("y", "f").limit(2 * rows).toPandas()
    return np.array(got["f"].tolist(), float).reshape(len(got), len(NAMES)), got["y"].to_numpy(int)


def fit(x: np.ndarray, y: np.ndarray, bins: int = BINS, ridge: float = RIDGE) -> dict:
    """Ridge logistic regression on quantile bins, by Newton's method."""
    rate = float((y.sum() + 1) / (len(y) + 2))
    if len(set(y.tolist())) < 2:
        return {"rate": rate if len(y) else 0.5, "cuts": None}
    cuts = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, bins + 1)[1:-1])) for k in range(x.shape[1])]
    z = _binned(x, cuts)
    w = np.zeros(z.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[0] = 1e-6
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty), z.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return {"rate": rate, "cuts": cuts, "w": w}


def _binned(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    parts = [np.ones((len(x), 1))]
    for k, cut in enumerate(cuts):
        parts.append(np.eye(len(cut) + 1)[np.searchsorted(cut, x[:, k], side="right")])
    return np.hstack(parts)


def predict(model: dict, x: np.ndarray) -> np.ndarray:
    """Probability of being good."""
    if model["cuts"] is None or not len(x):
        return np.full(len(x), model["rate"])
    return 1 / (1 + np.exp(-np.clip(_binned(x, model["cuts"]) @ model["w"], -15, 15)))


def evidence(df: DataFrame, model: dict, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` plus ``evidence``, the classifier's probability."""

    def rows(texts: list[str]):
        x = np.array([features(t) for t in texts]).reshape(len(texts), len(NAMES))
        return [(p,) for p in predict(model, x).tolist()]

    return map_text(df, keep, text, "evidence double", rows)


def sites(scored: DataFrame) -> DataFrame:
    """Per (host, path): total and posterior mean, from rows with host, path and evidence; one row a path, cut from its lineage.

    Sums are taken on the map side first, so a host with a third of all rows costs one row a task.
    """
    paths = cut_lineage(scored.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum("evidence").alias("s")))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("s").alias("hs"))
    world = hosts.agg(F.sum("hn").alias("gn"), F.sum("hs").alias("gs")).select((F.col("gs") / F.col("gn")).alias("mu"))
    mu = (world.first() or [None])[0]
    mu = 0.5 if mu is None else min(max(mu, 1e-6), 1 - 1e-6)
    strength = _strength(hosts, F.col("hs") / F.col("hn"), F.lit(mu), F.col("hn"), mu)
    hosts = hosts.select("host", "hn", ((F.col("hs") + F.lit(strength * mu)) / (F.col("hn") + F.lit(strength))).alias("host_mean"))
    both = paths.join(hosts.withColumnRenamed("host", "h"), F.col("host").eqNullSafe(F.col("h"))).drop("h")
    below = _strength(both, F.col("s") / F.col("n"), F.col("host_mean"), F.col("n"), mu)
    return cut_lineage(both.select("host", "path", "n", "s", "host_mean", F.lit(below).alias("strength"), F.lit(mu).alias("mu"), ((F.col("s") + F.lit(below) * F.col("host_mean")) / (F.col("n") + F.lit(below))).alias("path_mean")))


def _strength(groups: DataFrame, mean: Column, around: Column, n: Column, mu: float) -> float:
    """Prior strength kappa of a beta prior: between-group variance is mu (1 - mu) / (kappa + 1)."""
    row = groups.where(n > 1).agg(F.sum(n * F.pow(mean - around, 2)).alias("ss"), F.count(F.lit(1)).alias("k"), F.sum(n).alias("n")).first()
    if not row["k"] or not row["n"]:
        return 100.0
    noise = mu * (1 - mu)
    between = max(row["ss"] / row["n"] - noise * row["k"] / row["n"], 1e-9)
    return float(min(max(noise / between - 1, 1.0), 1e6))


def posterior(p: Column) -> Column:
    """The score, from the columns of ``sites`` and a document's evidence ``p``."""
    odds = lambda c: F.log(F.least(F.greatest(c, F.lit(1e-6)), F.lit(1 - 1e-6))) - F.log(1 - F.least(F.greatest(c, F.lit(1e-6)), F.lit(1 - 1e-6)))
    others = (F.col("s") - p + F.col("strength") * F.col("host_mean")) / (F.col("n") - 1 + F.col("strength"))
    return 1 / (1 + F.exp(-(odds(p) + odds(others) - odds(F.col("mu")))))


def with_sites(scored: DataFrame, found: DataFrame) -> DataFrame:
    """``scored`` (host, path, evidence and more) with the columns of its path and ``score``.

    Many paths are joined by a shuffle, in which the rows of a very large one are dealt to many parts.
    """
    found = found.withColumnsRenamed({"host": "site_host", "path": "site_path"})
    if found.count() <= SMALL:
        met = scored.join(F.broadcast(found), F.col("host").eqNullSafe(F.col("site_host")) & F.col("path").eqNullSafe(F.col("site_path")))
    else:
        named = lambda *names: F.to_json(F.array(*[F.col(c).cast("string") for c in names]))
        left, right = deal(scored.withColumn("__site", named("host", "path")), found.withColumn("__site", named("site_host", "site_path")), "__site", "n", F.xxhash64("evidence", F.spark_partition_id()))
        met = left.join(right, ["__site", "__part"]).drop("__site", "__part")
    return met.withColumn("score", posterior(F.col("evidence")))


def score(df: DataFrame, labels: DataFrame, host: str, path: Column, id: str = "doc_id", text: str = "text", label: str = "quality", part: Column | None = None) -> DataFrame:
    """id, evidence, host_mean, path_mean, score and ``keep``, one row for each row of ``df``."""
    model = fit(*sample(df, labels, id, text, label, part=part))
    own = df.select(F.col(f"`{id}`").alias("id"), F.col(f"`{host}`").alias("host"), path.alias("path"), F.col(f"`{text}`").alias("t"))
    scored = cut_lineage(evidence(own, model, ["id", "host", "path"], "t"))
    return with_sites(scored, sites(scored)).select(F.col("id").alias(id), "evidence", "host_mean", "path_mean", "score", (F.col("score") >= KEEP).alias("keep"))


def reject(df: DataFrame, labels: DataFrame, host: str, path: Column, id: str = "doc_id", text: str = "text", label: str = "quality", part: Column | None = None) -> DataFrame:
    """The rows of ``df``, with its columns, whose score is at least KEEP.

    The classifier runs once for the sites and once more for the rows; that
    costs less than moving the texts through a shuffle.
    """
    model = fit(*sample(df, labels, id, text, label, part=part))
    own = df.select(F.col(f"`{host}`").alias("host"), path.alias("path"), F.col(f"`{text}`").alias("t"))
    found = sites(evidence(own, model, ["host", "path"], "t"))
    whole = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.col(f"`{host}`").alias("host"), path.alias("path"), F.col(f"`{text}`").alias("t"))
    return with_sites(evidence(whole, model, ["row", "host", "path"], "t"), found).where(F.col("score") >= KEEP).select("row.*")
