"""Quality classifier with hierarchical empirical Bayes.

A logistic regression on measures of the text and on hashed words gives each document's own evidence.  Documents are then
grouped by path (host and section) and host.  With variances within paths, between paths of a host and between hosts,
estimated from all documents by the method of moments, a host's mean is shrunk toward the global mean and a path's toward
its host's, so sparse sites shrink most.  A document is left out of the means that judge it.  Its posterior odds are its
evidence times the odds of its path over the global odds.

The regression is fitted on at most ``sample_rows`` labelled rows (those with the smallest hash of their id), a bounded
and documented sample; all else covers all documents.  Group sums are taken before the shuffle, so a host with a third of
all documents loads no task.

Nulls and odd input: a null text is empty and gets the measures of an empty text; a null host or section is a group of
its own; repeated rows each get a row of the result; labels with a null id or quality, or without a document, are not
used, and of several labels of one id the worst counts; rows with equal hashes of their ids go by id; with labels of one
class only (or none) the evidence is the share of good ones (or one half); a quality of just ``threshold`` is kept.  An
empty table gives an empty result.  Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, stored
from .words import NON_SPACE, slices, words_of

MEASURES = (
    "log_words", "mean_word", "upper_share", "symbol_share", "bar_share", "bang_share", "digit_share", "word_variety",
    "line_variety", "end_share", "long_words", "short_lines",
)
#: Hashed words of the regression.
WORDS = 64


def measures(text: str | None) -> list[float]:
    text = text or ""
    words = text.split()
    n, chars = max(1, len(words)), max(1, len(text))
    lines = [x for x in text.split("\n") if x.strip()]
    upper = sum(map(str.isupper, text)) / chars
    return [
        math.log1p(len(words)),
        chars / n / 10,
        upper,
        sum(map(text.count, "#*$%&<>@^~")) / chars * 10,
        text.count("|") / n,
        text.count("!") / n,
        sum(map(text.count, "0123456789")) / chars * 10,
        len(set(words)) / n,
        len(set(lines)) / max(1, len(lines)),
        (text.count(".") + text.count("?")) / n,
        sum(len(w) > 20 for w in words) / n,
        sum(len(x) < 30 for x in lines) / max(1, len(lines)),
    ]


def features(texts: pa.Array) -> np.ndarray:
    """A row for each text: its measures, and the square root of the share of each bucket of words (copies count once or twice alike)."""
    plain = np.array([measures(x) for x in texts.to_pylist()]).reshape(-1, len(MEASURES))
    words = words_of(texts, NON_SPACE)
    counts = np.bincount(words.row * WORDS + (words.hash % np.uint64(WORDS)).astype(np.int64), minlength=words.n_rows * WORDS)
    counts = counts.reshape(-1, WORDS)
    return np.hstack([plain, np.sqrt(counts / np.maximum(1, counts.sum(1, keepdims=True)))])


def _known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Features in single precision, one after the other."""
    for batch in batches:
        for part in slices(batch, "text"):
            x = [row.astype("<f4").tobytes() for row in features(part.column(2))]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(x, pa.binary())], ["doc_id", "quality", "x"])


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 40) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean and spread of each feature, and weights (the last is the constant), by Newton's method.

    Hashed words are held to small weights, the more so the fewer rows there are.
    """
    k = x.shape[1]
    if not len(y):
        return np.zeros(k), np.ones(k), np.zeros(k + 1)
    mean, spread = x.mean(0), x.std(0) + 1e-6
    if y.min() == y.max():
        share = (y.sum() + 1) / (len(y) + 2)
        return mean, spread, np.append(np.zeros(k), math.log(share / (1 - share)))
    z = np.c_[np.clip((x - mean) / spread, -8, 8), np.ones(len(x))]
    hold = np.full(k + 1, ridge)
    hold[len(MEASURES) : k] = ridge + 10 / len(y)
    w = np.zeros(k + 1)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        slope = z.T @ (p - y) / len(y) + hold * w
        bend = (z * (p * (1 - p))[:, None]).T @ z / len(y) + np.diag(hold)
        step = np.linalg.solve(bend, slope)
        w -= step * min(1.0, 3 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-4:
            break
    return mean, spread, w


def _scored(mean: np.ndarray, spread: np.ndarray, w: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                z = np.clip((features(part.column(3)) - mean) / spread, -8, 8) @ w[:-1] + w[-1]
                evidence = 1 / (1 + np.exp(-np.clip(z, -12, 12)))
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(evidence)], ["doc_id", "host", "section", "evidence"])

    return run


def _sample(docs: DataFrame, labels: DataFrame, sample_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of at most ``sample_rows`` labelled documents."""
    known = labels.filter("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id"))
    known = known.agg(F.min("quality").cast("double").alias("quality")).withColumn("place", F.xxhash64("doc_id"))
    share = sample_rows / max(1, known.count())
    if share < 0.9:  # nearly all that is left then is in the sample, so no task sends more than its share
        known = known.filter(F.col("place") < int(-(2.0**63) + 2.0**64 * (1.1 * share + 1e-4)))
    chosen = F.broadcast(known.orderBy("place", "doc_id").limit(sample_rows).drop("place"))  # sample_rows rows at most
    rows = docs.select("doc_id", "text").join(chosen, "doc_id").select("doc_id", "quality", "text")
    found = rows.mapInArrow(_known, "doc_id long, quality double, x binary")
    found = found.orderBy(F.xxhash64("doc_id"), "doc_id", "x").limit(sample_rows).collect()
    x = np.frombuffer(b"".join(r["x"] for r in found), "<f4").reshape(-1, len(MEASURES) + WORDS).astype(float)
    return x, np.array([r["quality"] for r in found])


def variances(paths: DataFrame) -> dict[str, float]:
    """Of sums by path (host, section, n, total, squares): mean, and variances within paths, between paths and between hosts."""
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.sum(F.col("n") * F.col("n")).alias("nn"))
    up = paths.agg(
        F.count("*").alias("paths"), F.sum("squares").alias("squares"), F.sum(F.col("total") * F.col("total") / F.col("n")).alias("by_path"),
        F.sum((F.col("n") * F.col("n")).cast("double")).alias("nn_path"),
    ).first()
    top = hosts.agg(
        F.count("*").alias("hosts"), F.sum("n").alias("n"), F.sum("total").alias("total"),
        F.sum(F.col("total") * F.col("total") / F.col("n")).alias("by_host"), F.sum((F.col("n") * F.col("n")).cast("double")).alias("nn"),
        F.sum(F.col("nn") / F.col("n")).alias("mixed"),
    ).first()
    n = top["n"] or 0
    if not n:
        return {"mean": 0.5, "within": 1e-6, "path": 0.0, "host": 0.0}
    within = max((up["squares"] - up["by_path"]) / max(1, n - up["paths"]), 1e-6)
    path = max(0.0, (up["by_path"] - top["by_host"] - (up["paths"] - top["hosts"]) * within) / max(n - top["mixed"], 1e-9)) if n > top["mixed"] else 0.0
    left = top["by_host"] - top["total"] ** 2 / n - (top["hosts"] - 1) * within - path * (top["mixed"] - up["nn_path"] / n)
    host = max(0.0, left / (n - top["nn"] / n)) if n * n > top["nn"] else 0.0
    return {"mean": min(max(top["total"] / n, 1e-3), 1 - 1e-3), "within": within, "path": path, "host": host}


def _logit(p: Column) -> Column:
    inside = F.greatest(F.lit(1e-3), F.least(F.lit(1 - 1e-3), p))
    return F.log(inside / (1 - inside))


def classify(
    docs: DataFrame,
    labels: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    host: str = "source",
    section: str = "lang",
    sample_rows: int = 20_000,
    threshold: float = 0.5,
    labelled: Column | None = None,
) -> DataFrame:
    """``doc_id, evidence, host_quality, path_quality, quality, kept`` for each row.

    ``labelled``: which labels may be used (a test holds some out).
    """
    slim = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        F.coalesce(F.col(host).cast("string"), F.lit("\x00null")).alias("host"),
        F.coalesce(F.col(section).cast("string"), F.lit("\x00null")).alias("section"),
        F.col(text).cast("string").alias("text"),
    )
    model = fit(*_sample(slim, labels.filter(F.lit(True) if labelled is None else labelled), sample_rows))
    scored = stored(slim.mapInArrow(_scored(*model), "doc_id long, host string, section string, evidence double"))
    square = F.col("evidence") * F.col("evidence")
    paths = stored(
        scored.groupBy("host", "section").agg(F.count("*").alias("n"), F.sum("evidence").alias("total"), F.sum(square).alias("squares"))
    )
    v = variances(paths)
    hosts = paths.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("total").alias("ht"), F.sum(F.col("n") * F.col("n")).alias("hnn"))
    joined = scored.join(stored(paths.drop("squares").join(hosts, "host")), ["host", "section"])
    # both levels without the document itself
    n, hn = F.col("n") - 1, F.col("hn") - 1
    mean, host_mean = (F.col("total") - F.col("evidence")) / n, (F.col("ht") - F.col("evidence")) / hn
    error = v["within"] / hn + v["path"] * (F.col("hnn") - F.col("n") * F.col("n") + n * n) / (hn * hn)
    trust = F.when(hn > 0, v["host"] / (v["host"] + error)).otherwise(0.0)
    joined = joined.withColumn("host_quality", v["mean"] + F.when(trust > 0, trust * (host_mean - v["mean"])).otherwise(0.0))
    trust = F.when(n > 0, v["path"] / (v["path"] + v["within"] / n)).otherwise(0.0)
    joined = joined.withColumn("path_quality", F.col("host_quality") + F.when(trust > 0, trust * (mean - F.col("host_quality"))).otherwise(0.0))
    odds = F.log(F.col("evidence") / (1 - F.col("evidence"))) + _logit(F.col("path_quality")) - math.log(v["mean"] / (1 - v["mean"]))
    return joined.withColumn("quality", 1 / (1 + F.exp(-odds))).select(
        "doc_id", "evidence", "host_quality", "path_quality", "quality", (F.col("quality") >= threshold).alias("kept")
    )


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
