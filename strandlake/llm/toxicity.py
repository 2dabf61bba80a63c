"""Toxicity by cumulative-link ordinal regression.

Severity grades: 0 for a row labelled clean, 1 for toxic, 2 for toxic with more toxic words than the median toxic row. The features are the words whose presence differs most between labelled classes. All grades share one weight
vector; ordered thresholds tell them apart: P(grade <= k) = sigmoid(threshold_k - x.w). The output is the expected grade.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LETTER_BYTES, Words, materialize, slices, tidy

#: labelled rows used for fitting at most, features, and least number of distinct texts that hold a feature
TRAIN_ROWS, FEATURES, LEAST_TEXTS = 20_000, 1024, 5
#: likelihood ratio that a word must have to be a feature: by chance, one in a million words has it
LEAST_GAIN = 24.0
GRADES = 3
#: expected severity from which a text is rejected
REJECT = 0.25


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


class Model:
    """Sorted word hashes, their weights, and GRADES - 1 ordered thresholds."""

    def __init__(self, words: np.ndarray, weights: np.ndarray, thresholds: np.ndarray):
        self.words, self.weights, self.thresholds = words, weights, thresholds

    def severity(self, score: np.ndarray) -> np.ndarray:
        """Expected grade: the sum of the chances of being above each threshold."""
        return (1 - _sigmoid(self.thresholds[None, :] - score[:, None])).sum(1)


def counts_of(words: Words, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, feature, count) of the known words in each text."""
    if not len(known) or not len(words.hash):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(known, words.hash), len(known) - 1)
    hit = np.flatnonzero(known[at] == words.hash)
    code, n = np.unique(words.text_of_word()[hit] * len(known) + at[hit], return_counts=True)
    return code // len(known), code % len(known), n


def _parse(text: pa.Array):
    for lo, hi, data, offsets in slices(text):
        yield lo, hi, Words(data, offsets, lower=True, of=LETTER_BYTES)


def _sketches(batches):
    """(text, toxic) -> its distinct words and a key that near copies mostly share (the least hash of five words)."""
    for batch in batches:
        for lo, hi, words in _parse(batch.column("text")):
            grams, good = words.grams(5)
            near, lists = [], []
            for i in range(hi - lo):
                a, b = words.first[i], words.first[i + 1]
                lists.append(np.unique(words.hash[a:b]).view(np.int64))
                g = grams[a:b][good[a:b]]
                near.append(int(g.min().view(np.int64)) if len(g) else int(np.sort(words.hash[a:b])[:1].view(np.int64).sum()))
            yield pa.RecordBatch.from_arrays([batch.column("text").slice(lo, hi - lo), batch.column("toxic").slice(lo, hi - lo).cast(pa.int32()), pa.array(near, pa.int64()), pa.array(lists, pa.list_(pa.int64()))], names=["text", "toxic", "near", "words"])


def _rows(known: np.ndarray):
    def run(batches):
        for batch in batches:
            for lo, hi, words in _parse(batch.column("text")):
                text, feature, n = counts_of(words, known)
                first = np.searchsorted(text, np.arange(hi - lo + 1))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("toxic").slice(lo, hi - lo), pa.array(np.diff(words.first)), pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(feature)), pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(n))],
                    names=["toxic", "size", "feature", "n"],
                )

    return run


def fit_ordinal(x: np.ndarray, grade: np.ndarray, weight: np.ndarray, grades: int = GRADES, rounds: int = 500, ridge: float = 0.0003) -> tuple[np.ndarray, np.ndarray]:
    """(weights, thresholds) of the cumulative-link model by gradient descent with momentum (Adam) on the mean log-likelihood."""
    total = weight.sum()
    share = np.array([weight[grade <= k].sum() / total for k in range(grades - 1)]).clip(1e-4, 1 - 1e-4)
    start = np.log(share / (1 - share))
    # thresholds: the first, then logarithms of the gaps
    params = np.concatenate((np.zeros(x.shape[1]), start[:1], np.log(np.maximum(np.diff(start), 0.05))))
    m, v = np.zeros_like(params), np.zeros_like(params)
    d = x.shape[1]
    for t in range(1, rounds + 1):
        gaps = np.exp(params[d + 1 :])
        thresholds = params[d] + np.concatenate(([0.0], np.cumsum(gaps)))
        edges = np.concatenate(([-np.inf], thresholds, [np.inf]))
        score = x @ params[:d]
        high, low = _sigmoid(edges[grade + 1] - score), _sigmoid(edges[grade] - score)
        p = np.maximum(high - low, 1e-12)
        d_high, d_low = high * (1 - high) / p * weight / total, low * (1 - low) / p * weight / total
        by_edge = np.bincount(grade + 1, d_high, grades + 1) - np.bincount(grade, d_low, grades + 1)
        by_threshold = by_edge[1:grades]
        gradient = np.concatenate((-(x.T @ (d_high - d_low)) - ridge * params[:d], [by_threshold.sum()], [g * by_threshold[k + 1 :].sum() for k, g in enumerate(gaps)]))
        m, v = 0.9 * m + 0.1 * gradient, 0.999 * v + 0.001 * gradient**2
        params = params + 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
    return params[:d], params[d] + np.concatenate(([0.0], np.cumsum(np.exp(params[d + 1 :]))))


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> Model:
    """Fit on at most ``train_rows`` labelled rows, taken by a hash of doc_id; of near copies one row counts.

    Near copies are taken to be rows with the same least hash of five words, which rows that share a passage can have too;
    that only leaves rows out of the fit. Labels that are null or neither 0 nor 1, or without doc_id, are not used; of
    repeated labels the greater holds. Without labelled rows of both classes the model gives severity 0 to all.
    """
    none = Model(np.zeros(0, np.uint64), np.zeros(0), np.full(GRADES - 1, 40.0))
    sample = labels.where("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    sample = sample.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    rows = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(sample), "doc_id").select("text", "toxic")  # bounded by train_rows
    rows = rows.mapInArrow(tidy(_sketches), "text string, toxic int, near long, words array<long>")
    rows = materialize(rows.groupBy("near").agg(F.min_by(F.struct("text", "toxic", "words"), F.xxhash64("text")).alias("r")).select("r.*"), "labelled")
    sizes = dict(rows.groupBy("toxic").count().collect())
    n0, n1 = sizes.get(0, 0), sizes.get(1, 0)
    if not n0 or not n1:
        return none
    words = rows.select("toxic", F.explode("words").alias("word")).groupBy("word").agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b")).where(F.col("a") + F.col("b") >= LEAST_TEXTS)
    share = n1 / (n0 + n1)
    part = lambda seen, due: F.when(seen > 0, seen * F.log(seen / due)).otherwise(0.0)
    both = F.col("a") + F.col("b")
    gain = 2 * (part(F.col("a"), both * share) + part(F.col("b"), both * (1 - share)))  # likelihood ratio against the overall share
    words = words.withColumn("gain", gain).where(F.col("gain") >= LEAST_GAIN).withColumn("toxic", F.col("a") > both * share)
    best = words.orderBy(F.desc("gain"), "word").limit(FEATURES).collect()
    if not best:
        return none
    known = np.array([r.word for r in best], np.int64).view(np.uint64)
    order = np.argsort(known)
    known, strong = known[order], np.array([r.toxic for r in best])[order]
    found = rows.select("text", "toxic").mapInArrow(tidy(_rows(known)), "toxic int, size long, feature array<long>, n array<long>").groupBy("toxic", "size", "feature", "n").count().collect()
    found.sort(key=lambda r: (r.toxic, r["size"], r.feature, r.n))
    x = np.zeros((len(found), len(known)))
    for i, r in enumerate(found):
        x[i, r.feature] = np.log2(1 + np.array(r.n))
    toxic, weight = np.array([r.toxic for r in found]), np.array([r["count"] for r in found], float)
    hits = x[:, strong].sum(1)  # toxic words, each by the logarithm of its count
    grade = toxic + ((toxic == 1) & (hits > np.median(hits[toxic == 1])))
    weights, thresholds = fit_ordinal(x, grade.astype(int), weight)
    return Model(known, weights, thresholds)


def _scored(model: Model, names: list[str]):
    def run(batches):
        for batch in batches:
            out = [np.zeros(0)]
            for lo, hi, words in _parse(batch.column("text")):
                text, feature, n = counts_of(words, model.words)
                out.append(model.severity(np.bincount(text, model.weights[feature] * np.log2(1 + n), hi - lo) if len(text) else np.zeros(hi - lo)))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in names] + [pa.array(np.concatenate(out))], names=[*names, "severity"])

    return run


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text, the columns in ``keep`` and severity (expected grade, 0 to 2) of every row.

    A null or empty text has no words and the severity of such. Repeated rows and equal or null doc_ids are judged each by
    its text. Other columns are left out, whatever their names. An empty table gives no rows.
    """
    names = ["doc_id", "text", *keep]
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*names).schema)
    return docs.select(*names).mapInArrow(tidy(_scored(model, names)), f"{types}, severity double")


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    """Every document's expected severity, its nearest grade, and whether it is rejected."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = score(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return out.select("doc_id", "severity", F.round("severity").cast("int").alias("grade"), (F.col("severity") >= REJECT).alias("rejected"))
