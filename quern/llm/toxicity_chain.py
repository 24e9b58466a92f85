"""Toxicity [operator 8]: classifier chains.

Categories are learned one after the other by linear models; each later model
sees the earlier categories' probabilities, in training those of out-of-fold
models, so that it learns to trust them only as far as unseen text allows. The
categories of the query are "low quality" and "toxic" of `labels`.

Training uses at most TRAIN_ROWS labelled documents, those with the smallest
hash of their id, as sets of hashed features; this is the only sampling.
Scoring covers every document and its whole text. What is broadcast are
2**FEATURE_BITS weights a category (2 MB), whatever the input.

Null and empty texts have no features and probability 0, never flagged;
null labels train nothing; of several labels or texts of one id the smallest
train; repeated rows get repeated results; a null doc_id is
scored like any other. Without labelled rows, or with one class only, a
category's probability is 0 or 1 throughout. An empty table gives no rows and
extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import by_batch, table

FEATURE_BITS = 18
TRAIN_ROWS = 20_000
FOLDS = 3
LEAST_Z = 4.0
STEPS = 60
CATEGORIES = ("low_quality", "toxic")
_WORD = re.compile(r"\w+|[^\w\s]+")


def features(text: str) -> np.ndarray:
    """Distinct hashed features: lower-cased words, marks, and bins of how much is capital or repeated."""
    if not text:
        return np.zeros(0, np.int32)
    words = _WORD.findall(text.lower())
    found = set(words)
    capital = sum(map(str.isupper, text.split()))
    found.add(f"\0capital {min(10, 10 * capital // max(1, len(words)))}")
    found.add(f"\0varied {10 * len(found) // (len(words) + 1)} {min(8, len(words).bit_length())}")
    size = (1 << FEATURE_BITS) - 1
    return np.unique(np.array([zlib.crc32(w.encode()) & size for w in found], np.int32))


class Linear:
    """Logistic regression on presence features scaled by their log-odds, kept where the two classes differ by LEAST_Z deviations."""

    def __init__(self, rows: list[np.ndarray], more: np.ndarray, y: np.ndarray):
        size = 1 << FEATURE_BITS
        self.weights, self.extra, self.bias = np.zeros(size, np.float32), np.zeros(more.shape[1]), 0.0
        n1 = float(y.sum())
        n0 = len(y) - n1
        if not n1 or not n0:
            self.bias = 30.0 if n1 else -30.0
            return
        flat = np.concatenate(rows) if rows else np.zeros(0, np.int32)
        at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        seen1 = np.bincount(flat, weights=y[at], minlength=size)
        seen0 = np.bincount(flat, minlength=size) - seen1
        p1, p0, p = (seen1 + 0.5) / (n1 + 1), (seen0 + 0.5) / (n0 + 1), (seen1 + seen0 + 1) / (len(y) + 2)
        z = (p1 - p0) / np.sqrt(p * (1 - p) * (1 / n1 + 1 / n0))
        scale = np.where(np.abs(z) >= LEAST_Z, np.log(p1 / p0), 0.0)
        kept = scale[flat] != 0
        flat, at = flat[kept], at[kept]
        value = scale[flat]
        w, c, b = np.zeros(size), np.zeros(more.shape[1]), np.log(n1 / n0)
        gw, gc, gb = np.full(size, 1e-8), np.full(more.shape[1], 1e-8), 1e-8
        for _ in range(STEPS):
            score = np.bincount(at, weights=w[flat] * value, minlength=len(y)) + more @ c + b
            error = (1 / (1 + np.exp(-np.clip(score, -30, 30))) - y) / len(y)
            d, e, g = np.bincount(flat, weights=error[at] * value, minlength=size) + 1e-6 * w, more.T @ error + 1e-6 * c, error.sum()
            gw, gc, gb = gw + d * d, gc + e * e, gb + g * g
            w, c, b = w - 0.3 * d / np.sqrt(gw), c - 0.3 * e / np.sqrt(gc), b - 0.3 * g / np.sqrt(gb)
        self.weights, self.extra, self.bias = (w * scale).astype(np.float32), c, float(b)

    def chances(self, rows: list[np.ndarray], more: np.ndarray) -> np.ndarray:
        score = np.array([float(self.weights[r].sum(dtype=np.float64)) for r in rows]) + more @ self.extra + self.bias
        return np.where([len(r) > 0 for r in rows], 1 / (1 + np.exp(-np.clip(score, -30, 30))), 0.0)


class Chain:
    """Linear models in order, with the threshold of each that does best out of fold."""

    def __init__(self, rows: list[np.ndarray], labels: np.ndarray, folds: np.ndarray):
        self.models: list[Linear] = []
        self.thresholds: list[float] = []
        earlier = np.zeros((len(rows), 0))
        for j in range(labels.shape[1]):
            y, unseen = labels[:, j].astype(float), np.zeros(len(rows))
            for k in range(FOLDS):
                into, held = np.flatnonzero(folds != k), np.flatnonzero(folds == k)
                if len(held):
                    model = Linear([rows[i] for i in into], earlier[into], y[into])
                    unseen[held] = model.chances([rows[i] for i in held], earlier[held])
            self.models.append(Linear(rows, earlier, y))
            self.thresholds.append(best_threshold(unseen, y))
            earlier = np.column_stack([earlier, unseen])

    def chances(self, rows: list[np.ndarray]) -> np.ndarray:
        out = np.zeros((len(rows), 0))
        for model in self.models:
            out = np.column_stack([out, model.chances(rows, out)])
        return out


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """Midpoint below the cut with the largest F1; 0.5 without both classes."""
    if not 0 < y.sum() < len(y):
        return 0.5
    order = np.argsort(-p, kind="stable")
    hit = np.cumsum(y[order])
    f1 = 2 * hit / (np.arange(len(y)) + 1 + y.sum())
    k = int(np.argmax(f1))
    return float((p[order][k] + p[order][min(k + 1, len(y) - 1)]) / 2)


def train_chain(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> Chain:
    """labels(doc_id, <category> ...) of 0 and 1 against docs(doc_id, text)."""
    names = [c for c in labels.columns if c != "doc_id"]
    one = labels.dropna().groupBy("doc_id").agg(F.min(F.struct(*names)).alias("l")).select("doc_id", "l.*")
    picked = one.withColumn("order", F.xxhash64(F.lit(8), "doc_id")).orderBy("order", "doc_id").limit(most)
    # `most` rows of a few numbers; of documents of one id the smallest text
    chosen = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").groupBy("doc_id", *names, "order").agg(F.min("text").alias("text"))

    def step(batch: pa.RecordBatch):
        found = [features(x or "").tobytes() for x in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary()), *batch.columns[2:]], ["features", *names, "order"])

    schema = "features binary, " + ", ".join(f"{c} int" for c in names) + ", order bigint"
    ints = [F.col(c).cast("int").alias(c) for c in names]
    got = sorted(by_batch(chosen.select("doc_id", "text", *ints, "order"), step, schema).collect(), key=lambda r: r.order)
    rows = [np.frombuffer(r.features, np.int32) for r in got]
    y = np.array([[r[c] for c in names] for r in got], np.int8).reshape(len(got), len(names))
    return Chain(rows, y, np.array([r.order % FOLDS for r in got], np.int64))


def score_documents(docs: DataFrame, chain: Chain, names: tuple[str, ...] = CATEGORIES) -> DataFrame:
    """Per document p_<category> and is_<category>."""
    shared = docs.sparkSession.sparkContext.broadcast(chain)

    def step(batch: pa.RecordBatch):
        p = shared.value.chances([features(x or "") for x in batch.column(1).to_pylist()])
        columns = [batch.column(0).cast(pa.int64())]
        for j, limit in enumerate(shared.value.thresholds):
            columns += [pa.array(np.round(p[:, j], 6), pa.float64()), pa.array(p[:, j] > limit, pa.bool_())]
        yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in schema.split(", ")])

    schema = ", ".join(["doc_id bigint", *(f"p_{c} double, is_{c} boolean" for c in names)])
    return by_batch(docs.select("doc_id", "text"), step, schema)


def op8_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    chain = train_chain(docs, labels.select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic"))
    return score_documents(docs, chain)
