"""Toxicity: character n-gram linear classifier scaled by naive Bayes log-count ratios (Wang and Manning, 2012).

Features are the character n-grams a text holds (each once), hashed to 2**20 slots.
On labelled text each slot gets the ratio r = log((p/|p|) / (q/|q|)) of its smoothed
counts in toxic and clean documents; a logistic regression is fitted on the features
scaled by r. A score is the sigmoid of the sum of r * v over a text's slots.

The fit uses at most ``max_rows`` labelled documents (those of least hash). They are
halved by a checksum of the text and each half gives a model; a text is scored by the
model of the half it is not in, so a wrong label is not remembered for its own text.
A fit is a bounded task, a model a fixed 4 MB. Scoring is one pass without a shuffle
over every whole text, in blocks, so memory does not grow with a text's length.

Nulls: a null text scores as an empty one; labels that are null or not 0 or 1, or
have no document, are not learnt. Repeated label rows of a document count once (the
greatest label), repeated documents once (the least text). With no labels at all, or
of one class only, every text gets the prior and is not toxic unless all labels are.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_ROWS = 12000     # labelled documents the fit may use
ORDERS = (4, 5)
SLOT_BITS = 20
SMOOTHING = 1.0
MIN_DOCUMENTS = 10   # labelled documents an n-gram must stand in: rarer ones only let the fit remember single texts
EPOCHS = 3
RATE = 0.02
DECAY = 1e-3
BLOCK = 1 << 18      # code points hashed at once


@dataclass(frozen=True)
class Model:
    weights: np.ndarray  # float32, one for each slot: r * v
    bias: float


def _codes(text: str) -> np.ndarray:
    """Code points of the lower-cased text, white-space runs as one blank, one at either end."""
    return np.frombuffer(f" {' '.join(text.lower().split())} ".encode("utf-32-le"), dtype="<u4")


def _block_slots(codes: np.ndarray) -> np.ndarray:
    found = []
    h = codes * np.uint32(2654435761)
    for n in range(2, max(ORDERS) + 1):
        if len(codes) < n:
            break
        h = h[:-1] * np.uint32(0x01000193) + codes[n - 1:] * np.uint32(2246822519)
        if n in ORDERS:
            g = h ^ np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)
            g = (g ^ (g >> np.uint32(15))) * np.uint32(2146121005)
            g = (g ^ (g >> np.uint32(13))) * np.uint32(2221713035)
            found.append(g >> np.uint32(32 - SLOT_BITS))
    return np.unique(np.concatenate(found)) if found else np.empty(0, np.uint32)


def slots(text: str | None) -> np.ndarray:
    """The distinct slots of a text's n-grams."""
    codes = _codes(text or "")
    if len(codes) <= BLOCK:
        return _block_slots(codes)
    seen = np.zeros(1 << SLOT_BITS, dtype=bool)
    for i in range(0, len(codes), BLOCK):  # blocks share the n-grams that cross their edge
        seen[_block_slots(codes[i:i + BLOCK + max(ORDERS) - 1])] = True
    return np.flatnonzero(seen).astype(np.uint32)


def fit_rows(texts: list[str | None], labels: np.ndarray, seed: int = 0) -> Model:
    n1 = int(labels.sum())
    n0 = len(labels) - n1
    weights = np.zeros(1 << SLOT_BITS, dtype=np.float32)
    if not n1 or not n0:
        return Model(weights, float(np.log((n1 + 0.5) / (n0 + 1.0))) if len(labels) else -1.0)
    x = [slots(t) for t in texts]
    p, q = np.full(1 << SLOT_BITS, SMOOTHING), np.full(1 << SLOT_BITS, SMOOTHING)
    for own, y in zip(x, labels):
        (p if y else q)[own] += 1
    r = np.log((p / p.sum()) / (q / q.sum())).astype(np.float32)
    if len(x) > 10 * MIN_DOCUMENTS:
        r[p + q - 2 * SMOOTHING < MIN_DOCUMENTS] = 0
    v, seen = np.zeros_like(r), np.full(1 << SLOT_BITS, 1e-6, dtype=np.float32)
    bias, bias_seen = 0.0, 1e-6
    rng = np.random.default_rng(seed)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(x)):  # AdaGrad on the logistic loss
            own = x[i]
            scaled = r[own]
            step = 1 / (1 + np.exp(-np.clip(float(scaled @ v[own]) + bias, -30, 30))) - labels[i]
            grad = step * scaled + DECAY * v[own]
            seen[own] += grad * grad
            v[own] -= RATE * grad / np.sqrt(seen[own])
            bias_seen += step * step
            bias -= RATE * step / np.sqrt(bias_seen)
    return Model((r * v).astype(np.float32), float(bias))


def half(text: str | None) -> int:
    return zlib.crc32((text or "").encode()) % 2


def score_text(text: str | None, models: list[Model]) -> float:
    """Score by the model of the half that ``text`` is not in."""
    model = models[1 - half(text)]
    z = float(model.weights[slots(text)].sum(dtype=np.float64)) + model.bias
    return float(1 / (1 + np.exp(-np.clip(z, -700, 700))))


# ---------------------------------------------------------------- on tables
def fit(docs: DataFrame, labels: DataFrame, *, max_rows: int = MAX_ROWS, seed: int = 0) -> list[Model]:
    """Models of the two halves of at most ``max_rows`` labelled documents; ``labels`` has doc_id and toxic."""
    marked = (labels.where("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy("doc_id")
              .agg(F.max("toxic").cast("int").alias("label"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows))
    texts = (docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
             .join(F.broadcast(marked), "doc_id")  # at most max_rows pairs of numbers
             .groupBy("doc_id", "label").agg(F.min("text").alias("text")))

    def train(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("doc_id")
        model = fit_rows(pdf["text"].tolist(), pdf["label"].to_numpy(), seed)
        return pd.DataFrame({"half": pdf["half"].iloc[:1], "weights": [model.weights.tobytes()], "bias": [model.bias]})

    got = {r["half"]: Model(np.frombuffer(bytes(r["weights"]), dtype=np.float32), r["bias"])
           for r in texts.withColumn("half", (F.crc32(F.encode("text", "utf-8")) % 2).cast("int")).groupBy("half")
           .applyInPandas(train, "half int, weights binary, bias double").collect()}
    any_ = next(iter(got.values()), None) or fit_rows([], np.empty(0, dtype=int))
    return [got.get(0, any_), got.get(1, any_)]


def score(docs: DataFrame, models: list[Model], text: str = "text") -> Column:
    """Column with the score (0 to 1) of each row's whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(models)

    @F.pandas_udf("double")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([score_text(t, shared.value) for t in texts], dtype=float)

    return of(F.col(text).cast("string"))


def held_out(doc_id: str = "doc_id") -> Column:
    """True for the fold that is never learnt: crc32 of the id as text is divisible by 5 (a null id is not)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def classify(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """doc_id, held_out, score, predicted for every document, learnt from the labels outside the held-out fold."""
    models = fit(docs, labels.where(~held_out()), **options)
    return (docs.select("doc_id", held_out().alias("held_out"), score(docs, models).alias("score"))
            .withColumn("predicted", (F.col("score") >= 0.5).cast("int")))
