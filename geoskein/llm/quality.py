"""Document quality: logistic regression on hashed word n-grams, fitted by follow-the-regularised-leader updates.

Words are runs of word characters or of other signs; a feature is a hashed word or pair of neighbours, its value
the share of the document's n-grams it makes up. A score is one sparse dot product over the whole text.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoskein.llm.common import fold, labelled_sample, trimmed

BITS = 18
#: Labelled rows that the model is fitted on at most.
TRAIN_ROWS = 6000
EPOCHS = 8
CUT = 0.3
#: The feature of a word that follows itself, whichever word it is.
REPEAT = 0
_WORD = re.compile(r"\w+|[^\w\s]+")
_CACHE = 400_000


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= _CACHE:
            self.clear()
        self[word] = found = xxhash.xxh64_intdigest(word) >> 1
        return found


_HASHES = _Hashes()


def forget() -> None:
    """The hashes that this worker keeps go; it may wait long for its next task."""
    _HASHES.clear()


def ngrams(text: str) -> np.ndarray:
    """Feature numbers of a text's words and pairs of neighbours, with repetition; none for a text without words."""
    words = _WORD.findall(text)
    one = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    shift = np.uint64(63 - BITS)
    pair = (one[:-1] * np.uint64(0x9E3779B97F4A7C15) + one[1:] * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(64 - BITS)
    pair[one[:-1] == one[1:]] = REPEAT
    return np.concatenate([one >> shift, pair]).astype(np.int64)


def counted(text: str) -> tuple[np.ndarray, np.ndarray]:
    at, n = np.unique(ngrams(text), return_counts=True)
    return at, (n / max(1, n.sum())).astype(np.float32)


class Ftrl:
    """Per-coordinate follow-the-regularised-leader for logistic loss (McMahan et al. 2013)."""

    def __init__(self, size: int, alpha: float = 2.0, beta: float = 0.05, l1: float = 0.002, l2: float = 0.002):
        self.z, self.n = np.zeros(size), np.zeros(size)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        moved = np.sign(z) * self.l1 - z
        return np.where(np.abs(z) <= self.l1, 0.0, moved / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, x: np.ndarray, y: int) -> None:
        w = self.weights(at)
        p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
        g = (p - y) * x
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = EPOCHS, bits: int = BITS) -> np.ndarray:
    """Weights, the intercept last. Without rows all are zero, so that every score is 0.5."""
    model, bias = Ftrl(2**bits + 1), 2**bits
    order = np.random.default_rng(7)
    rows = [(np.append(at, np.int32(bias)), np.append(x, np.float32(1)), y) for at, x, y in rows]
    for _ in range(epochs):
        for k in order.permutation(len(rows)):
            model.learn(*rows[k])
    return model.weights().astype(np.float32)


def fitted(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> np.ndarray:
    """The weights fitted on a bounded sample of labelled training documents, in one task; the driver gets them alone.

    A document whose id stands on several rows is trained on once for each.
    """

    def features(batches):
        for pdf in batches:
            made = [counted(t) for t in pdf.text]
            yield pd.DataFrame({"doc_id": pdf.doc_id, "at": [m[0].astype(np.int32).tobytes() for m in made], "x": [m[1].tobytes() for m in made], "label": pdf.label})
        forget()

    def run(batches):
        rows = sorted((r for pdf in batches for r in zip(pdf.doc_id, pdf.label, pdf["at"], pdf.x)))
        yield pd.DataFrame({"weights": [fit([(np.frombuffer(at, np.int32), np.frombuffer(x, np.float32), int(y)) for _, y, at, x in rows]).tobytes()]})

    sample = labelled_sample(docs, labels, "quality", train_rows).mapInPandas(trimmed(features), "doc_id long, at binary, x binary, label int")
    made = sample.repartition(1).mapInPandas(trimmed(run), "weights binary").collect()
    return np.frombuffer(made[0].weights, np.float32) if made else fit([])


def scored(docs: DataFrame, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text", cut: float = CUT) -> DataFrame:
    """(id, held_out, score, predicted) for every row; the text alone makes the score.

    Null counts as empty text, which gets the intercept's score. Repeated rows and null ids are scored like others;
    other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(weights)

    def score(batches):
        w = shared.value
        for pdf in batches:
            logits = np.fromiter((w[a].sum(dtype=np.float64) / max(1, len(a)) for a in map(ngrams, pdf.text)), np.float64, len(pdf)) + w[-1]
            p = 1 / (1 + np.exp(-np.clip(logits, -35, 35)))
            yield pd.DataFrame({"id": pdf["id"], "held_out": pdf.held_out, "score": p, "predicted": (p >= cut).astype(np.int32)})
        forget()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), (fold(F.col(id_col)) == 0).alias("held_out"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.mapInPandas(trimmed(score), "id long, held_out boolean, score double, predicted int").withColumnRenamed("id", id_col)
