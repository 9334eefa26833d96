"""Toxicity: a bidirectional gated recurrent network with attention pooling, written and trained in numpy.

A word enters as its embedding (one shared by all words rare in training) beside the scaled sum of the embeddings of its hashed
character n-grams. Every
document is read whole in overlapping windows; its score is that of its most toxic window, calibrated.
"""

from __future__ import annotations

import pickle
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoskein.llm.common import fold, labelled_sample, trimmed

WINDOW, STRIDE = 32, 16
HIDDEN, WORD_DIM, CHAR_DIM = 12, 12, 8
WORD_ROWS, CHAR_ROWS = 1 << 14, 1 << 15
#: Lengths in bytes of the character n-grams.
ORDERS = (3, 5, 7)
#: Training documents that a word must occur in to have an embedding of its own.
LEAST_DOCS = 4
#: Labelled rows that the model is fitted on at most, each with its whole text.
TRAIN_ROWS = 6000
CACHE = 150_000
CHUNK_WORDS = 120_000
PART_WORDS = 4_000
_MARKS = b".,;:!?\"'()[]{}|*$%&#-_"


def vocabulary(documents: Iterable[set[bytes]]) -> dict[bytes, int]:
    """Rows from 1 of the words in the most documents, at least LEAST_DOCS; words as features() strips them."""
    n = Counter(w for d in documents for w in {x.strip(_MARKS) for x in d})
    most = sorted((w for w, c in n.items() if c >= LEAST_DOCS and w), key=lambda w: (-n[w], w))[: WORD_ROWS - 1]
    return {w: k + 1 for k, w in enumerate(most)}


def features(vocab: dict[bytes, int], words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word rows (0: not in vocab), character n-gram rows of all words in turn (and one 0), and where each word's begin.

    Words lose the marks around them; ASCII letters are lower-cased before.
    """
    bare = [w.strip(_MARKS) for w in words]
    rows = np.fromiter((vocab.get(w, 0) for w in bare), np.int64, len(bare))
    text = np.frombuffer(b"".join(b"^" + w + b"$$" for w in bare) + bytes(max(ORDERS)), np.uint8).astype(np.uint64)
    sizes = np.fromiter((len(w) + 3 for w in bare), np.int64, len(bare))
    owner, ends = np.repeat(np.arange(len(bare)), sizes), np.cumsum(sizes)
    place = np.arange(len(owner))
    of, found = [], []
    for order in ORDERS:
        held = place[place + order <= ends[owner]]
        h = np.full(len(held), order, np.uint64)
        for k in range(order):
            h = (h ^ text[held + k]) * np.uint64(0x100000001B3)
        of.append(owner[held])
        found.append(((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % CHAR_ROWS)
    of, grams = np.concatenate(of), np.concatenate(found)
    by_word = np.argsort(of, kind="stable")
    return rows, np.append(grams[by_word], 0), np.searchsorted(of[by_word], np.arange(len(bare)))


def _features_in_parts(vocab: dict[bytes, int], words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """features() of many words in little memory."""
    rows, grams, starts, at = [], [], [], 0
    for k in range(0, len(words), PART_WORDS):
        r, g, s = features(vocab, words[k : k + PART_WORDS])
        rows.append(r.astype(np.int32))
        grams.append(g[:-1].astype(np.uint16))
        starts.append((s + at).astype(np.int32))
        at += len(g) - 1
    return np.concatenate(rows), np.concatenate([*grams, np.zeros(1, np.uint16)]), np.concatenate(starts)


def known_part(known: tuple[np.ndarray, np.ndarray, np.ndarray], a: int, b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The features of the words from a to b."""
    rows, grams, starts = known
    low, high = starts[a], starts[b] if b < len(starts) else len(grams) - 1
    return rows[a:b], np.append(grams[low:high], 0).astype(np.int64), (starts[a:b] - low).astype(np.int64)


def windows(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, first word, words) of every window; words are numbered through all documents.

    A document without words has one empty window. Windows overlap by half; the last ends with the document.
    """
    many = np.maximum(1, -(-np.maximum(0, lengths - WINDOW) // STRIDE) + 1)
    doc = np.repeat(np.arange(len(lengths)), many)
    k = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
    base = np.cumsum(lengths) - lengths
    return doc, base[doc] + k * STRIDE, np.minimum(WINDOW, lengths[doc] - k * STRIDE)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def initial(word_rows: int, seed: int = 11) -> dict[str, np.ndarray]:
    r = np.random.default_rng(seed)
    draw = lambda *shape, scale: (r.normal(size=shape) * scale).astype(np.float32)
    d, h = WORD_DIM + CHAR_DIM, HIDDEN
    made = {"word": draw(word_rows, WORD_DIM, scale=0.3), "char": draw(CHAR_ROWS, CHAR_DIM, scale=0.5), "att": draw(2 * h, scale=0.3), "out": draw(2 * h, scale=0.3), "bias": np.zeros(1, np.float32)}
    for side in "fb":
        made |= {f"wx{side}": draw(d, 3 * h, scale=d**-0.5), f"bx{side}": np.zeros(3 * h, np.float32), f"wh{side}": draw(h, 3 * h, scale=h**-0.5)}
    return made


def embedded(p: dict, rows: np.ndarray, grams: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Input vectors of distinct words."""
    if not len(rows):
        return np.zeros((0, WORD_DIM + CHAR_DIM), np.float32)
    n = np.diff(np.append(starts, len(grams) - 1)).astype(np.float32)
    chars = np.add.reduceat(p["char"][grams[:-1]], starts, axis=0) / np.sqrt(n)[:, None]
    return np.concatenate([p["word"][rows], chars], axis=1)


def projected(p: dict, x: np.ndarray) -> dict[str, np.ndarray]:
    """What each word adds to the gates of either direction."""
    return {side: x @ p[f"wx{side}"] + p[f"bx{side}"] for side in "fb"}


def forward(p: dict, gates: dict[str, np.ndarray], at: np.ndarray, mask: np.ndarray, keep: bool = False):
    """Logits of windows. at, mask: words and presence by (step, window); gates: projected() of the distinct words."""
    steps, many = at.shape
    h = HIDDEN
    states = np.zeros((steps, many, 2 * h), p["att"].dtype)
    kept = {}
    for side, order in (("f", range(steps)), ("b", range(steps - 1, -1, -1))):
        wh, own, s, trace = p[f"wh{side}"], gates[side], np.zeros((many, h), states.dtype), {}
        cols = slice(0, h) if side == "f" else slice(h, 2 * h)
        for t in order:
            gx, gh = own[at[t]], s @ wh
            rz = 1 / (1 + np.exp(-(gx[:, : 2 * h] + gh[:, : 2 * h])))
            r, z = rz[:, :h], rz[:, h:]
            n = np.tanh(gx[:, 2 * h :] + r * gh[:, 2 * h :])
            new = s + mask[t][:, None] * (1 - z) * (n - s)
            if keep:
                trace[t] = (s, r, z, n, gh[:, 2 * h :])
            s = new
            states[t, :, cols] = s
        kept[side] = trace
    e = states @ p["att"]
    e = np.where(mask > 0, e, -1e9)
    a = np.exp(e - e.max(axis=0))
    a *= mask
    a /= np.maximum(a.sum(axis=0), 1e-9)
    pooled = np.einsum("tb,tbh->bh", a, states)
    logits = pooled @ p["out"] + p["bias"][0]
    return (logits, states, a, pooled, kept) if keep else logits


def gradients(p: dict, words: tuple, at: np.ndarray, mask: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, dict]:
    """Mean weighted logistic loss of windows and its gradient by every parameter. words: features() of the distinct words."""
    rows, grams, starts = words
    x = embedded(p, *words)
    gates = projected(p, x)
    logits, states, a, pooled, kept = forward(p, gates, at, mask, keep=True)
    steps, many = at.shape
    h = HIDDEN
    prob = _sigmoid(logits)
    loss = float((-weight * np.where(y > 0, np.log(prob + 1e-9), np.log(1 - prob + 1e-9))).mean())
    d_logit = (weight * (prob - y) / many).astype(states.dtype)
    g = {"out": pooled.T @ d_logit, "bias": d_logit.sum(keepdims=True)}
    d_pooled = d_logit[:, None] * p["out"]
    d_a = np.einsum("bh,tbh->tb", d_pooled, states)
    d_e = a * (d_a - (a * d_a).sum(axis=0))
    d_states = a[:, :, None] * d_pooled + d_e[:, :, None] * p["att"]
    g["att"] = np.einsum("tb,tbh->h", d_e, states)
    d_x = np.zeros_like(x)
    by_word = np.argsort(at.ravel(), kind="stable")
    met, begins = np.unique(at.ravel()[by_word], return_index=True)
    for side, order in (("f", range(steps - 1, -1, -1)), ("b", range(steps))):
        wh, cols = p[f"wh{side}"], slice(0, h) if side == "f" else slice(h, 2 * h)
        d_s, d_wh, d_gates = np.zeros((many, h), wh.dtype), np.zeros_like(wh), np.zeros((len(x), 3 * h), wh.dtype)
        d_steps = np.zeros((steps, many, 3 * h), wh.dtype)
        for t in order:
            s, r, z, n, ghn = kept[side][t]
            d_new = d_states[t, :, cols] + d_s
            m = mask[t][:, None]
            d_n = d_new * m * (1 - z)
            d_z = d_new * m * (s - n)
            d_s = d_new * (1 - m * (1 - z))
            d_an = d_n * (1 - n * n)
            d_pre = np.concatenate([d_an * ghn * r * (1 - r), d_z * z * (1 - z), d_an], axis=1)
            d_gh = d_pre.copy()
            d_gh[:, 2 * h :] *= r
            d_wh += s.T @ d_gh
            d_s = d_s + d_gh @ wh.T
            d_steps[t] = d_pre
        d_gates[met] = np.add.reduceat(d_steps.reshape(-1, 3 * h)[by_word], begins, axis=0)
        g |= {f"wh{side}": d_wh, f"wx{side}": x.T @ d_gates, f"bx{side}": d_gates.sum(axis=0)}
        d_x += d_gates @ p[f"wx{side}"].T
    n = np.diff(np.append(starts, len(grams) - 1))
    for name, place, value in (("word", rows, d_x[:, :WORD_DIM]), ("char", grams[:-1], np.repeat(d_x[:, WORD_DIM:] / np.sqrt(n)[:, None], n, axis=0))):
        g[name] = np.stack([np.bincount(place, v, len(p[name])) for v in value.T], axis=1).astype(p[name].dtype)
    return loss, g


class _Words(dict):
    """A number for each distinct word; `new` holds those not looked up before."""

    def __init__(self):
        super().__init__()
        self.new: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self[word] = k = len(self)
        self.new.append(word)
        return k


def _laid(flat: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(step, window) arrays of words and of their presence."""
    step = np.arange(WINDOW)[:, None]
    mask = (step < size).astype(np.float32)
    return flat[np.minimum(first + step, max(0, len(flat) - 1))] if len(flat) else np.zeros(mask.shape, np.int64), mask


class Scorer:
    """Raw logits of documents' most toxic windows by a model."""

    def __init__(self, model: dict):
        self.p = model
        # a flush adds fewer than 2 * CHUNK_WORDS + WINDOW words to at most CACHE; rows that aren't written take no memory
        self.room = {side: np.empty((CACHE + 2 * CHUNK_WORDS + WINDOW, 3 * HIDDEN), np.float32) for side in "fb"}
        self.reset()

    def reset(self) -> None:
        self.words = _Words()
        self.words[b""] = 0
        self.words.new.append(b"")
        self.used = 0

    def _learn(self) -> None:
        for k in range(0, len(self.words.new), PART_WORDS):
            part = self.words.new[k : k + PART_WORDS]
            made = projected(self.p, embedded(self.p, *features(self.p["vocab"], part)))
            for side in "fb":
                self.room[side][self.used : self.used + len(part)] = made[side]
            self.used += len(part)
        self.words.new.clear()

    def logits(self, texts: list[bytes]) -> np.ndarray:
        """One for each text. Long texts go through in runs of words that overlap as windows do."""
        out = np.full(len(texts), -np.inf, np.float64)
        part: list[list[bytes]] = []
        owner: list[int] = []
        held = 0
        for k, text in enumerate(texts):
            words = text.lower().split()
            step = CHUNK_WORDS // STRIDE * STRIDE
            for at in range(0, max(1, len(words) - (WINDOW - STRIDE) if len(words) > step else 1), step):
                run = words[at : at + step + WINDOW - STRIDE]
                part.append(run)
                owner.append(k)
                held += len(run)
                if held >= CHUNK_WORDS:
                    self._flush(part, owner, out)
                    part, owner, held = [], [], 0
        if part:
            self._flush(part, owner, out)
        return out

    def _flush(self, part: list[list[bytes]], owner: list[int], out: np.ndarray) -> None:
        if len(self.words) > CACHE:
            self.reset()
        lengths = np.array([len(w) for w in part], np.int64)
        flat = np.fromiter((self.words[w] for run in part for w in run), np.int64, int(lengths.sum()))
        if self.words.new:
            self._learn()
        doc, first, size = windows(lengths)
        found = np.empty(len(doc), np.float32)
        for at in range(0, len(doc), 2048):
            sel = slice(at, at + 2048)
            found[sel] = forward(self.p, self.room, *_laid(flat, first[sel], size[sel]))
        np.maximum.at(out, np.array(owner)[doc], found)


class Corpus:
    """Training documents as runs of word numbers, in the order of their keys; texts aren't kept."""

    def __init__(self):
        self.words, self.rows = _Words(), []

    def add(self, key: tuple, text: bytes, label: int) -> None:
        self.rows.append((key, np.fromiter(map(self.words.__getitem__, text.lower().split()), np.int32), label))


def fit(corpus: Corpus, passes: int = 7, batch: int = 256, rate: float = 0.01, seed: int = 3) -> dict | None:
    """A model by Adam on windows: first on windows drawn at random, then on each document's most toxic ones.

    One document in five only calibrates the scores. None without both labels. Documents are numbered by their keys, so
    the model doesn't depend on the order in which they came. The corpus is empty afterwards.
    """
    rows = sorted(corpus.rows, key=lambda r: (r[0], r[2], len(r[1])))
    y = np.array([r[2] for r in rows], np.int64)
    if not 0 < y.sum() < len(y):
        return None
    # words numbered in their own order: sums of gradients don't depend on the order of arrival either
    seen = corpus.words.new or [b""]
    by_word = sorted(range(len(seen)), key=seen.__getitem__)
    number = np.empty(len(seen), np.int32)
    number[by_word] = np.arange(len(seen), dtype=np.int32)
    every = [seen[k] for k in by_word]
    lengths = np.array([len(r[1]) for r in rows], np.int64)
    flat = number[np.concatenate([r[1] for r in rows])]
    del rows, seen, by_word, number
    corpus.words.clear()
    corpus.words.new.clear()
    corpus.rows.clear()
    aside = np.arange(len(y)) % 5 == 4
    vocab = vocabulary({every[k] for k in np.unique(r)} for r, out in zip(np.split(flat, np.cumsum(lengths)[:-1]), aside, strict=True) if not out)
    known, many = _features_in_parts(vocab, every), len(every)
    del every
    doc, first, size = windows(lengths)
    draw = np.random.default_rng(seed)
    p = initial(len(vocab) + 1)
    m1, m2, step = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}, 0
    balance = min(8.0, float((y == 0).sum() / y.sum()))

    def all_logits() -> np.ndarray:
        x, found = np.empty((many, WORD_DIM + CHAR_DIM), np.float32), np.empty(len(doc), np.float32)
        for k in range(0, many, PART_WORDS):
            x[k : k + PART_WORDS] = embedded(p, *known_part(known, k, k + PART_WORDS))
        for k in range(0, len(doc), 2048):
            # gates of these windows' words alone: those of all words would take 288 bytes each
            at, mask = _laid(flat, first[k : k + 2048], size[k : k + 2048])
            near, own = np.unique(at, return_inverse=True)
            found[k : k + 2048] = forward(p, projected(p, x[near]), own.reshape(at.shape), mask)
        return found

    for n in range(passes):
        key = draw.random(len(doc)) if n < 2 else -all_logits() + 0.3 * draw.random(len(doc))
        most = 6 if n < 2 else 2
        order = np.lexsort((key, doc))
        rank = np.empty(len(doc), np.int64)
        rank[order] = np.arange(len(doc)) - np.searchsorted(doc[order], doc[order])
        # of a toxic document, later passes trust the top window alone
        chosen = np.flatnonzero(~aside[doc] & (rank < np.where((n >= 2) & (y[doc] > 0), 1, most)))
        chosen = draw.permutation(chosen)
        for k in range(0, len(chosen), batch):
            sel = chosen[k : k + batch]
            at, mask = _laid(flat, first[sel], size[sel])
            near, own = np.unique(at, return_inverse=True)
            begins = known[2][near]
            ends = np.append(known[2], len(known[1]) - 1)[near + 1]
            grams = np.concatenate([known[1][a:b] for a, b in zip(begins, ends, strict=True)] + [[0]]).astype(np.int64)
            starts = np.concatenate([[0], np.cumsum(ends - begins)[:-1]]).astype(np.int64)
            target = y[doc[sel]]
            _, g = gradients(p, (known[0][near], grams, starts), own.reshape(at.shape), mask, target, np.where(target > 0, balance, 1.0).astype(np.float32))
            step += 1
            for name, value in g.items():
                m1[name] += 0.1 * (value - m1[name])
                m2[name] += 0.001 * (value * value - m2[name])
                p[name] = (p[name] - rate * (m1[name] / (1 - 0.9**step)) / (np.sqrt(m2[name] / (1 - 0.999**step)) + 1e-7)).astype(np.float32)
    top = np.full(len(y), -np.inf)
    np.maximum.at(top, doc, all_logits())
    return p | {"vocab": vocab} | dict(zip(("slope", "shift"), calibration(top[aside], y[aside]), strict=True))


def calibration(logit: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(slope, shift) of a logistic curve through the labels (Platt's targets), by Newton's steps."""
    hi, lo = (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2)
    target = np.where(y > 0, hi, lo)
    w = np.array([1.0, 0.0])
    x = np.stack([logit, np.ones(len(logit))], axis=1)
    for _ in range(50):
        p = _sigmoid(x @ w)
        hess = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        w = w - np.clip(np.linalg.solve(hess, x.T @ (p - target) + 1e-3 * (w - [1.0, 0.0])), -2, 2)
    return max(0.05, float(w[0])), float(w[1])


def fitted(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> dict | None:
    """The model of at most train_rows labelled training documents, fitted in one task; the driver gets it alone.

    A document whose id stands on several rows is trained on once for each. None without labels of both kinds.
    """

    def gathered(batches: Iterator[pd.DataFrame]) -> Corpus:
        corpus = Corpus()
        for pdf in batches:
            for key, text, label in zip(pdf.doc_id, pdf.text, pdf.label):
                corpus.add((xxhash.xxh64_intdigest(str(key)), key), bytes(text), int(label))
        return corpus

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame({"model": [pickle.dumps(fit(gathered(batches)))]})

    sample = labelled_sample(docs, labels, "toxic", train_rows).select("doc_id", F.col("text").cast("binary").alias("text"), "label")
    made = [r.model for r in sample.repartition(1).mapInPandas(trimmed(run), "model binary").collect()]
    return pickle.loads(made[0]) if made else None


def scored(docs: DataFrame, model: dict | None, id_col: str = "doc_id", text_col: str = "text", cut: float = 0.5) -> DataFrame:
    """(id, held_out, score, predicted) for every row, from the text alone.

    Null counts as empty text, read as one empty window. Without a model (no labels of both kinds) every score is
    0. Repeated rows and null ids are scored like others; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = shared.value and Scorer(shared.value)
        for pdf in batches:
            p = _sigmoid(own.p["slope"] * own.logits(list(map(bytes, pdf.text))) + own.p["shift"]) if own else np.zeros(len(pdf))
            yield pd.DataFrame({"id": pdf["id"], "held_out": pdf.held_out, "score": p, "predicted": (p >= cut).astype(np.int32)})

    rows = docs.select(F.col(id_col).cast("long").alias("id"), (fold(F.col(id_col)) == 0).alias("held_out"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"))
    return rows.mapInPandas(trimmed(score), "id long, held_out boolean, score double, predicted int").withColumnRenamed("id", id_col)
