"""Likelihood of documents under a lattice of word pieces.

A text is its words (ASCII-lower-cased, marked with U+2581) and one end. Every segmentation of a word into pieces of
an existing vocabulary counts, weighted by the product of the pieces' probabilities, and a forward recursion in
log space sums them. The vocabulary's scores, which are merge ranks, give the first weights by Zipf's law;
expectation-maximisation steps over all training words, each as often as it occurs, fit them to the corpus. The end is a
piece of its own, so that pieces and end sum to 1. A document's `lattice_score` is the logarithm of this probability.

Words seen in training may be edges of the lattice as well (word_edges), so that

    P(word | class) = (1 - b) * (0.95 * c_class / N_class + 0.05 * c / N) + b * sum over segmentations,

where b is the share of tokens that are seen once (Good and Turing's mass of the unseen), and N counts ends too.
Classes are the languages of the training documents, the most frequent CLASSES - 1 and the rest; the language of
a scored document isn't looked at, its probability is the sum over all classes. `score` is this probability with word
edges, and `lattice_score` again without.

Counts are a distributed table. Only some HOT_WORDS most frequent words travel to every worker; the rest of the
tokens are joined with the table.
"""

from __future__ import annotations

import math
import pickle
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoskein.llm.common import fold, materialise
from geoskein.llm.sp_viterbi import MARK, Vocabulary, vocabulary

HOT_WORDS = 100_000
CLASSES = 6
#: Weight of the vocabulary's own scores beside expected counts.
PRIOR = 1000.0
#: Expectation-maximisation steps.
STEPS = 2
FLUSH = 400_000
#: Words up to this length are computed together with others as long, longer ones alone.
TOGETHER = 48
_P, _C = np.uint64(0x100000001B3), np.uint64(0x9E3779B97F4A7C15)
_SLOTS = 20


def tokens(text: bytes) -> list[bytes]:
    """ASCII-lower-cased words between runs of ASCII white space."""
    return text.lower().split()


class Lattice:
    """Pieces with log probabilities (natural) that sum to 1 together with the end's; byte pieces serve characters no
    piece begins with. counts: expected uses of the pieces; ends: those of the end."""

    def __init__(self, v: Vocabulary, counts: np.ndarray | None = None, ends: float = 0.0):
        n = len(v.text_of)
        ranks = np.full(n, np.inf)
        for k, score in v.ids.values():
            ranks[k] = -score
        prior = 1 / (ranks + 10)
        for k in v.bytes_at.values():
            prior[k] = 1 / n**2
        prior /= prior.sum()
        p = prior if counts is None else (counts + PRIOR * prior) / (counts.sum() + PRIOR + ends)
        self.end = math.log(ends / (counts.sum() + PRIOR + ends)) if ends else 0.0
        with np.errstate(divide="ignore"):
            self.log = np.log(p)
        self.pieces = {piece: (k, float(self.log[k])) for piece, (k, _) in v.ids.items()}
        # a trie as a dictionary: every beginning of a piece, with the piece if it is one
        self.trie: dict[str, tuple[int, float] | None] = {piece[:n]: None for piece in self.pieces for n in range(1, len(piece))} | self.pieces
        self.byte_ids = v.bytes_at

    def edges(self, s: str) -> tuple[list[tuple[int, int, tuple[int, ...] | int, float]], list[float]]:
        """All edges (start, end, piece id or byte ids, log probability) by their start, and the forward sums (log) up to
        every place."""
        get, n = self.trie.get, len(s)
        alpha, into = [0.0] + [-math.inf] * n, [[] for _ in range(n + 1)]
        out = []
        for start in range(n):
            if start:
                terms = into[start]
                if not terms:
                    continue
                alpha[start] = terms[0] if len(terms) == 1 else summed(terms)
            here, end = alpha[start], start + 1
            one = s[start]
            if one not in self.pieces:
                ids = tuple(self.byte_ids[b] for b in one.encode("utf-8", "surrogatepass"))
                lp = float(sum(self.log[k] for k in ids))
                out.append((start, end, ids, lp))
                into[end].append(here + lp)
            while end <= n:
                found = get(s[start:end], False)
                if found is False:
                    break
                if found is not None:
                    out.append((start, end, found[0], found[1]))
                    into[end].append(here + found[1])
                end += 1
        if n:
            alpha[n] = summed(into[n])
        return out, alpha

    def _table(self) -> None:
        """Pieces by a hash of their characters, for looking up many at once (linear probing)."""
        self.keys, self.at = np.zeros(1 << _SLOTS, np.uint64), np.full(1 << _SLOTS, -1, np.int32)
        for piece, (k, _) in self.pieces.items():
            h = np.uint64(len(piece))
            with np.errstate(over="ignore"):
                for c in piece:
                    h = (h ^ np.uint64(ord(c))) * _P
                slot = int((h * _C) >> np.uint64(64 - _SLOTS))
            while self.at[slot] >= 0:
                slot = (slot + 1) % (1 << _SLOTS)
            self.keys[slot], self.at[slot] = h, k
        self.longest = max(map(len, self.pieces))
        self.log_or_none = np.append(self.log, -np.inf)

    def _lookup(self, h: np.ndarray) -> np.ndarray:
        """Ids of the pieces with these hashes, -1 for none."""
        slot = ((h * _C) >> np.uint64(64 - _SLOTS)).astype(np.int64)
        found = np.where(self.keys[slot] == h, self.at[slot], -1)
        left = np.flatnonzero((found.ravel() < 0) & (self.at[slot.ravel()] >= 0))
        flat, where, key = found.ravel(), slot.ravel()[left], h.ravel()[left]
        while len(left):
            where = (where + 1) % (1 << _SLOTS)
            hit = self.keys[where] == key
            flat[left[hit]] = self.at[where[hit]]
            go = ~hit & (self.at[where] >= 0)
            left, where, key = left[go], where[go], key[go]
        return flat.reshape(h.shape)

    def _together(self, words: list[str], expected: np.ndarray | None, times: np.ndarray) -> np.ndarray:
        """log_probability() of words of one length, and their expected pieces, so many times, added to `expected`. Row
        k - 1 of the pieces and their logs holds those of k characters, by where they start."""
        n, many = len(words[0]), len(words)
        chars = np.array(words, dtype=f"<U{n}").view(np.uint32).reshape(many, n).T.astype(np.uint64)
        ids = []
        for k in range(1, min(n, self.longest) + 1):
            h = np.full((n - k + 1, many), k, np.uint64)
            for j in range(k):
                h = (h ^ chars[j : j + n - k + 1]) * _P
            ids.append(self._lookup(h))
        logs = [self.log_or_none[i] for i in ids]
        lone = np.argwhere(ids[0] < 0)
        fallback = []
        for t, w in lone.tolist():
            own = [self.byte_ids[b] for b in words[w][t].encode("utf-8", "surrogatepass")]
            logs[0][t, w] = self.log[own].sum()
            fallback.append((t, w, own))
        alpha = np.full((n + 1, many), -np.inf)
        alpha[0] = 0
        with np.errstate(invalid="ignore"):
            for end in range(1, n + 1):
                alpha[end] = _summed_rows(np.stack([alpha[end - k] + logs[k - 1][end - k] for k in range(1, min(end, len(logs)) + 1)]))
            if expected is not None:
                beta = np.full((n + 1, many), -np.inf)
                beta[n] = 0
                for start in range(n - 1, -1, -1):
                    beta[start] = _summed_rows(np.stack([beta[start + k] + logs[k - 1][start] for k in range(1, min(n - start, len(logs)) + 1)]))
                for k in range(1, len(logs) + 1):
                    use = ids[k - 1] >= 0
                    share = np.exp(np.minimum(0, alpha[: n - k + 1] + logs[k - 1] + beta[k:] - alpha[n])) * times
                    expected += np.bincount(ids[k - 1][use], weights=np.nan_to_num(share[use]), minlength=len(expected))
                    if k == 1:
                        for t, w, own in fallback:
                            np.add.at(expected, own, share[t, w])
        return alpha[n]

    def log_probabilities(self, words: list[bytes], expected: np.ndarray | None = None, times: np.ndarray | None = None) -> np.ndarray:
        """log_probability() of each word; `expected`, if given, gains what expect() adds for each, so many times."""
        times = np.ones(len(words)) if times is None else times
        if not hasattr(self, "keys"):
            self._table()
        out = np.zeros(len(words))
        by_size: dict[int, list[int]] = {}
        texts = [MARK + w.decode("utf-8", "replace") for w in words]
        for k, s in enumerate(texts):
            if len(s) <= TOGETHER and s[-1] != chr(0):  # numpy's strings lose zeros at their end
                by_size.setdefault(len(s), []).append(k)
            else:
                out[k] = self.log_probability(words[k])
                if expected is not None:
                    self.expect(words[k], expected, times[k])
        for size, own in by_size.items():
            for at in range(0, len(own), 4096):
                part = own[at : at + 4096]
                out[part] = self._together([texts[k] for k in part], expected, times[part])
        return out

    def log_probability(self, word: bytes) -> float:
        """Of all segmentations of a word together."""
        return self.edges(MARK + word.decode("utf-8", "replace"))[1][-1]

    def expect(self, word: bytes, into: np.ndarray, weight: float = 1.0) -> None:
        """Add the expected number of uses of each piece in a word."""
        s = MARK + word.decode("utf-8", "replace")
        edges, alpha = self.edges(s)
        beta = [-math.inf] * len(s) + [0.0]
        terms: list[list[float]] = [[] for _ in s]
        at, exp, total = len(s), math.exp, alpha[-1]
        for start, end, _, lp in reversed(edges):
            # edges come by start: once one of an earlier start is met, all that leave a place are in
            if start < at:
                for k in range(start + 1, min(at, len(s) - 1) + 1):
                    if terms[k]:
                        beta[k] = summed(terms[k])
                at = start
            if beta[end] > -math.inf:
                terms[start].append(lp + beta[end])
        for start, end, ids, lp in edges:
            share = weight * exp(min(0.0, alpha[start] + lp + beta[end] - total))
            if isinstance(ids, int):
                into[ids] += share
            else:
                for k in ids:
                    into[k] += share


def _summed_rows(x: np.ndarray) -> np.ndarray:
    """log of the sum of exp over the first axis."""
    top = x.max(axis=0)
    safe = np.where(np.isfinite(top), top, 0.0)
    with np.errstate(divide="ignore"):
        return np.where(np.isfinite(top), safe + np.log(np.exp(x - safe).sum(axis=0)), -np.inf)


def summed(terms: list[float]) -> float:
    if len(terms) == 1:
        return terms[0]
    top = max(terms, default=-math.inf)
    return top if top == -math.inf else top + math.log(sum(math.exp(t - top) for t in terms))


def _counts(docs: DataFrame, langs: list[str]) -> DataFrame:
    """(word, c0, c1, ...) of training documents: counts by class; the empty word stands for the end."""
    class_of = {lang: k for k, lang in enumerate(langs)}
    many = len(langs) + 1

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[Counter] = [Counter() for _ in range(many)]

        def rows() -> pd.DataFrame:
            out = pd.DataFrame([(w, k, n) for k, c in enumerate(held) for w, n in c.items()], columns=["word", "k", "n"])
            for c in held:
                c.clear()
            return out

        for pdf in batches:
            for text, lang in zip(pdf.text, pdf.lang):
                own = held[class_of.get(lang, many - 1)]
                own.update(tokens(text))
                own[b""] += 1
                if sum(map(len, held)) > FLUSH:
                    yield rows()
        yield rows()

    flat = docs.filter("not held_out").select("text", "lang").mapInPandas(run, "word binary, k int, n long")
    return flat.groupBy("word").agg(*[F.sum(F.when(F.col("k") == k, F.col("n")).otherwise(0)).alias(f"c{k}") for k in range(many)])


class Model:
    """What word counts become: logs of a word's probability in each class, and its base score."""

    def __init__(self, lattice: Lattice, sums: np.ndarray, ends: np.ndarray, distinct: int, once: int):
        self.lattice, self.sums, self.ends = lattice, sums.astype(np.float64), ends.astype(np.float64)
        self.total = float(self.sums.sum())
        self.unseen = min(0.5, max(once, 1) / self.total) if self.total else 1.0
        self.base_floor = math.log10(self.total + 0.5 * (distinct + 1))

    def seen(self, counts: np.ndarray) -> np.ndarray:
        """(words, classes) probabilities of the whole-word edges. counts: (words, classes)."""
        if not self.total:
            return np.zeros(counts.shape)
        own = counts / np.maximum(1, self.sums)
        return (1 - self.unseen) * (0.95 * own + 0.05 * counts.sum(axis=1, keepdims=True) / self.total)

    def word_logs(self, words: list[bytes], counts: np.ndarray) -> np.ndarray:
        """Logs of each word's probability in every class with word edges, and last by the lattice alone."""
        pieces = self.lattice.log_probabilities(words)[:, None]
        with np.errstate(divide="ignore"):
            return np.concatenate([np.logaddexp(np.log(self.seen(counts)), math.log(self.unseen) + pieces), pieces], axis=1)

    def base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10(counts.sum(axis=1) + 0.5) - self.base_floor

    def end_logs(self) -> np.ndarray:
        return np.log(np.maximum(self.seen(self.ends[None, :])[0], 1e-300))

    def class_logs(self) -> np.ndarray:
        return np.log((self.ends + 0.5) / (self.ends.sum() + 0.5 * len(self.ends)))


def _frequent(table: DataFrame, names: list[str], distinct: int, most: int) -> tuple[list[bytes], np.ndarray]:
    """About `most` most frequent words, at most a tenth more, with their counts. Each partition sends what is above one
    threshold for all, in one piece."""
    total = sum((F.col(c) for c in names[1:]), F.col(names[0]))
    if distinct > most:
        least = table.agg(F.percentile_approx(total, 1 - most / distinct, max(10_000, 10 * distinct // most))).first()[0]
        table = table.filter(total > F.lit(least))

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                yield pd.DataFrame({"packed": [pickle.dumps(([bytes(w) for w in pdf.word], pdf[names].to_numpy(np.int64)))]})

    parts = [pickle.loads(r.packed) for r in table.mapInPandas(pack, "packed binary").collect()]
    words = [w for own, _ in parts for w in own]
    return words, np.concatenate([c for _, c in parts]) if parts else np.zeros((0, len(names)), np.int64)


def scored(docs: DataFrame, pieces: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", hot_words: int = HOT_WORDS, word_edges: bool = True) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score, lattice_score) for every row; scores are log10.

    lattice_score is the marginal over the segmentations into pieces alone; score has training words as edges too, or
    without word_edges is the same.

    Null text counts as empty: its only token is the end. Repeated rows count each, in training as well; null ids
    fall into the fold of the empty text. Without training rows every word is unseen. Empty in, empty out.
    """
    spark = docs.sparkSession
    lang = F.col(lang_col).cast("string") if lang_col in docs.columns else F.lit(None).cast("string")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), lang.alias("lang"), (fold(F.col(id_col)) == 1).alias("held_out"))
    top = rows.filter("not held_out and lang is not null").groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(CLASSES - 1).collect()
    langs = [r.lang for r in top]
    many = len(langs) + 1
    names = [f"c{k}" for k in range(many)]
    table = materialise(_counts(rows, langs), "words")
    all_c = sum((F.col(c) for c in names[1:]), F.col("c0"))
    facts = table.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names], F.count(F.lit(1)).alias("v"), F.count(F.when(all_c == 1, 1)).alias("once")).first()
    ends = table.filter(F.length("word") == 0).select(*names).first()
    sums, ends = np.array([facts[c] for c in names]), np.array(ends if ends else [0] * many)

    lattice = Lattice(vocabulary(pieces))
    size = len(lattice.log)
    words_of = table.filter(F.length("word") > 0).select("word", all_c.alias("n"))
    for _ in range(STEPS):
        fitted = spark.sparkContext.broadcast(lattice)

        def expect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            into = np.zeros(size)
            for pdf in batches:
                fitted.value.log_probabilities([bytes(w) for w in pdf.word], into, pdf.n.to_numpy(np.float64))  # noqa: B023
            used = np.flatnonzero(into)
            yield pd.DataFrame({"piece": used, "n": into[used]})

        # a row for each piece of the vocabulary
        found = words_of.mapInPandas(expect, "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect()
        expected = np.zeros(size)
        for r in sorted(found, key=lambda r: r.piece):
            expected[r.piece] = r.n
        lattice = Lattice(vocabulary(pieces), expected, float(ends.sum()))
    model = Model(lattice, sums, ends, facts["v"], facts["once"])
    shared = spark.sparkContext.broadcast(model)
    hot_list, counts = _frequent(table.filter(F.length("word") > 0).select("word", *names), names, facts["v"], hot_words)
    logs = model.word_logs(hot_list, counts) if hot_list else np.zeros((0, many + 1))
    hot = spark.sparkContext.broadcast((hot_list, np.concatenate([logs, model.base(counts)[:, None]], axis=1) if hot_list else np.zeros((0, many + 2))))
    s_names = [*[f"s{k}" for k in range(many)], "alone"]
    float_cols = [*s_names, "base"]

    def tally(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        key = TaskContext.get().partitionId() << 36
        place, sheet = {w: k for k, w in enumerate(hot.value[0])}, hot.value[1]
        get = place.get
        for pdf in batches:
            own, rare = [], []
            for i, text, held in zip(pdf["id"], pdf.text, pdf.held_out):
                words = tokens(bytes(text))
                at = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
                good = at[at >= 0]
                own.append((key, i, held, len(words) + 1, len(good), *sheet[good].sum(axis=0).tolist()))
                rare += [(key, w, n) for w, n in Counter([words[k] for k in np.flatnonzero(at < 0).tolist()]).items()]
                key += 1
                if len(rare) > FLUSH:
                    yield pd.DataFrame(rare, columns=["key", "word", "n_tokens"])
                    rare = []
            yield pd.DataFrame(own, columns=["key", "id", "held_out", "n_tokens", "n_known", *float_cols])
            yield pd.DataFrame(rare, columns=["key", "word", "n_tokens"])

    def whole(frames):
        kinds = {"id": "Int64", "held_out": "boolean", "n_tokens": "Int64", "n_known": "Int64"}

        def run(batches):
            for f in frames(batches):
                f = f.reindex(columns=["key", "id", "held_out", "n_tokens", "n_known", "word", *float_cols])
                yield f.astype({"key": "int64"} | kinds | dict.fromkeys(float_cols, "float64"))

        return run

    schema = "key long, id long, held_out boolean, n_tokens long, n_known long, word binary, " + ", ".join(f"{c} double" for c in float_cols)
    tallied = materialise(rows.select("id", "text", "held_out").mapInPandas(whole(tally), schema), "tallied")
    rare = tallied.filter(F.col("word").isNotNull()).select("key", "word", F.col("n_tokens").alias("n"))

    def word_logs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = shared.value
        for pdf in batches:
            c = pdf[names].fillna(0).to_numpy(np.int64).reshape(len(pdf), many)
            out = pd.DataFrame(own.word_logs([bytes(w) for w in pdf.word], c), columns=s_names) if len(pdf) else pd.DataFrame(columns=s_names, dtype=float)
            yield out.assign(word=pdf.word.to_numpy(), base=own.base(c), known=(c.sum(axis=1) > 0).astype(np.int64))

    words = rare.select("word").distinct().join(table, "word", "left").mapInPandas(word_logs, ", ".join(f"{c} double" for c in s_names) + ", word binary, base double, known long")
    parts = rare.join(words, "word").groupBy("key").agg(F.sum(F.col("n") * F.col("known")).alias("n_known"), *[F.sum(F.col("n") * F.col(c)).alias(c) for c in float_cols])
    both = tallied.filter(F.col("word").isNull()).select("key", "id", "held_out", "n_tokens", "n_known", *float_cols).unionByName(parts, allowMissingColumns=True)
    one = both.groupBy("key").agg(F.max("id").alias("id"), F.max("held_out").alias("held_out"), F.max("n_tokens").alias("n_tokens"), F.sum("n_known").alias("n_known"), *[F.sum(c).alias(c) for c in float_cols])
    end_known = int(ends.sum() > 0)
    at_end, prior = model.end_logs(), model.class_logs()
    joint = [F.col(c) + F.lit(float(at_end[k] + prior[k])) for k, c in enumerate(s_names[:-1])]
    peak = F.greatest(*joint) if many > 1 else joint[0]
    score = (peak + F.log(sum((F.exp(j - peak) for j in joint[1:]), F.exp(joint[0] - peak)))) / math.log(10)
    alone = (F.col("alone") + F.lit(lattice.end)) / math.log(10)
    base_end = float(model.base(ends[None, :])[0])
    return one.select(
        F.col("id").alias(id_col), "held_out", "n_tokens", (F.col("n_known") + end_known).alias("n_known"),
        F.lit(int(sums.sum())).cast("long").alias("train_tokens"), (F.col("base") + base_end).alias("base_score"), (score if word_edges else alone).alias("score"), alone.alias("lattice_score"),
    )
