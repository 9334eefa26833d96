import math
import zlib

import numpy as np
import pytest

from geoskein.llm import quality


def test_scores_match_a_plain_sum(spark):
    w = np.random.default_rng(0).normal(size=2**quality.BITS + 1).astype(np.float32)
    texts = ["", None, "one", "a a b", "x!! y?? " * 500, "été | ça " * 9000]
    docs = spark.createDataFrame([(k, t, 0.5) for k, t in enumerate(texts)] + [(None, "a", 1.0), (0, "", 1.0)], "doc_id long, text string, score double")
    got = quality.scored(docs, w).toPandas()
    assert len(got) == len(texts) + 2 and got.doc_id.isna().sum() == 1
    for key, text in enumerate(texts):
        at = quality.ngrams(text or "")
        logit = sum(float(w[a]) for a in at) / max(1, len(at)) + float(w[-1])
        assert got[got.doc_id == key].score.iloc[0] == pytest.approx(1 / (1 + np.exp(-logit)), rel=1e-4)
        assert got[got.doc_id == key].held_out.iloc[0] == (zlib.crc32(str(key).encode()) % 5 == 0)
    assert (got.predicted == (got.score >= quality.CUT)).all()
    assert quality.scored(docs.limit(0), w).count() == 0


def test_no_labels_give_one_half(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, quality int")
    w = quality.fitted(docs, labels)
    assert quality.scored(docs, w).first().score == 0.5


def test_learns_junk(spark):
    rows = [(k, ("good words here " * 5, "good!! words## here " * 5)[k % 2]) for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1 - k % 2) for k in range(400)], "doc_id long, quality int")
    got = quality.scored(docs, quality.fitted(docs, labels)).toPandas()
    held = got[got.held_out]
    assert len(held) > 40 and (held.predicted == 1 - held.doc_id % 2).all()


def test_ftrl_equals_its_published_update():
    """One coordinate at a time, after McMahan et al. 2013, algorithm 1."""
    r = np.random.default_rng(3)
    alpha, beta, l1, l2 = 0.7, 0.3, 0.05, 0.2
    model = quality.Ftrl(12, alpha, beta, l1, l2)
    z, n = [0.0] * 12, [0.0] * 12

    def weight(i):
        if abs(z[i]) <= l1:
            return 0.0
        return -(z[i] - math.copysign(l1, z[i])) / ((beta + math.sqrt(n[i])) / alpha + l2)

    for _ in range(300):
        at = np.sort(r.choice(12, int(r.integers(1, 6)), replace=False))
        x, y = r.random(len(at)), int(r.integers(0, 2))
        w = [weight(i) for i in at]
        p = 1 / (1 + math.exp(-sum(a * b for a, b in zip(w, x))))
        for i, wi, xi in zip(at, w, x):
            g = (p - y) * xi
            s = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / alpha
            z[i] += g - s * wi
            n[i] += g * g
        model.learn(at, x, y)
    assert np.allclose(model.weights(), [weight(i) for i in range(12)], atol=1e-9) and (model.weights() != 0).sum() > 6
