import tracemalloc

import numpy as np

from geoskein.llm import toxicity as tox
from geoskein.llm.common import trimmed


def small():
    words = [b"alpha", b"beta.", b"", "réeux".encode(), b"gamma"]
    vocab = {b"alpha": 1, b"beta": 2}
    p = {k: v.astype(np.float64) for k, v in tox.initial(3).items()}
    return vocab, words, p


def test_gradients_match_differences():
    vocab, words, p = small()
    known = tox.features(vocab, words)
    r = np.random.default_rng(0)
    at, mask = r.integers(0, len(words), (6, 4)), np.ones((6, 4))
    mask[4:, 1] = 0
    mask[1:, 2] = 0
    y, weight = np.array([1, 0, 1, 0]), np.array([1.0, 2.0, 1.0, 1.0])
    _, g = tox.gradients(p, known, at, mask, y, weight)
    for name in p:
        flat = p[name].reshape(-1)
        for k in np.argsort(-np.abs(g[name].reshape(-1)))[:4]:
            old, eps = flat[k], 1e-5
            flat[k] = old + eps
            up = tox.gradients(p, known, at, mask, y, weight)[0]
            flat[k] = old - eps
            down = tox.gradients(p, known, at, mask, y, weight)[0]
            flat[k] = old
            assert abs((up - down) / (2 * eps) - g[name].reshape(-1)[k]) < 1e-4, name


def test_windows_cover_every_word():
    lengths = np.array([0, 1, 31, 32, 33, 48, 49, 500])
    doc, first, size = tox.windows(lengths)
    base = np.cumsum(lengths) - lengths
    for d, n in enumerate(lengths):
        own = doc == d
        seen = {w for a, s in zip(first[own] - base[d], size[own]) for w in range(a, a + s)}
        assert seen == set(range(n)) and (size[own] <= tox.WINDOW).all()


def test_long_text_in_runs_scores_as_whole():
    vocab, _, p = small()
    scorer = tox.Scorer(p | {"vocab": vocab})
    r = np.random.default_rng(2)
    text = b" ".join(r.choice(np.array([b"alpha", b"beta", b"nu", b"xi"]), 5000).tolist())
    whole = scorer.logits([text, b"", b"alpha"])
    old, tox.CHUNK_WORDS = tox.CHUNK_WORDS, 640
    try:
        cut = tox.Scorer(p | {"vocab": vocab}).logits([text, b"", b"alpha"])
    finally:
        tox.CHUNK_WORDS = old
    assert np.allclose(whole, cut, atol=1e-5) and np.isfinite(whole).all()


def test_scores(spark):
    r = np.random.default_rng(4)
    bland = ["tree", "lake", "stone", "river", "cloud", "grass"]
    rows = []
    for k in range(500):
        words = r.choice(bland, int(r.integers(1, 120))).tolist()
        if k % 4 == 0:
            words.insert(int(r.integers(0, len(words) + 1)), ["scum", "moron"][k % 8 // 4])
        rows.append((k, " ".join(words), "x"))
    extra = [(1000, None, "x"), (1001, "", "x"), (None, "moron", "x"), (None, "moron", "x")]
    docs = spark.createDataFrame(rows + extra, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(500)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    got = tox.scored(docs, tox.fitted(docs, labels)).toPandas()
    assert len(got) == 504 and got.score.between(0, 1).all()
    held = got[got.held_out & (got.doc_id < 500)]
    assert ((held.doc_id % 4 == 0) == held.predicted).mean() > 0.95
    assert tox.scored(docs.limit(0), None).count() == 0
    assert (tox.scored(docs, tox.fitted(docs, labels.limit(0))).toPandas().score == 0).all()


def test_forward_equals_plain_loops():
    """The recurrent cells, attention and pooling of each window, one number at a time."""
    vocab, words, p = small()
    known = tox.features(vocab, words)
    gates = tox.projected(p, tox.embedded(p, *known))
    r = np.random.default_rng(6)
    at = r.integers(0, len(words), (7, 3))
    sizes = [7, 4, 1]
    mask = (np.arange(7)[:, None] < np.array(sizes)).astype(float)
    got = tox.forward(p, gates, at, mask)
    h, sig = tox.HIDDEN, lambda v: 1 / (1 + np.exp(-v))
    rows, grams, starts = known
    ends = np.append(starts, len(grams) - 1)
    for w, n in enumerate(sizes):
        inputs = []
        for t in range(n):
            k = at[t, w]
            own = [p["char"][g] for g in grams[ends[k] : ends[k + 1]]]
            inputs.append(np.concatenate([p["word"][rows[k]], sum(own) / np.sqrt(len(own))]))
        states = np.zeros((n, 2 * h))
        for side, order in (("f", range(n)), ("b", range(n - 1, -1, -1))):
            s = np.zeros(h)
            for t in order:
                new = np.zeros(h)
                for j in range(h):
                    gx = [sum(inputs[t][i] * p[f"wx{side}"][i, j + q * h] for i in range(len(inputs[t]))) + p[f"bx{side}"][j + q * h] for q in range(3)]
                    gh = [sum(s[i] * p[f"wh{side}"][i, j + q * h] for i in range(h)) for q in range(3)]
                    reset, update = sig(gx[0] + gh[0]), sig(gx[1] + gh[1])
                    new[j] = update * s[j] + (1 - update) * np.tanh(gx[2] + reset * gh[2])
                s = new
                states[t, slice(0, h) if side == "f" else slice(h, 2 * h)] = s
        weight = np.exp([sum(a * b for a, b in zip(states[t], p["att"])) for t in range(n)])
        pooled = sum(weight[t] * states[t] for t in range(n)) / weight.sum()
        assert abs(got[w] - (sum(a * b for a, b in zip(pooled, p["out"])) + p["bias"][0])) < 1e-7


def test_repeated_ids_and_long_texts_are_trained_on(spark):
    rows = [(k, ("scum " if k % 3 == 0 else "lake ") + "tree " * (k % 40)) for k in range(900)] + [(1, "lake again"), (3, "scum " + "stone " * 30_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(900)], "doc_id long, toxic int")
    model = tox.fitted(docs, labels)
    assert set(model["vocab"]) >= {b"scum", b"lake", b"tree"}
    got = tox.scored(docs, model).toPandas()
    assert ((got.doc_id % 3 == 0) == got.predicted).mean() > 0.95


def traced(run) -> float:
    """MB that are held at most at once while it runs, besides what there was."""
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_many_distinct_words_take_little_memory():
    """Gates and n-grams of all distinct words at once were most of an executor's memory."""
    corpus, r = tox.Corpus(), np.random.default_rng(8)
    texts = [b" ".join(b"w%x" % k for k in r.integers(0, 1 << 40, 500)) for _ in range(120)]
    for k, text in enumerate(texts):
        corpus.add((k, k), text, k % 2)
    assert traced(lambda: tox.fit(corpus, passes=3)) < 50
    scorer = tox.Scorer(tox.initial(1) | {"vocab": {}})
    assert traced(lambda: scorer.logits(texts)) < 40


def test_trimmed_workers_hand_on_every_batch():
    assert list(trimmed(lambda batches: (2 * b for b in batches))(iter([1, 2, 3]))) == [2, 4, 6]
