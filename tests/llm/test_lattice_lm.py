import math
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from geoskein.llm import lattice_lm as lm
from geoskein.llm.sp_viterbi import MARK, Vocabulary, vocabulary

PATH = public_tokenizers.path("piece_bpe_32k.model")


def tiny():
    pieces = ["<unk>", MARK, "a", "b", "ab", MARK + "a", "ba", *[f"<0x{b:02X}>" for b in range(256)]]
    return Vocabulary(pieces, [0, -1, -2, -3, -4, -5, -6, *[0] * 256], {b: 7 + b for b in range(256)}, {0})


def every(lattice, s):
    """Log probabilities of all segmentations with their pieces."""
    if not s:
        return [(0.0, [])]
    out = []
    for n in range(1, len(s) + 1):
        if s[:n] in lattice.pieces:
            k, lp = lattice.pieces[s[:n]]
            out += [(lp + rest, [k, *ids]) for rest, ids in every(lattice, s[n:])]
    if s[0] not in lattice.pieces:
        ids = [lattice.byte_ids[b] for b in s[0].encode()]
        out += [(sum(lattice.log[ids]) + rest, ids + more) for rest, more in every(lattice, s[1:])]
    return out


@pytest.mark.parametrize("word", ["", "a", "abab", "babba", "aéb", "xyz"])
def test_forward_and_expected_counts_equal_enumeration(word):
    lattice = lm.Lattice(tiny())
    assert np.exp(lattice.log[np.isfinite(lattice.log)]).sum() == pytest.approx(1)
    paths = every(lattice, MARK + word)
    total = math.log(sum(math.exp(lp) for lp, _ in paths))
    assert lattice.log_probability(word.encode()) == pytest.approx(total, rel=1e-12)
    want, got = np.zeros(len(lattice.log)), np.zeros(len(lattice.log))
    for lp, ids in paths:
        for k in ids:
            want[k] += math.exp(lp - total)
    lattice.expect(word.encode(), got)
    assert np.allclose(want, got, atol=1e-9)


def test_words_together_equal_words_alone():
    lattice = lm.Lattice(vocabulary(PATH))
    r = np.random.default_rng(2)
    words = ["".join(r.choice(list("abcdeé日 ß\x01"), int(r.integers(1, 30)))).encode() for _ in range(400)] + [b"", b"x" * 900, b"a\x00", b"\x00", "naïveté".encode(), "▁x".encode()]
    one, two = np.zeros(len(lattice.log)), np.zeros(len(lattice.log))
    for w in words:
        lattice.expect(w, one)
    got = lattice.log_probabilities(words, two)
    assert np.allclose(got, [lattice.log_probability(w) for w in words], rtol=1e-9) and np.allclose(one, two, atol=1e-6)


def base_scores(rows):
    toks = {i: [*(t or "").encode().lower().split(), None] for i, t, _ in rows}
    train = [i for i in toks if zlib.crc32(str(i).encode()) % 5 != 1]
    c = Counter(t for i in train for t in toks[i])
    n = sum(c.values())
    return {i: (len(ts), sum(c[t] > 0 for t in ts), n, sum(math.log10((c[t] + 0.5) / (n + 0.5 * (len(c) + 1))) for t in ts)) for i, ts in toks.items()}


def test_documents(spark):
    r = np.random.default_rng(0)
    words = ["the", "The", "lake", "stone", "été", "xqz", "river\x0b", "a\x1cb", " "]
    rows = [(k, " ".join(r.choice(words, int(r.integers(0, 60)))), "en" if k % 3 else None) for k in range(80)]
    rows += [(80, None, "fr"), (81, "", "fr"), (82, "new" + "x" * 3000 + " words", "fr")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    want = base_scores(rows)
    full = lm.scored(docs, PATH, hot_words=4).collect()
    assert len(full) == len(rows)
    for x in full:
        n, known, total, base = want[x.doc_id]
        assert (x.n_tokens, x.n_known, x.train_tokens) == (n, known, total)
        assert x.base_score == pytest.approx(base, rel=1e-9) and math.isfinite(x.score) and x.score < 0
        assert x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 5 == 1)
    again = {x.doc_id: x.score for x in lm.scored(docs, PATH).collect()}
    assert all(again[x.doc_id] == pytest.approx(x.score, rel=1e-9) for x in full)
    assert lm.scored(docs.limit(0), PATH).count() == 0
    # the lattice alone: all segmentations of all words and the end, by the pieces fitted here
    assert all(x.lattice_score < 0 and again[x.doc_id] != x.lattice_score for x in full)
    alone = {x.doc_id: (x.score, x.lattice_score) for x in lm.scored(docs, PATH, word_edges=False).collect()}
    train = Counter(t for i, t, _ in rows if zlib.crc32(str(i).encode()) % 5 != 1 for t in lm.tokens((t or "").encode()))
    ends = sum(zlib.crc32(str(i).encode()) % 5 != 1 for i, _, _ in rows)
    lattice = lm.Lattice(vocabulary(PATH))
    for _ in range(lm.STEPS):
        into = np.zeros(len(lattice.log))
        for w, n in train.items():
            lattice.expect(w, into, n)
        lattice = lm.Lattice(vocabulary(PATH), into, ends)
    assert np.exp(lattice.log[np.isfinite(lattice.log)]).sum() + math.exp(lattice.end) == pytest.approx(1)
    for i, t, _ in rows:
        mine = (sum(lattice.log_probability(w) for w in lm.tokens((t or "").encode())) + lattice.end) / math.log(10)
        assert alone[i][0] == alone[i][1] == pytest.approx(mine, rel=1e-7)
    twice = docs.union(docs.filter("doc_id = 3")).drop("lang")
    assert lm.scored(twice, PATH).filter("doc_id = 3").count() == 2


def test_words_of_a_class_sum_to_one_at_most():
    lattice = lm.Lattice(vocabulary(PATH))
    m = lm.Model(lattice, np.array([60, 40]), np.array([10, 5]), 4, 2)
    seen = m.seen(np.array([[30, 5], [20, 30], [10, 5]]))
    assert np.allclose(seen.sum(axis=0) + m.unseen, 1)


def test_long_unseen_words_keep_their_log_probability():
    lattice = lm.Lattice(vocabulary(PATH))
    m = lm.Model(lattice, np.array([60, 40]), np.array([10, 5]), 4, 2)
    words = [b"q" * 40, b"/x7Kq" * 100, "日本ßé".encode() * 200, b"new" + b"x" * 3000]
    got = m.word_logs(words, np.zeros((len(words), 2), np.int64))
    for w, logs in zip(words, got):
        alone = lattice.log_probability(w)
        assert logs[:-1] == pytest.approx(math.log(m.unseen) + alone, rel=1e-9) and logs[-1] == pytest.approx(alone, rel=1e-9)
    assert got[-1].max() < -1000
    # seen words as before
    counts = np.array([[30, 5]])
    assert m.word_logs([b"the"], counts)[:, :-1] == pytest.approx(np.log(m.seen(counts) + m.unseen * math.exp(lattice.log_probability(b"the"))))


def test_score_of_a_document_with_a_long_unseen_word(spark):
    word = "new" + "x" * 3000
    # only held-out rows hold the words
    held = [k for k in range(100, 200) if zlib.crc32(str(k).encode()) % 5 == 1][:2]
    docs = spark.createDataFrame([(k, "the lake", "en") for k in range(20)] + [(held[0], word, "en"), (held[1], word + "x" * 500, "en")], "doc_id long, text string, lang string")
    one, two = (lm.scored(docs, PATH).filter(f"doc_id = {k}").first().score for k in held)
    assert two < one - 100


def test_ties_of_languages_and_no_languages(spark):
    docs = spark.createDataFrame([(k, f"word{k % 7} tree lake", f"l{k % 8}") for k in range(64)], "doc_id long, text string, lang string")
    one, two = (sorted((r.doc_id, r.score) for r in lm.scored(d, PATH).collect()) for d in (docs, docs.orderBy(docs.doc_id.desc())))
    assert [k for k, _ in one] == [k for k, _ in two] and [s for _, s in one] == pytest.approx([s for _, s in two], rel=1e-9)
    plain = {r.doc_id: r for r in lm.scored(docs.drop("lang"), PATH).collect()}
    assert len(plain) == 64 and all(math.isfinite(r.score) and r.score < 0 for r in plain.values())
