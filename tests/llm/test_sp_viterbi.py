import random

import public_tokenizers
import sentencepiece
from sentencepiece import sentencepiece_model_pb2 as pb

from geoskein.llm import sp_viterbi as sp

PATH = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = ["", " ", "  ", "a", " lead", "tail ", "a  b   c", "line\nbreak\n\n", "\r\n tab\tx", "été — ça", "日本𐍈 語", "▁x ▁", "word " * 5000, "x" * 3000, "<s> </s> <0x41>", "é"]


def as_unigram() -> sentencepiece.SentencePieceProcessor:
    m = pb.ModelProto()
    m.ParseFromString(open(PATH, "rb").read())
    m.trainer_spec.model_type = 1
    return sentencepiece.SentencePieceProcessor(model_proto=m.SerializeToString())


def plain(v: sp.Vocabulary, text: str) -> list[int]:
    """Viterbi over the whole text, every start tried for every end."""
    if not text:
        return []
    s = sp.MARK + text.replace(" ", sp.MARK)
    best, last = [0.0], [None]
    for end in range(1, len(s) + 1):
        options = [(best[a] + v.ids[s[a:end]][1], 1, -a, v.ids[s[a:end]][0]) for a in range(max(0, end - v.longest), end) if s[a:end] in v.ids]
        top = max([*options, (best[end - 1] + v.unknown, 0, -(end - 1), -1)])
        best.append(top[0])
        last.append((-top[2], top[3]))
    out, end = [], len(s)
    while end:
        a, k = last[end]
        out = ([v.bytes_at[b] for b in s[a:end].encode()] if k < 0 else [k]) + out
        end = a
    return out


def unpack(b: bytes) -> list[int]:
    return memoryview(b).cast("I").tolist()


def test_equals_plain_viterbi_and_round_trips():
    v = sp.Vocabulary.load(PATH)
    r = random.Random(3)
    texts = TEXTS + ["".join(r.choice("ab eé\n ▒日t") for _ in range(r.randrange(60))) for _ in range(200)]
    for text, packed in zip(texts, v.encode_batch(texts)):
        assert v.decode(packed) == text
        if sp.MARK not in text and len(text) < 4000:
            assert unpack(packed) == plain(v, text)


def test_equals_the_library_with_the_same_scores():
    v, own = sp.Vocabulary.load(PATH), as_unigram()
    texts = ["the quick brown fox", "Ertheation of thand onthanen", "l'été à la plage"]
    for text, packed in zip(texts, v.encode_batch(texts)):
        ids = own.encode(text)
        score = lambda x: sum(own.get_score(k) for k in x)
        assert score(unpack(packed)) >= score(ids) and own.decode(unpack(packed)) == text


def test_frames(spark):
    docs = spark.createDataFrame([(k, t, 1) for k, t in enumerate(TEXTS)] + [(None, None, 1), (0, "", 1)], "doc_id long, text string, ids int")
    enc = sp.encoded(docs, PATH)
    back = {r.doc_id: r.text for r in sp.decoded(enc, PATH).collect()}
    assert all(back[k] == t for k, t in enumerate(TEXTS)) and back[None] == ""
    got = sp.digests(docs, PATH).collect()
    assert len(got) == len(TEXTS) + 2 and all(r.round_trip for r in got)
    assert sp.digests(docs.limit(0), PATH).count() == 0
