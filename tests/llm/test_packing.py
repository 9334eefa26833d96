import functools
import itertools
import zlib

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from geoskein.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = ["", "a", " lead", "tail ", "two  spaces", "a \n b\n\nc", "\t\tx", "it's 's <|endoftext|> here", "été — ça va", "a\x1cb \x1f c", "日本 語 " * 40, "word " * 3000, None, "x" * 9000]


@functools.cache
def library():
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return t


def plain_ids(text):
    return library().encode(text or "", add_special_tokens=False).ids + [packing.END]


@pytest.mark.parametrize("text", TEXTS)
def test_ids_are_those_of_the_whole_text(text):
    got = np.frombuffer(packing.tokens(PATH).packed_batch([text or ""])[0], np.uint32).tolist() + [packing.END]
    assert got == plain_ids(text)


def test_ids_of_real_texts():
    table = pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["text"])
    for text in table.column("text").to_pylist()[:120]:
        got = np.frombuffer(packing.tokens(PATH).packed_batch([text or ""])[0], np.uint32).tolist() + [packing.END]
        assert got == plain_ids(text)


def fewest(lengths, size):
    """Bins needed, by trying every assignment."""
    for k in itertools.count(1):
        def place(i, room):
            if i == len(lengths):
                return True
            return any(room[b] >= lengths[i] and place(i + 1, room[:b] + [room[b] - lengths[i]] + room[b + 1 :]) for b in range(k) if b == 0 or room[b] != room[b - 1])
        if place(0, [size] * k):
            return k


def test_bound_never_exceeds_the_optimum():
    rng = np.random.default_rng(5)
    for _ in range(150):
        size = int(rng.integers(4, 14))
        lengths = rng.integers(1, size + 1, int(rng.integers(1, 8)))
        assert packing.lower_bound(lengths, size) <= fewest(sorted(lengths.tolist(), reverse=True), size)


def test_best_fit_decreasing_fills_without_overlap():
    lengths = np.random.default_rng(1).integers(1, 1025, 3000)
    bins, offsets, room = packing.best_fit_decreasing(lengths)
    for b in range(len(room)):
        own = np.flatnonzero(bins == b)
        own = own[np.argsort(offsets[own])]
        assert offsets[own].tolist() == [0, *np.cumsum(lengths[own])[:-1].tolist()]
        assert lengths[own].sum() + room[b] == packing.SIZE
    assert len(room) <= packing.lower_bound(lengths) * 1.02 + 1


def test_packed_documents(spark):
    rows = [(k, t, "x") for k, t in enumerate(TEXTS)] + [(0, "", "x"), (0, "", "x"), (None, "null id", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item string")
    got = packing.packed_documents(docs, PATH, with_ids=True).toPandas()
    assert got.groupby("sequence_id").length.sum().max() <= packing.SIZE
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g.offset.tolist() == [0, *g.length.cumsum()[:-1].tolist()]
    for key, text in enumerate(TEXTS):
        own = got[got.doc_id == key].sort_values("piece")
        if key:
            assert own.piece.tolist() == list(range(len(own))) and np.concatenate(own.ids.tolist()).tolist() == plain_ids(text)
        assert all(zlib.crc32(np.array(i, "<u4").tobytes()) == c for i, c in zip(own.ids, own.ids_crc32))
    assert (got.doc_id == 0).sum() == 3 and got.doc_id.isna().sum() == 1
    assert packing.packed_documents(docs.limit(0), PATH).count() == 0


def test_exchange_between_groups_saves_bins(spark):
    items = spark.range(400).selectExpr("id AS item", "cast(300 + id % 500 AS long) AS length")
    alone = packing._packed(items, 10, 0, packing.SIZE).select("sequence_id").distinct().count()
    got = packing.pack(items, group_items=40).toPandas()
    bound = packing.lower_bound(np.array([300 + k % 500 for k in range(400)]))
    assert bound <= got.sequence_id.nunique() <= alone and len(got) == got.item.nunique() == 400
    # gaps certify: a partition without one can't be packed better
    assert (got.gap >= 0).all() and packing.pack(items).toPandas().gap.max() <= 1 + 0.01 * bound


SPECIAL = ["a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|>", "x<|endoftext|>y z", "  <|endoftext|>  ", "<|endoftext", "a  b\n<|endoftext|>\n\nété <|endoftext|>"]


@pytest.mark.parametrize("text", [*SPECIAL, *[t for t in TEXTS if t]])
def test_ids_are_those_of_the_library_at_its_defaults(text):
    want = Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids
    assert np.frombuffer(packing.tokens(PATH, False).packed_batch([text])[0], np.uint32).tolist() == want


def test_query_and_pipeline_cut_at_added_tokens(spark, tmp_path):
    import corpus_pipeline
    from geoskein.llm import queries

    docs = spark.createDataFrame(list(enumerate(SPECIAL)), "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    plain = Tokenizer.from_file(PATH)
    want = {k: zlib.crc32(np.array(plain.encode(t, add_special_tokens=False).ids + [packing.END], "<u4").tobytes()) for k, t in enumerate(SPECIAL)}
    for df in (queries.op5_best_fit_packing(spark, str(tmp_path)), corpus_pipeline.packing_stage(spark, docs, str(tmp_path))):
        assert {r.doc_id: r.ids_crc32 for r in df.collect()} == want
