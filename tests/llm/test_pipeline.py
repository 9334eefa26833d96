import re

import corpus_pipeline as cp
from tests.llm.test_jaccard_join import brute
from geoskein.llm.common import materialise

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(120)
    odd = spark.createDataFrame([(9001, None, None, None, None), (9002, "", "en", "s", 0), (9003, "x y", None, "s", 3), (9003, "x y", None, "s", 3)], docs.schema)
    docs = materialise(docs.unionByName(odd), "test-docs")
    seen = {}
    for name, stage in cp.STAGES:
        before = docs
        docs = materialise(stage(spark, docs, sf), name)
        seen[name] = docs
        if name != "packing":
            assert docs.columns == COLUMNS
            assert not docs.select("doc_id").subtract(before.select("doc_id")).count()
    rows = [(r.doc_id, r.text) for r in seen["quality"].collect()]
    first = {}
    for key, text in sorted(rows, key=lambda r: r[0]):
        first.setdefault(re.sub(r"[ \t-\r]+", " ", text or ""), key)
    assert sorted(r.doc_id for r in seen["exact_dedup"].collect()) == sorted(first.values())
    rows = [(r.doc_id, r.text) for r in seen["exact_dedup"].collect()]
    kept = sorted(key for key, n, c in brute(rows, 5, 80, 100) if key == c or n == 0)
    assert sorted(r.doc_id for r in seen["near_dedup"].collect()) == kept
    packed = seen["packing"].toPandas()
    assert set(packed.doc_id) == set(kept) and packed.groupby("sequence_id").length.sum().max() <= 1024


def test_run(spark):
    assert cp.run(spark, "/root/testdata/sf0.001").count() > 50


def test_stages_leave_other_columns_alone(spark):
    sf = "/root/testdata/sf0.001"
    names = ["__id", "id", "ok", "a.b", "v", "row"]
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(30)
    more = materialise(docs.selectExpr("*", *[f"cast(doc_id AS string) AS `{n}`" for n in names]), "test-more")
    for _, stage in cp.STAGES[:-1]:
        got = stage(spark, more, sf)
        assert got.columns == COLUMNS + names
        assert all(r["a.b"] == r["__id"] == str(r.doc_id) for r in got.collect())
