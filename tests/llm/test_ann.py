import numpy as np
import pytest
from pyspark.sql import functions as F

from geoskein.llm import ann, queries


def brute(ids, x, top, step):
    out = {}
    for k in np.flatnonzero(ids % step == 0):
        s = x @ x[k]
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != ids[k]][:top]
        out[ids[k]] = [(ids[j], s[j]) for j in order]
    return out


def test_recall_and_scores(spark):
    got = queries.QUERIES["op1_ivf_pq_search"](spark, "/root/testdata/sf0.1").toPandas()
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").toPandas()
    ids, x = rows.vec_id.to_numpy(), np.array(rows.embedding.tolist(), np.float64)
    want = brute(ids, x, 20, 20)
    at = {i: k for k, i in enumerate(ids)}
    hits = 0
    for q, g in got.sort_values("rank").groupby("query_id"):
        assert g["rank"].tolist() == list(range(1, 21))
        assert np.allclose(g.score, x[[at[v] for v in g.vec_id]] @ x[at[q]], rtol=1e-12)
        hits += len(set(g.vec_id) & {i for i, _ in want[q]})
    assert set(got.query_id) == set(want) and hits / (20 * len(want)) >= 0.9


def test_copies_and_odd_vectors(spark):
    r = np.random.default_rng(0)
    x = r.normal(size=(300, 6))
    x[100:250] = x[0]
    rows = [(k, [float(c) for c in v]) for k, v in enumerate(x)]
    rows += [(900, None), (901, [0.0] * 6), (902, [float("nan")] * 6), (903, [None] * 6), (904, [1.0]), (None, [1.0] * 6), (5, [float(c) for c in x[5]])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("x"))
    old = ann.BLOCK_ROWS, ann.PROBE_SHARE
    ann.BLOCK_ROWS, ann.PROBE_SHARE = 40, 1.0
    try:
        got = ann.search(df, lambda i: i % 20 == 0, top=7).toPandas()
    finally:
        ann.BLOCK_ROWS, ann.PROBE_SHARE = old
    ids = np.append(np.arange(300), 5)
    full = np.vstack([x, x[5]])
    want = brute(ids, full, 7, 20)
    assert set(got.query_id) == set(want)
    for q, g in got.sort_values("rank").groupby("query_id"):
        assert g.score.tolist() == pytest.approx([s for _, s in want[q]], abs=1e-9)
        if q in (0, 100, 120):
            assert g.vec_id.tolist() == [i for i, _ in want[q]]
    assert ann.search(df.limit(0), lambda i: i % 20 == 0).count() == 0


def odd_vectors():
    """Vectors of very unlike lengths: a few long ones in all directions, filed in lists of short ones, and a cloud far off."""
    r = np.random.default_rng(7)
    x = r.normal(size=(4000, 24)) * np.exp(2.5 * r.standard_t(3, size=(4000, 1)).clip(-3, 3))
    x[:400] = r.normal(size=24) * 5 + 0.01 * r.normal(size=(400, 24))
    return x


def test_no_nearer_vector_is_missed(spark, monkeypatch):
    x = odd_vectors()
    ids = np.arange(len(x))
    monkeypatch.setattr(ann, "BLOCK_ROWS", 1500)
    monkeypatch.setattr(ann, "SHORTLIST", 2)
    monkeypatch.setattr(ann, "PROBE_SHARE", 0.1)
    df = spark.createDataFrame([(k, [float(c) for c in v]) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = ann.search(df, lambda i: i % 20 == 0).toPandas()
    want = brute(ids, x, 20, 20)
    assert set(got.query_id) == set(want)
    for q, g in got.sort_values("rank").groupby("query_id"):
        assert set(g.vec_id) == {i for i, _ in want[q]}


def test_an_id_with_many_rows_is_never_its_own_answer(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=(60, 5))
    rows = [(k, [float(c) for c in v]) for k, v in enumerate(x)] + [(20, [float(c) for c in 9 * x[20] + v]) for v in r.normal(size=(30, 5))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.search(df, lambda i: i % 20 == 0, top=7)
    assert {(q.query_id, q["count"]) for q in got.groupBy("query_id").count().collect()} == {(0, 7), (20, 7), (40, 7)}
    assert got.filter("query_id = vec_id").count() == 0
