import hashlib
import re

import pytest
from pyspark.sql import functions as F

from geoskein.llm import exact_dedup as ed


def plain(rows):
    """(id, keep_id, group_size, kept, sha) of every (id, text), by loops."""
    norm = [re.sub(r"[ \t-\r]+", " ", t or "") for _, t in rows]
    groups, out, done = {}, [], set()
    for (key, _), t in zip(rows, norm):
        groups.setdefault(t, []).append(key)
    for (key, _), t in zip(rows, norm):
        least = min((k for k in groups[t] if k is not None), default=None)
        out.append((key, least, len(groups[t]), key == least and (key, t) not in done, hashlib.sha256(t.encode()).hexdigest()))
        if key == least:
            done.add((key, t))
    return sorted(out, key=str)


ROWS = [
    (5, "a  b"), (3, "a\tb"), (9, "a \r\n b"), (4, " a b"), (7, None), (8, ""), (1, " "), (2, "\n\n"), (6, "É"), (10, "é"), (11, "a\xa0b"), (12, "a\x1cb"), (13, "x" * 200_000), (14, "x" * 200_000),
    (None, "null id"), (None, "null id"), (20, "a b"), (20, "a b"), (3, "a b"), (21, "same id, other text"), (21, "a b"), (None, "a b"), (30, "word " * 50_000), (31, "word\n" * 50_000),
]


@pytest.mark.parametrize("hot_rows", [1000, 3])
def test_equals_loops(spark, hot_rows):
    docs = spark.createDataFrame([(k, t, 1, "x") for k, t in ROWS], "doc_id long, text string, salt int, digest string")
    got = ed.exact_groups(docs, hot_rows=hot_rows).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got), key=str) == plain(ROWS)


def test_hot_text_among_others(spark):
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 1, F.lit("hot  text")).when(F.col("id") % 3 == 2, F.concat(F.lit("pair "), (F.col("id") / 6).cast("int").cast("string"))).otherwise(F.col("id").cast("string")).alias("text"))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert ed._hot_digests(ed._digested(docs, "doc_id", "text").select("id", "digest"), 1000) == [hashlib.sha256(b"hot text").hexdigest()]
    got = ed.exact_groups(docs).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got), key=str) == plain(rows)
    assert ed.deduplicate(docs).count() == sum(r[3] for r in plain(rows))


@pytest.mark.parametrize("hot_rows", [1000, 3])
def test_deduplicate_keeps_all_columns_of_any_name(spark, hot_rows):
    rows = [(k, t, n % 4, {"k": n}, [{"a": n}], None) for n, (k, t) in enumerate(ROWS)]
    names = ["doc_id", "text", "a.b", "row", "__keep", "copies"]
    docs = spark.createDataFrame(rows, "doc_id long, text string, c int, m map<string,int>, l array<map<string,int>>, z string").toDF(*names)
    got = ed.deduplicate(docs, hot_rows=hot_rows)
    assert got.columns == names and got.dtypes == docs.dtypes
    assert sorted(((r[0], hashlib.sha256(re.sub(r"[ \t-\r]+", " ", r[1] or "").encode()).hexdigest()) for r in got.collect()), key=str) == sorted(((r[0], r[4]) for r in plain(ROWS) if r[3]), key=str)


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert ed.exact_groups(none).count() == 0 and ed.deduplicate(none).count() == 0


def test_normalised_like_the_pattern(spark):
    texts = ["", " ", "a", " a", "a ", "\t", "a\tb", "a\x0bb\x0cc\rd\ne", "a \t b", "  \n\n", "a\x85b", "a b", "x\r\n\r\ny"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(ed.normalised(F.col("t")).alias("n")).collect()
    assert [r.n for r in got] == [re.sub(r"[ \t-\r]+", " ", t) for t in texts]
