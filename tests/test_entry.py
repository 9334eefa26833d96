import os
import shutil
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
GEO = [n for n in entry.registry.QUERIES]


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", [n for n in GEO if n in entry.registry.ORACLE_SQL])
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(entry.oracle_sql()[name]).df()
    got = entry.queries()[name](spark, SF).toPandas()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns and len(got) == len(want)
    key = lambda df: sorted(tuple(round(v, 2) if isinstance(v, float) else str(v) for v in r) for r in df[columns].astype(object).where(df[columns].notna(), None).itertuples(index=False))
    assert [list(map(str, r)) for r in key(got.apply(lambda c: c.astype(float) if c.dtype.kind in "iuf" else c))] == [list(map(str, r)) for r in key(want.apply(lambda c: c.astype(float) if c.dtype.kind in "iuf" else c))]


def test_works_without_the_llm_folders(tmp_path):
    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for name in ("geoskein", "__spark_entry__.py"):
        source = os.path.join(here, name)
        (shutil.copytree if os.path.isdir(source) else shutil.copy)(source, tmp_path / name)
    shutil.rmtree(tmp_path / "geoskein" / "llm", ignore_errors=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 40 and not any(n.startswith('op') or n == 'pipeline' for n in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)
