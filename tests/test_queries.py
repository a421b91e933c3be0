"""Every query with SQL gives the rows of that SQL on the smallest tables."""

import math
import os

import duckdb
import pytest

from runsift.plans import queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plain(v):
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.10g}")
    return v


@pytest.fixture(scope="module")
def tables():
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    con = duckdb.connect()
    for file in os.listdir(SF):
        con.execute(f"create view {file.split('.')[0]} as select * from '{SF}/{file}'")
    return con


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query_equals_sql(spark, tables, name):
    got = queries.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    mine = sorted(repr([plain(r[c]) for c in columns]) for r in got.collect())
    assert name in queries.SQL
    res = tables.execute(queries.SQL[name])
    names = [d[0] for d in res.description]
    theirs = sorted(repr([plain(dict(zip(names, r))[c]) for c in columns]) for r in res.fetchall())
    assert sorted(names) == columns and mine == theirs


def test_library_works_without_the_llm_folder(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).parents[1]
    shutil.copytree(root / "runsift", tmp_path / "runsift", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, check=True).stdout.split()
    assert out == [str(len(queries.QUERIES)), str(len(queries.SQL))]


def test_queries_keep_every_row(spark, tmp_path):
    import hashlib

    texts = ["a\nb\nc\nd", "a\nb\nc\nd\n", "", "\n", "\n\n", "one", "one\n", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.last_md5, r.n) for r in queries.QUERIES["last_lines"](spark, str(tmp_path)).collect()}
    want = {i: (hashlib.md5("\n".join(t.splitlines()[-3:]).encode()).hexdigest(), len(t.splitlines())) for i, t in enumerate(texts) if t is not None}
    assert got == {**want, 7: (None, None)}
    spark.createDataFrame([(1, "http://x/a b/c.py"), (2, "http://x/d.py"), (3, None)], "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: r.files for r in queries.QUERIES["changed_files"](spark, str(tmp_path)).collect()}
    assert set(got) == {1, 2, 3} and got[1] == ["c.py", "old/1.py b/a"] and got[2] == ["d.py", "old/2.py"]
