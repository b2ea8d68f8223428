"""Every registered query of the library against its SQL, and the entry point without its optional parts."""

from __future__ import annotations

import os
import subprocess
import sys

import duckdb
import pytest

from caseloom.plans import catalog

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(FOLDER):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{FOLDER}/{f}'")
    return con


def plain(x):
    if x is None or x != x:
        return None
    if isinstance(x, bool):
        return x
    if isinstance(x, (int, float)) or hasattr(x, "as_integer_ratio"):
        return round(float(x), 6)
    return str(x)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_agrees_with_its_sql(spark, duck, name):
    got = catalog.queries()[name](spark, FOLDER)
    want = duck.sql(catalog.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got.columns, got.collect()) == rows_of(want.columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_query_without_sql_has_rows(spark, name):
    assert catalog.queries()[name](spark, FOLDER).count() > 0


def test_every_sql_has_a_query():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())


def test_the_entry_point_works_without_the_optional_package(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for name in os.listdir(root):
        if name not in ("corpus_pipeline.py", "caseloom", ".git"):
            os.symlink(f"{root}/{name}", tmp_path / name)
    os.mkdir(tmp_path / "caseloom")
    for name in os.listdir(f"{root}/caseloom"):
        if name != "llm":
            os.symlink(f"{root}/caseloom/{name}", tmp_path / "caseloom" / name)
    code = "import __spark_entry__ as e; assert len(e.queries()) > 150 and not any(k.startswith('op1') for k in e.queries()); print('fine')"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert out.stdout.strip() == "fine", out.stderr[-2000:]
