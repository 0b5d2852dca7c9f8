"""Every query with SQL gives what DuckDB gives on the smallest tables."""

import math
import os

import duckdb
import pytest

from tesserae.plans import catalog


def _value(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v + 0.0:.9g}"
    return str(v)


@pytest.fixture(scope="module")
def tables(sf):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM read_parquet('{sf}/{f}')")
    return con


@pytest.mark.parametrize("name", list(catalog.ORACLE))
def test_against_sql(spark, sf, tables, name):
    got = catalog.QUERIES[name](spark, sf)
    cur = tables.execute(catalog.ORACLE[name])
    names = [x[0] for x in cur.description]
    assert sorted(names) == sorted(got.columns)
    want = sorted(tuple(_value(r[names.index(c)]) for c in got.columns) for r in cur.fetchall())
    assert sorted(tuple(map(_value, r)) for r in got.collect()) == want


def test_without_llm(tmp_path):
    """A copy without the subpackage, its tests and the pipeline imports, registers the rest and runs it."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    shutil.copytree(root, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'spmv' in q and 'pipeline' not in q and not any(k.startswith('op') for k in q); assert set(e.oracle_sql()) <= set(q); from pyspark.sql import SparkSession; s = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').getOrCreate(); assert q['counts'](s, '/root/testdata/sf0.001').count() == 1"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", check=True)
