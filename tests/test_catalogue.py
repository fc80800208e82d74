"""Every query with SQL against DuckDB; every query without at least runs."""

import os

import duckdb
import pytest

from strandweave.plans import catalogue, clustering, further, more, whole  # noqa: F401

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_sql(spark, sf, con, name):
    got = catalogue.QUERIES[name](spark, sf)
    cols = [f'"{c}"' for c in sorted(got.columns)]
    want = con.execute(f"select {', '.join(cols)} from ({catalogue.SQL[name]})").fetchall()
    rows = [tuple(r) for r in got.select(*sorted(got.columns)).collect()]
    assert sorted(rows, key=repr) == sorted(want, key=repr)


def test_all_have_sql():
    assert set(catalogue.QUERIES) == set(catalogue.SQL)


@pytest.mark.parametrize("name", sorted(clustering.QUERIES))
def test_kernel_queries_run(spark, sf, name):
    got = clustering.QUERIES[name](spark, sf)
    assert got.columns and (name == "domain_regions" or got.count() > 0)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_imports_without_the_training_data_operators(tmp_path):
    """The library and its entry work where the subpackage and the pipeline are deleted."""
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{root}/strandweave", f"{tmp_path}/strandweave", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; q = e.queries(); print(len(q), any(k.startswith('op') for k in q), 'pipeline' in q)"], cwd=tmp_path, capture_output=True, text=True)
    assert said.stdout.split()[1:] == ["False", "False"], said.stderr
