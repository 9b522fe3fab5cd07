"""Every registered query against its SQL on the small tables; rows and invariants for the others."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from hexlab.plans import registry
from hexlab.plans.fixtures import TABLES

ROOT = Path(__file__).resolve().parent.parent

def plain(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    try:
        return round(float(v), 5) + 0.0
    except (TypeError, ValueError):
        return str(v)


@pytest.fixture(scope="module")
def con(small):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{small}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_rows_are_those_of_the_sql(spark, small, con, name):
    got = registry.QUERIES[name](spark, small)
    want = con.sql(registry.ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    columns = ", ".join(f'"{c}"' for c in got.columns)
    rows = lambda rs: sorted((tuple(map(plain, r)) for r in rs), key=repr)
    assert rows(got.collect()) == rows(want.select(columns).fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_other_queries_have_rows(spark, small, name):
    rows = registry.QUERIES[name](spark, small).collect()
    assert rows
    if name == "l4_permutation_test":
        assert rows[0]["sims"] == 999


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 2
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_the_rest_works_without_the_text_operators(tmp_path):
    """A copy without that subpackage and its tests imports, and registers the queries of the library."""
    for name in ("hexlab", "__spark_entry__.py", "corpus_pipeline.py", "tests"):
        if (found := ROOT / name).is_dir():
            shutil.copytree(found, tmp_path / name, ignore=shutil.ignore_patterns("__pycache__", "llm"))
        elif found.exists():
            shutil.copy(found, tmp_path / name)
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    said = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True)
    assert said.returncode == 0, said.stderr
    assert said.stdout.split() == [str(len(registry.QUERIES)), str(len(registry.ORACLE_SQL))]
