"""Every query with SQL equals it; no plan has a Cartesian product; the entry works without the optional subpackage's tables."""

import math
import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from leadlake.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

#: Queries whose joins without a key have a side of one row (an aggregate over all rows).
ONE_ROW = {"operations_snapshot", "agent_metrics", "resolve_companies"}


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return round(v, 6) if isinstance(v, float) else str(v)


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query_equals_sql(spark, sf, con, name):
    df = catalogue.queries()[name](spark, sf)
    plan = df._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan or name in ONE_ROW
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=str)
    r = con.sql(catalogue.oracle_sql()[name])
    assert sorted(r.columns) == cols
    at = [r.columns.index(c) for c in cols]
    assert got == sorted((tuple(plain(x[i]) for i in at) for x in r.fetchall()), key=str)


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql())))
def test_other_queries_run(spark, sf, name):
    assert catalogue.queries()[name](spark, sf).count() > 0


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and df.columns[:2] == ["page_id", "host"]


def test_entry_without_the_subpackage(tmp_path):
    """The library and the entry import when the optional folders are gone."""
    import shutil

    root = os.path.dirname(os.path.abspath(entry.__file__))
    shutil.copytree(f"{root}/leadlake", tmp_path / "leadlake", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 50 and not any(k.startswith('op') and k[2].isdigit() for k in q); assert 'pipeline' not in q"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={**os.environ, "PYTHONPATH": ""})


def test_scans_are_pruned(spark, sf):
    text = catalogue.queries()["session_evidence"](spark, sf)._jdf.queryExecution().toString()
    scan = [x for x in text.splitlines() if "ReadSchema" in x][-1]
    assert "l_comment" not in scan and "l_partkey" not in scan.split("ReadSchema")[1]
