from __future__ import annotations

import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__
from folioscope.plans import registry

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def plain(value):
    if value is None:
        return "None"
    if isinstance(value, bool | str):
        return str(value)
    return repr(float(value)) if isinstance(value, int | float) or hasattr(value, "as_tuple") else str(value)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_its_sql_twin(spark, db, name):
    got = registry.QUERIES[name](spark, FOLDER)
    want = db.sql(registry.ORACLES[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    assert sorted(tuple(plain(r[c]) for c in columns) for r in got.collect()) == sorted(tuple(plain(r[k]) for k in at) for r in want.fetchall())


def test_flagship(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_every_twin_has_a_query():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_release_chain_reads_all_orders(spark):
    plan = registry.QUERIES["release_chain"](spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
    assert "<= 40" not in plan


def test_entry_is_read_without_a_session():
    code = "import __spark_entry__ as e; e.queries(); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(os.path.abspath(__spark_entry__.__file__)))
