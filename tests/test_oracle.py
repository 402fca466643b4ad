"""Every registered query against its DuckDB oracle (the driver's gate), on
the smallest given scale so the suite stays quick."""

import duckdb
import pytest

import __spark_entry__ as E
from conftest import SF001
from tools.compare import SPARK_TO_DUCKDB, TABLES, digest

from vigil.plans.catalog import QUERIES
from vigil.plans.oracle import SQL

ORACLE = {k: v for k, v in SQL.items() if k in QUERIES}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{SF001}/{t}.parquet')")
    yield c
    c.close()


def test_every_query_registered_has_callable():
    assert len(QUERIES) >= 50
    missing = set(QUERIES) - set(ORACLE)
    assert not missing, missing
    assert len(ORACLE) >= 53


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, con, name):
    df = QUERIES[name](spark, SF001)
    cols, rows = df.columns, [tuple(r) for r in df.collect()]
    rel = con.sql(ORACLE[name])
    ocols, orows = rel.columns, rel.fetchall()
    assert sorted(cols) == sorted(ocols)
    stypes = {f.name: SPARK_TO_DUCKDB.get(f.dataType.simpleString()) for f in df.schema.fields}
    assert stypes == dict(zip(rel.columns, (str(t) for t in rel.types)))
    assert len(rows) == len(orows)
    assert digest(cols, rows)[0] == digest(ocols, orows)[0]


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns == ["check_name", "passive", "output", "status", "timestamp",
                          "notifications_muted", "notifications_muted_until"]
