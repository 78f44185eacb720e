"""Every library query against its DuckDB SQL."""

import math
from decimal import Decimal
from pathlib import Path

import duckdb
import pytest

from threadloom.plans.queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="the driver's tables are not here")
TABLES = ("events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for t in TABLES:
        connection.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return connection


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return None
    return float(value) if isinstance(value, Decimal) else value


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_matches_sql(spark, db, name):
    got = QUERIES[name](spark, DATA)
    names = sorted(got.columns)
    expected = db.sql(ORACLE_SQL[name])
    assert names == sorted(expected.columns)
    order = [expected.columns.index(n) for n in names]
    want = sorted(repr(tuple(plain(r[i]) for i in order)) for r in expected.fetchall())
    have = sorted(repr(tuple(plain(r[n]) for n in names)) for r in got.collect())
    assert have == want


def test_every_query_has_sql_but_these():
    assert set(QUERIES) - set(ORACLE_SQL) == {"q_mlp", "q_minibatch", "q_graph_losses", "q_graph_experiment", "q_ablations"}
