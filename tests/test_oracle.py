"""Every registered query against its DuckDB oracle at sf0.01 (the round's correctness gate)."""

import re

import duckdb
import pytest

import __spark_entry__ as E
from tests.conftest import SF01
from tools.oracle_check import TABLES, rows_of

ORACLE = E.oracle_sql()
QUERIES = E.queries()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF01}/{t}.parquet')")
    return c


def test_every_query_has_an_oracle_or_is_listed():
    missing = {q for q in set(QUERIES) - set(ORACLE) if q != "pipeline" and not re.match(r"op\d+_", q)}
    assert not missing, missing


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_oracle(spark, con, name):
    got = QUERIES[name](spark, SF01).toPandas()
    want = con.execute(ORACLE[name]).fetchdf()
    c1, r1 = rows_of(got)
    c2, r2 = rows_of(want)
    assert c1 == c2
    assert len(r1) == len(r2)
    assert r1 == r2
