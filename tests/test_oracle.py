"""Every query against its SQL. ``TEST_SF`` names the scale, 0.001 by default."""

import os
from collections import Counter
from pathlib import Path

import duckdb
import pytest

from queries.oracle import ORACLE_SQL
from queries.registry import QUERIES

DATA = Path(f"/root/testdata/sf{os.environ.get('TEST_SF', '0.001')}")
TYPES = {
    "string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN",
    "timestamp_ntz": "TIMESTAMP", "date": "DATE", "decimal(38,0)": "DECIMAL(38,0)",
}


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for path in DATA.glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(ORACLE_SQL)


@pytest.mark.skipif(not DATA.exists(), reason="no test data")
@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, str(DATA))
    relation = duck.sql(ORACLE_SQL[name])
    assert {c: TYPES[t] for c, t in df.dtypes} == dict(zip(relation.columns, map(str, relation.types)))
    columns = sorted(df.columns)
    expected = Counter(relation.project(", ".join(f'"{c}"' for c in columns)).fetchall())
    actual = Counter(tuple(row) for row in df.select(columns).collect())
    assert actual == expected
