"""Queries of the corpus operators against their SQL."""

from collections import Counter
from pathlib import Path

import duckdb
import pytest

from ledgerline.llm.queries import ORACLE_SQL, QUERIES

DATA = Path("/root/testdata/sf0.001")


@pytest.mark.parametrize("name", list(ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    duck = duckdb.connect()
    for path in DATA.glob("*.parquet"):
        duck.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    df = QUERIES[name](spark, str(DATA))
    relation = duck.sql(ORACLE_SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(relation.columns)
    expected = Counter(relation.project(", ".join(f'"{c}"' for c in columns)).fetchall())
    assert Counter(tuple(row) for row in df.select(columns).collect()) == expected
