"""The queries that SQL can say, against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from tests.test_oracles import FOLDER, TABLES, plain
from verdigris.llm import queries


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no tables")
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    df = queries.QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    found = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    rel = con.execute(queries.ORACLES[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == columns
    assert found == sorted(tuple(plain(row[names.index(c)]) for c in columns) for row in rel.fetchall())
