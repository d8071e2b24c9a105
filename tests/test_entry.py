from __future__ import annotations

import duckdb
import pytest

import __spark_entry__
from quarrymill import catalog

SMALL = "/root/testdata/sf0.001"


def test_every_oracle_has_a_query():
    queries = __spark_entry__.queries()
    assert set(__spark_entry__.oracle_sql()) <= set(queries)
    assert set(catalog.QUERIES) <= set(queries)


def test_entry(spark):
    found = __spark_entry__.entry(spark)
    assert found.columns == ["id", "path", "name", "addr"] and found.count() > 0


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "orders", "lineitem", "events", "documents", "pages", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    found = catalog.QUERIES[name](spark, SMALL)
    columns = sorted(found.columns)
    wanted = con.sql("SELECT " + ", ".join(f'"{c}"' for c in columns) + f" FROM ({catalog.ORACLES[name]})").fetchall()
    assert sorted(map(repr, map(tuple, found.select(*columns).collect()))) == sorted(map(repr, wanted))
