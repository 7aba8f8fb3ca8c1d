"""Every query with SQL gives the same rows as DuckDB on the smallest tables."""

import os

import pytest

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

import __spark_entry__  # noqa: E402
from evidora.queries import ORACLES, QUERIES  # noqa: E402


def plain(rows):
    return sorted(tuple(repr(float(x)) if isinstance(x, float) or type(x).__name__ == "Decimal" else repr(x) for x in r) for r in rows)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    import duckdb

    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = [tuple(r) for r in df.select(*columns).collect()]
    if name not in ORACLES:
        assert rows
        return
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    names = ", ".join(f'"{c}"' for c in columns)
    assert plain(con.sql(f"SELECT {names} FROM ({ORACLES[name]})").fetchall()) == plain(rows)


def test_entry_lists_what_is_there():
    assert set(QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
