"""Every query with an oracle text matches DuckDB on the sf0.001 tables."""
import duckdb
import pytest

from tests.oracle_compare import TABLES, digest

SF = "/root/testdata/sf0.001"


def _oracles():
    from __spark_entry__ import oracle_sql
    return sorted(oracle_sql())


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", _oracles())
def test_query_matches_duckdb(spark, con, name):
    from __spark_entry__ import oracle_sql, queries
    df = queries()[name](spark, SF)
    srows = [tuple(r) for r in df.collect()]
    cur = con.execute(oracle_sql()[name])
    ocols = [d[0] for d in cur.description]
    orows = cur.fetchall()
    assert sorted(df.columns) == sorted(ocols)
    assert len(srows) == len(orows)
    assert digest(df.columns, srows)[0] == digest(ocols, orows)[0]


def test_entry_smoke(spark):
    from __spark_entry__ import entry
    rows = entry(spark).collect()
    assert len(rows) > 0
