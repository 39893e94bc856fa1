"""Every registered query against its SQL check on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from sitebrief.session import TABLE_SCHEMAS
from tools.check import rows

QUERIES, ORACLES = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLE_SCHEMAS:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def test_every_check_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, duck, sf_dir):
    df = QUERIES[name](spark, sf_dir)
    got = df.collect()
    if name in ORACLES:
        cur = duck.execute(ORACLES[name])
        assert rows(df.columns, got) == rows([d[0] for d in cur.description], cur.fetchall())


def test_entry(spark):
    assert entry.entry(spark).columns == ["site", "pages", "typed_pages", "copies", "links"]
