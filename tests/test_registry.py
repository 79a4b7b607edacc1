"""Every registered query against its SQL oracle on the smallest tables."""

import os

import duckdb
import pytest

from storeflow.plans import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the given tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


def rows(table):
    def text(v):
        if isinstance(v, bool) or v is None:
            return str(v)
        if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
            return f"{float(v):.5f}"
        return str(v)

    names = sorted(table.column_names)
    return names, sorted(tuple(map(text, r)) for r in zip(*(table[n].to_pylist() for n in names), strict=True))


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    got = registry.queries()[name](spark, DATA).toArrow()
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert got.num_rows > 0
    else:
        assert rows(got) == rows(duck.sql(sql).to_arrow_table())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
