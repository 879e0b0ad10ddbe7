"""Every query with SQL gives the same rows in DuckDB; the others give some."""

import math

import duckdb
import pytest

from noticeloom.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(data):
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return c


def _plain(value):
    if isinstance(value, float):
        return "" if math.isnan(value) else f"{value:.5f}"
    if hasattr(value, "isoformat"):
        return str(value).removesuffix("+00:00").removesuffix(" 00:00:00")
    return "" if value is None else f"{float(value):.5f}" if type(value).__name__ == "Decimal" else str(value)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, data, duck, name):
    found = registry.QUERIES[name](spark, data)
    if name not in registry.SQL:
        assert found.columns and found.count() > 0
        return
    want = duck.execute(registry.SQL[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(found.columns)
    assert sorted([_plain(v) for v in r] for r in found.select(*names).collect()) == sorted([_plain(v) for v in r] for r in want.fetchall())


def test_entry_works(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
