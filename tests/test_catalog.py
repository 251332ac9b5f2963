"""Every registered query against its DuckDB oracle, and that none is empty by accident."""

import duckdb
import pytest

from factloom.plans import catalog, registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(tuple(repr(r[k]) for k in order) for r in rows)


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_oracle(spark, duck, sf, name):
    df = catalog.QUERIES[name](spark, sf)
    rows = [tuple(r) for r in df.collect()]
    wanted = duck.execute(catalog.ORACLES[name])
    columns = [c[0] for c in wanted.description]
    assert sorted(df.columns) == sorted(columns)
    assert canonical(rows, df.columns) == canonical(wanted.fetchall(), columns)
    assert rows


def test_entry_and_registries(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(registry.ORACLES) <= set(entry.oracle_sql()) <= set(entry.queries())


def test_reflection_bundle(spark, sf):
    rows = catalog.reflection_bundle(spark, sf).orderBy("place").collect()
    assert rows and [r.place for r in rows] == list(range(1, len(rows) + 1)) and rows[-1].used <= 40_000
