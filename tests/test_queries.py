"""Every query of the graph engine against DuckDB on the driver's tables."""

import pytest

from skein.queries import ORACLE_SQL, QUERIES

KINDS = {"bigint": "BIGINT", "int": "INTEGER", "boolean": "BOOLEAN", "string": "VARCHAR", "double": "DOUBLE"}


def test_every_query_has_sql():
    assert set(ORACLE_SQL) == set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_equals_duckdb(spark, duck, sf, name):
    df = QUERIES[name](spark, sf)
    cols = sorted(df.columns)
    want = duck.sql(ORACLE_SQL[name])
    assert sorted(want.columns) == cols
    assert {c: KINDS[t] for c, t in df.dtypes} == dict(zip(want.columns, map(str, want.types), strict=True))
    assert sorted(map(tuple, df.select(*cols).collect()), key=repr) == sorted(want.select(*cols).fetchall(), key=repr)


def test_golden_sizes(spark, sf):
    assert QUERIES["triangles_list"](spark, sf).count() == 125_968
    assert QUERIES["edges_part"](spark, sf).count() == 8_899
    assert QUERIES["triangles_list_supp"](spark, sf).count() == 120
    assert QUERIES["triangles_list_nation"](spark, sf).count() == 795


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["a", "b", "c"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
