"""Every registered query of the engine against its SQL at sf0.001."""

import duckdb
import pytest

from tidemark import catalog

SF = "/root/testdata/sf0.001"
ORACLES = catalog.oracle_sql()


def duck(sf):
    con = duckdb.connect()
    for t in ("events", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def compare(spark, name, sf=SF):
    """Fails unless a query has the rows that its SQL has."""
    have = catalog.queries()[name](spark, sf).toArrow()
    want = duck(sf).sql(ORACLES[name]).df()
    columns = sorted(have.column_names)
    assert columns == sorted(want.columns)
    got = have.select(columns).to_pandas()
    clean = lambda df: sorted(repr([None if v != v or v is None else v for v in r]) for r in df[columns].astype(object).where(df[columns].notna(), None).values.tolist())
    number = lambda text: text.replace(".0,", ",").replace(".0]", "]")  # noqa: E731  nullable integers are floats in pandas
    assert [number(x) for x in clean(got)] == [number(x) for x in clean(want)]


def test_every_query_has_sql():
    assert set(catalog.queries()) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, name):
    compare(spark, name)
