"""Every registered query of the engine against its SQL, on the smallest tables."""

import os

import pytest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


def shaped(df):
    df = df[sorted(df.columns)]
    cells = lambda row: tuple("NULL" if v is None else f"{v:.9g}" if isinstance(v, float) else str(v) for v in row)
    return sorted(cells(r) for r in df.astype(object).where(df.notna(), None).itertuples(index=False))


def names():
    from sedimenta.plans import registry

    return sorted(registry.queries())


@pytest.mark.parametrize("name", names())
def test_query(spark, name):
    import duckdb

    from sedimenta.plans import registry

    got = registry.queries()[name](spark, SF).toPandas()
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert len(got) >= 1
        return
    con = duckdb.connect()
    for t in os.listdir(SF):
        con.execute(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM '{SF}/{t}'")
    expected = con.execute(sql).df()
    assert sorted(got.columns) == sorted(expected.columns)
    assert shaped(got) == shaped(expected)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
