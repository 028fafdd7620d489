"""Every registered query against its SQL on the small tables."""

import duckdb
import pytest

from rankforge.plans import registry

SF = "/root/testdata/sf0.01"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for n in TABLES:
        c.execute(f"CREATE VIEW {n} AS SELECT * FROM '{SF}/{n}.parquet'")
    return c


def rows(found):
    return sorted((tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, db, name):
    df = registry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    if name not in registry.oracle_sql():
        assert df.count() > 0
        return
    sql = registry.oracle_sql()[name]
    names = ", ".join(f'"{c}"' for c in cols)
    assert rows(df.select(*cols).collect()) == rows(db.execute(f"SELECT {names} FROM ({sql})").fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
