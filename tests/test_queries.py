"""Every query of the catalogue against its SQL in DuckDB."""

import duckdb
import pytest

from gneiss import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(rows):
    return sorted(tuple("null" if v is None else repr(round(v, 6)) if isinstance(v, float) else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(spark, db, name):
    df = catalogue.queries()[name](spark, SF)
    columns = sorted(df.columns)
    sql = catalogue.oracle_sql()[name]
    quoted = ", ".join(f'"{c}"' for c in columns)
    assert sorted(db.sql(sql).columns) == columns
    assert plain(df.select(*columns).collect()) == plain(db.sql(f"SELECT {quoted} FROM ({sql})").fetchall())


def test_entry_module():
    import __spark_entry__ as entry

    assert set(catalogue.queries()) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
