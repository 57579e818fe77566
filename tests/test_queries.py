import duckdb
import pytest

from cairn import queries as Q

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(data_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{data_dir}/{t}.parquet')")
    return con


def rows(records, columns):
    def plain(v):
        if isinstance(v, float):
            return round(v, 6)
        return v.isoformat() if hasattr(v, "isoformat") else v

    return sorted((tuple(plain(r[columns.index(c)]) for c in sorted(columns)) for r in records), key=repr)


@pytest.mark.parametrize("name", Q.QUERIES)
def test_query_agrees_with_its_sql(spark, duck, data_dir, name):
    df = Q.QUERIES[name](spark, data_dir)
    got = rows(map(tuple, df.collect()), df.columns)
    result = duck.execute(Q.ORACLES[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(df.columns)
    assert got == rows(result.fetchall(), columns)


def test_entry_and_registry(spark):
    import __spark_entry__ as E

    assert E.entry(spark).count() > 0
    assert set(Q.ORACLES) <= set(E.queries()) and set(E.oracle_sql()) <= set(E.queries())
