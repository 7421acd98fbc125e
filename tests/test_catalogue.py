"""Every query against its SQL on the smallest tables; those without SQL must run and give rows."""

import duckdb
import pytest

from folioscope.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, SQL = catalogue.queries(), catalogue.oracle_sql()
EMPTY = {"terms_filter_page"}


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def rows(frame, columns):
    return sorted(tuple(str(v.item()) if hasattr(v, "item") else str(v) for v in r) for r in frame[columns].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, sf_dir, name):
    got = QUERIES[name](spark, sf_dir).toPandas()
    if name in SQL:
        want = duck.execute(SQL[name]).df()
        columns = sorted(got.columns)
        assert columns == sorted(want.columns)
        assert rows(got, columns) == rows(want, columns)
    else:
        assert len(got) > 0


def test_entry_names():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert "cooccurrence_topn" in e.queries()
