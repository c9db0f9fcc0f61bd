"""Every catalog query against its SQL on the smallest tables."""

import duckdb
import pytest

from lodestrand import catalog

from .conftest import SF

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def rows(frame):
    show = lambda v: "" if v is None or v != v else repr(round(v, 9)) if isinstance(v, float) else str(v)
    return sorted(tuple(map(show, r)) for r in frame[sorted(frame.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_equals_sql(spark, con, name):
    ours, theirs = catalog.QUERIES[name](spark, SF).toPandas(), con.sql(catalog.ORACLE_SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)
