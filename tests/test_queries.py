"""Every core query against its SQL, and every query without SQL runs with a stable schema."""

import pytest
from oracle import connection, same

from tidemark.plans import audits, audits_sql, forecasting, forecasting_sql, streams, training_data

QUERIES = {**training_data.QUERIES, **forecasting.QUERIES, **audits.QUERIES, **streams.QUERIES}
ORACLE = {**training_data.ORACLE, **forecasting_sql.ORACLE, **audits_sql.ORACLE, **streams.ORACLE}


@pytest.fixture(scope="module")
def con(data):
    return connection(data)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, con, name):
    df = QUERIES[name](spark, data)
    if name in ORACLE:
        same(df, con, ORACLE[name])
    else:
        assert len(df.columns) == len(set(df.columns)) and df.count() >= 0


def test_every_sql_has_its_query():
    assert set(ORACLE) <= set(QUERIES)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 1
    assert set(e.oracle_sql()) <= set(e.queries())
