import pytest
from oracle import connection, same

from tidemark.llm import catalogue


@pytest.fixture(scope="module")
def con(data):
    return connection(data)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, data, con, name):
    df = catalogue.QUERIES[name](spark, data)
    if name in catalogue.ORACLE:
        same(df, con, catalogue.ORACLE[name])
    else:
        assert len(df.columns) == len(set(df.columns)) and df.count() >= 0
