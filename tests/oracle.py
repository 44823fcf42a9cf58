"""Comparison of a query with its SQL in DuckDB."""

import os

import duckdb


def connection(sf_dir: str):
    c = duckdb.connect()
    for f in os.listdir(sf_dir):
        c.execute(f"create view {f.split('.')[0]} as select * from read_parquet('{sf_dir}/{f}')")
    return c


def plain(v):
    if isinstance(v, float):
        return None if v != v else v + 0.0
    if isinstance(v, (bytes, bytearray)):
        return bytes(v)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def rows_of(table) -> list:
    names = sorted(table.column_names)
    columns = [table.column(n).to_pylist() for n in names]
    return sorted((tuple(plain(v) for v in r) for r in zip(*columns, strict=True)), key=repr)


def same(df, con, sql: str) -> None:
    left, right = df.toArrow(), con.sql(sql).to_arrow_table()
    assert sorted(left.column_names) == sorted(right.column_names)
    a, b = rows_of(left), rows_of(right)
    assert len(a) == len(b)
    assert [x for x, y in zip(a, b, strict=True) if x != y] == []
