"""Every registered query at the smallest scale, against its SQL in DuckDB where it has one."""

import decimal
import math

import duckdb
import pytest

import __spark_entry__ as contract

SF = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return con


def plain(value):
    if value is None or isinstance(value, bool):
        return str(value)
    if isinstance(value, (int, float, decimal.Decimal)):
        number = float(value)
        return "nan" if math.isnan(number) else f"{number + 0.0:.9g}"
    return str(value)


@pytest.mark.parametrize("name", sorted(contract.queries()))
def test_query(spark, duck, name):
    frame = contract.queries()[name](spark, SF)
    order = sorted(frame.columns)
    got = sorted(tuple(plain(row[c]) for c in order) for row in frame.collect())
    check = contract.oracle_sql().get(name)
    if check is None:
        assert got
        return
    cursor = duck.execute(check)
    names = [c[0] for c in cursor.description]
    assert sorted(names) == order
    expected = sorted(tuple(plain(row[names.index(c)]) for c in order) for row in cursor.fetchall())
    assert got == expected


def test_entry(spark):
    assert contract.entry(spark).count() > 0
