"""Every query against its SQL."""

import datetime

import pytest

from millrace import catalogue


def plain(v):
    if isinstance(v, float):
        return round(v, 6) + 0.0
    return v.replace(tzinfo=None) if isinstance(v, datetime.datetime) else v


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query(name, spark, sf_dir, duck):
    df = catalogue.queries()[name](spark, sf_dir)
    names = sorted(df.columns)
    rows = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)
    if name not in catalogue.oracle_sql():
        assert rows
        return
    found = duck.sql(catalogue.oracle_sql()[name])
    assert sorted(found.columns) == names
    at = [found.columns.index(c) for c in names]
    assert rows == sorted((tuple(plain(r[i]) for i in at) for r in found.fetchall()), key=repr)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 10
