"""Every query of the catalogue against its SQL: names, types and rows."""

import decimal

import pytest

from assaymill.plans import catalogue

KINDS = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean"}


def plain(v):
    if v is None or v != v:
        return None
    if isinstance(v, (int, float, decimal.Decimal)) and not isinstance(v, bool):
        return float(v)
    return v


def rows(values):
    return sorted(repr(tuple(map(plain, r))) for r in values)


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_query(spark, duck, name):
    found = catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")
    names = sorted(found.columns)
    got = [tuple(r[c] for c in names) for r in found.collect()]
    assert got
    if name not in catalogue.SQL:
        return
    with duck("sf0.001") as c:
        out = c.sql(catalogue.SQL[name])
        assert sorted(out.columns) == names
        kinds = {n: KINDS[str(t)] for n, t in zip(out.columns, out.types)}
        assert kinds == dict(found.dtypes)
        at = [out.columns.index(n) for n in names]
        expected = [tuple(r[k] for k in at) for r in out.fetchall()]
    assert rows(got) == rows(expected)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
