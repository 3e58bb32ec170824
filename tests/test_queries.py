"""Every registered query against its SQL twin on the smallest tables."""

from collections import Counter

import pytest
from conftest import SMALL

from vistalog.plans import registry

QUERIES, ORACLE = registry.queries(), registry.oracle_sql()
TYPES = {"string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN"}


def plain(rows):
    return Counter(tuple(round(v, 9) if isinstance(v, float) else v for v in row) for row in rows)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SMALL)
    want = duck.sql(ORACLE[name])
    assert sorted(df.columns) == sorted(want.columns)
    kinds = dict(zip(want.columns, map(str, want.types), strict=True))
    assert {c: TYPES[t] for c, t in df.dtypes} == kinds
    at = [want.columns.index(c) for c in df.columns]
    assert plain(map(tuple, df.collect())) == plain(tuple(r[i] for i in at) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SMALL).columns
    QUERIES[name](spark, SMALL).collect()


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
