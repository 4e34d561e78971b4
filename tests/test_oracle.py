"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from tools.check_oracle import open_tables, rows_of


@pytest.fixture(scope="module")
def con(data):
    return open_tables(data)


@pytest.mark.parametrize("name", sorted(name for name in entry.oracle_sql() if not name.startswith(("op", "pipeline"))))
def test_query_equals_sql(spark, con, data, name):
    df = entry.queries()[name](spark, data)
    rel = con.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in rel.description]
    assert sorted(columns) == sorted(df.columns)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    assert got == rows_of(columns, rel.fetchall())


def test_entry(spark):
    assert entry.entry(spark).columns == ["severity", "sid", "alerts", "escalated", "score"]
