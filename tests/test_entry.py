"""Driver contract: entry() and every registered query run, with a stable schema, at sf0.001."""

import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"
ROWS_ONLY = sorted(set(E.queries()) - set(E.oracle_sql()))


def test_entry_schema_is_stable(spark):
    a, b = E.entry(spark), E.entry(spark)
    assert a.schema == b.schema and a.count() == b.count() > 0


@pytest.mark.parametrize("name", ROWS_ONLY)
def test_rows_only_queries_run(spark, name):
    df = E.queries()[name](spark, SF)
    assert df.columns and df.count() >= 0
    again = E.queries()[name](spark, SF)
    assert again.schema == df.schema
