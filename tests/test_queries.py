"""Every query of the library against its SQL on the smallest tables; those without SQL must run and give a stable schema."""

import pytest

from tidemark.plans import coupling, features, ingest, joins, policy, quality, scans, state, text  # noqa: F401
from tidemark.plans.registry import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(name, spark, sf, same_rows):
    same_rows(QUERIES[name](spark, sf), ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(name, spark, sf):
    df = QUERIES[name](spark, sf)
    rows = df.collect()
    assert df.columns and all(len(r) == len(df.columns) for r in rows)


def test_entry_imports_and_lists(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).columns
