"""Every registered query against its SQL twin at the smallest scale."""

import pytest

import __spark_entry__ as contract
from check import differences

FOLDER = "/root/testdata/sf0.001"
TWINS = contract.oracle_sql()
ROWS_ONLY = sorted(set(contract.queries()) - set(TWINS))


@pytest.mark.parametrize("name", sorted(TWINS))
def test_query_equals_its_twin(spark, name):
    assert differences(contract.queries()[name](spark, FOLDER), FOLDER, TWINS[name]) is None


@pytest.mark.parametrize("name", ROWS_ONLY)
def test_query_without_twin_runs(spark, name):
    df = contract.queries()[name](spark, FOLDER)
    assert len(df.columns) == len(set(df.columns))
    assert df.count() > 0


def test_entry_has_rows(spark):
    df = contract.entry(spark)
    assert df.columns == ["field", "ordinal", "knocked_out_by", "r", "verdict"]
    assert {r["verdict"] for r in df.collect()} == {"DROP", "KEEP"}
