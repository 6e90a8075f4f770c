"""Every query with a SQL twin against DuckDB, on tables large enough for rows; queries without one are tested elsewhere."""

import pytest

import __spark_entry__ as contract
import oracle

SF = "/root/testdata/sf0.01"
# Rows are not to be expected where the tables obey the rules.
MAY_BE_EMPTY = {"d1_duplicate_keys", "d3_orphans", "j6_unmatched_cells", "u2_missing_dates", "d4_unexpected_values"}
ORACLES = contract.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return oracle.connect(SF)


def test_contract_keys():
    assert set(ORACLES) <= set(contract.queries())
    assert len(ORACLES) > 90


def test_entry_rows(spark):
    assert contract.entry(spark).count() == 1476


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    assert oracle.difference(contract.queries()[name](spark, SF), duck, ORACLES[name]) is None
    assert name in MAY_BE_EMPTY or duck.execute(ORACLES[name]).fetchone() is not None
