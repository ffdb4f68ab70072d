"""Whole draws and levels against SQL."""

import pytest

import __spark_entry__ as entry
from tests.oracle import compare, database
from tests.test_oracle import SF_DIR

NAMES = ["bootstrap_ci_1000", "paired_bootstrap_1000", "moving_block_bootstrap_1000", "bid_moving_block_ci_1000", "exceedance_backtest_99"]


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, name):
    ok, note = compare(spark, database(SF_DIR), SF_DIR, entry.queries()[name], entry.oracle_sql()[name])
    assert ok and not note.startswith("0 "), note
