"""Interval estimates with 1,000 draws and exceedance scores at 99 levels, each beside its SQL.

The queries of the same names without a number keep the few draws and levels that their SQL has.
"""

from __future__ import annotations

from .evaluation import exceedance_backtest, exceedance_sql, paired_bootstrap
from .policies import bid_moving_block_ci
from .registry import ORACLES, query
from .statistics import bootstrap_ci, moving_block_bootstrap

DRAWS = 1000
LEVELS = [k / 100 for k in range(1, 100)]


def _drawn(name: str, few: int) -> str:
    """The SQL of a query with ``DRAWS`` draws in place of ``few``."""
    old = f"generate_series(0, {few - 1})) AS b"
    if ORACLES[name].count(old) != 1:
        raise ValueError(f"the SQL of {name!r} doesn't have {few} draws")
    return ORACLES[name].replace(old, f"generate_series(0, {DRAWS - 1})) AS b")


@query("bootstrap_ci_1000", _drawn("bootstrap_ci", 200))
def bootstrap_ci_1000(t):
    return bootstrap_ci(t, DRAWS)


@query("paired_bootstrap_1000", _drawn("paired_bootstrap", 100))
def paired_bootstrap_1000(t):
    return paired_bootstrap(t, DRAWS)


@query("moving_block_bootstrap_1000", _drawn("moving_block_bootstrap", 50))
def moving_block_bootstrap_1000(t):
    return moving_block_bootstrap(t, DRAWS)


@query("bid_moving_block_ci_1000", _drawn("bid_moving_block_ci", 40))
def bid_moving_block_ci_1000(t):
    return bid_moving_block_ci(t, DRAWS)


@query("exceedance_backtest_99", exceedance_sql(LEVELS, 30))
def exceedance_backtest_99(t):
    return exceedance_backtest(t, LEVELS, min_fit=30)
