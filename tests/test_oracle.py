"""Registered queries against their SQL. ``KW_ALL=1`` runs all of them (several minutes)."""

import os

import pytest

import __spark_entry__ as entry
from tests.oracle import DATA, compare, database

SF_DIR = str(DATA / "sf0.001")
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()
QUICK = ["exante_block_view", "expost_block_agg", "pit_lookback", "pit_last", "asof_backward", "event_window_vwap", "latest_wins", "freshest_lead",
         "lagged_targets", "upsample_mixed_steps", "local_4h_blocks", "gate_closure", "holiday_calendar", "episodes", "interpolate_bounded", "decluster",
         "decay_state", "rolling_threshold", "robust_z", "auction_summary", "combine_tenders", "dedup_last", "equal_bins", "gap_scan", "source_merge",
         "driver_corr", "holm_adjust", "point_metrics", "combine_forecasts", "choose_monthly", "xml_points", "series_profile"]


@pytest.fixture(scope="module")
def con():
    return database(SF_DIR)


@pytest.mark.parametrize("name", sorted(ORACLES) if os.environ.get("KW_ALL") else QUICK)
def test_matches_sql(spark, con, name):
    ok, note = compare(spark, con, SF_DIR, QUERIES[name], ORACLES[name])
    assert ok, note


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["stream_interval_features", "stream_latest_revision"])
def test_stream_equals_batch(spark, con, name):
    ok, note = compare(spark, con, SF_DIR, QUERIES[name], ORACLES[name])
    assert ok, note
