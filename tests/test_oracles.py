"""Registered queries against their SQL on the smallest scale.

The default run takes one query of each kind; TICKLOOM_ALL=1 takes them all.
"""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry
from tests import harness

SF = "/root/testdata/sf0.001"
SHORT = [
    "daily_bars", "f2_bar_projection", "f5_window_clamp", "f8_resolution_resolve", "f12_bar_hygiene", "t2_contract_page",
    "a3_coverage_grid", "a12_typical_rows", "a20_request_progress", "q7_overlap_count", "j1_spot_asof", "j3_at_the_money",
    "j7_snap_to_bar", "i1_coverage_gaps", "i4_missing_days", "c3_shift_trading_days", "p2_weekly_splits", "w1_chunk_replace",
    "w5_expiry_upsert", "w7_id_assignment", "k3_coverage_subtraction", "s2_envelope_quarantine", "s4_expiry_dates",
    "s2_envelope_bars", "s3_instrument_master", "s11_spec_problems", "s14_file_digests", "k6_refused_underlyings", "k8_after_chunk",
    "k8_seal_if_idle", "c2_count_trading_days", "a17_root_characters", "a17_unusual_roots", "w10_shrink_guard", "w12_live_cycles",
    "w15_needs_diff", "w16_root_merge", "q7_blocks_reaching_back", "j4_chain_at", "j6_chain_window", "a11_trading_days", "w13_purge_count",
    "sql_bars", "sql_spot_at", "sql_atm_strike", "sql_chain_at", "sql_chain_window",
]
NAMES = list(entry.oracle_sql()) if os.environ.get("TICKLOOM_ALL") else SHORT


@pytest.fixture(scope="module")
def duck():
    return harness.connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_rows_match(spark, duck, name):
    problem = harness.compare(entry.queries()[name](spark, SF), duck, entry.oracle_sql()[name])
    assert problem is None, problem


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
