"""Registered queries against DuckDB. CUEWRIGHT_ALL=1 runs every one, else a cross-section."""
import os

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from tests.oracle import compare, connect

SF_DIR = "/root/testdata/sf0.001"
SOME = ("t03_plan_chunks", "t15_apply_repairs", "t17_fix_overlaps", "t18_merge_lines", "t19_split_long", "t21_assemble",
        "b08_payload", "b09_fit_batches", "b13_sample_spread", "b19_reassign", "r02_parse_reply", "c01_parse_cast", "c07_format_cast",
        "q03_quote_carry", "q11_audit", "q15_accept_repairs", "d01_clean_for_speech", "d12_dub_plan", "d14_overlapped",
        "s01_read_lines", "s05_to_srt", "f04_quality_menu", "l11_line_at", "w04_ready_prefix_stream", "u03_shared_bucket",
        "m01_mix_timeline", "m06_cut_points", "m07_silence_gate", "m11_onset_drift")


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(oracle_sql()) if os.environ.get("CUEWRIGHT_ALL") else SOME)
def test_same_as_duckdb(spark, duck, name):
    assert compare(queries()[name](spark, SF_DIR), duck, oracle_sql()[name]) == ""


def test_entry_and_names(spark):
    assert entry(spark).columns == ["vid", "lines", "compressed", "crowded", "clipped", "max_rate_milli"]
    assert set(oracle_sql()) <= set(queries())
