"""Registered queries next to their SQL on the smallest tables.

By default one query of every family runs; ``CROWD_ALL=1`` runs all of them.
"""

from __future__ import annotations

import os
from pathlib import Path

import pytest

import __spark_entry__ as entry
from compare import compare, connect

DIRECTORY = "/root/testdata/sf0.001"
FAMILIES = (
    "a3_validate_pick_rate", "a5_upsert_catalog", "a6_merge_gold_catalog", "a9_export_manifest",
    "a11_append_responses", "b3_exclusion_cascade", "b6_validate_answers",
    "b7_question_constraints", "b10_admissible_questions", "b11_variant_routing",
    "c9_legal_duos", "c10_null_safe_identity", "d1_win_edges", "d5_peak_values",
    "d6_weighted_proportions", "d22_coverage_deficit", "d24_consensus_distribution",
    "d32_duo_space_size", "d39_trust_score", "d43_gold_report", "d45_oriented_agreement",
    "d48_segment_trigger", "e1_scores_five_steps", "e3_ordinal_gradient", "e6_duo_grid",
    "e10_connected_components", "f2_day_streak", "f6_rate_over_limit_by_address",
    "g1_pair_coverage", "g4_concentration", "h1_priority_topk", "h4_retest_candidates",
    "i5_idempotent_append", "j1_canonical_forms", "j5_fixed_formatting", "s3_running_counters",
    "s8_answer_sessions",
)
NAMES = sorted(entry.oracle_sql()) if os.environ.get("CROWD_ALL") else sorted(FAMILIES)

pytestmark = pytest.mark.skipif(not Path(DIRECTORY).exists(), reason="test tables not present")


@pytest.fixture(scope="module")
def duck():
    return connect(DIRECTORY)


def test_every_oracle_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):
    _, rows, problem = compare(
        spark, duck, name, entry.queries()[name], entry.oracle_sql()[name], DIRECTORY
    )
    assert problem is None, problem
    assert rows > 0


def test_entry_runs(spark):
    assert entry.entry(spark).limit(1).count() == 1
