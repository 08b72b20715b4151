"""A cross-section of the registered queries against their SQL at the smallest scale."""

from __future__ import annotations

import pytest

from oracle import compare, duck

SF_DIR = "/root/testdata/sf0.001"
NAMES = [
    "agg11_workspace_stats", "agg14_weak_areas", "agg36_period_report", "join5_question_performance", "top8_quota_selection", "sm2_3_replay",
    "doc2_quality_verdict", "doc4_language_agreement", "sea1_content_search", "join7_near_duplicates", "topic6_topic_words", "kg4_recommendations",
    "join18_inc1_changes", "q7_violations", "src8_json_documents", "str2_study_sessions",
]


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, con, name):
    verdict, detail, _ = compare(spark, con, name, SF_DIR)
    assert verdict in ("exact", "near"), detail


def test_registered_names_are_consistent():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) >= 180
