"""Differential check: every registered query at sf0.01 against its SQL."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from ledgerlens.plans.catalog import REPORTS
from ledgerlens.plans.compare import compare, duckdb_connection

SF = "/root/testdata/sf0.01"
NAMES = list(REPORTS)


@pytest.fixture(scope="module")
def con():
    return duckdb_connection(SF)


def test_every_report_has_oracle_sql():
    assert set(REPORTS) <= set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    out = compare(name, queries()[name](spark, SF), con, oracle_sql()[name])
    assert out.ok, "\n".join(out.detail)
    assert out.types_match, "\n".join(out.detail)


def test_entry_smoke(spark):
    df = entry(spark)
    assert df.count() > 0
    assert df.columns[0] == "month"


@pytest.mark.parametrize("name", ["executive_summary", "business_summary", "target_vs_actual",
                                  "rfm_segments", "customer_leaderboard", "cohort_retention",
                                  "dq_orphan_details", "loss_summary"])
def test_unstaged_warehouse_path_matches_oracle(spark, con, name):
    """The direct (unstaged) mapping gives the same results as staging."""
    from ledgerlens.plans.catalog import REPORTS
    from ledgerlens.sources.warehouse import warehouse_tables
    out = compare(name, REPORTS[name](warehouse_tables(spark, SF)), con, oracle_sql()[name])
    assert out.ok and out.types_match, "\n".join(out.detail)
