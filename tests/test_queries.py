"""A quick selection of registered queries against their SQL; ``python -m tests.oracle`` runs all."""

import os

import pytest

from tests.oracle import compare, duck
from zocalo.queries import QUERIES

PATH = "/root/testdata/sf0.001"
QUICK = ["A17_grp_month", "A02_met_order_count", "F07_flt_row_cap_flag", "J05_join_validity_interval", "J07_join_fk_anti", "P04_smp_assign_by_region",
         "X09_hash_case_id", "E08_ev_threshold_sweep", "J11_join_candidate_decision", "ST1_st_redact", "ST4_st_usage_counters", "D12_dq_redact_keys"]


@pytest.mark.parametrize("name", list(QUERIES) if os.environ.get("ALL_QUERIES") else QUICK)
def test_query_equals_sql(spark, name):
    query = QUERIES[name]
    ok, info = compare(spark, duck(PATH), name, query.run, query.sql, PATH)
    assert ok, info


def test_entry_has_one_sql_per_query():
    import __spark_entry__ as entry
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 150
