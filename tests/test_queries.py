import re

import pytest
from compare import compare, connect

from __spark_entry__ import entry, oracle_sql, queries

SF = "/root/testdata/sf0.001"
# the quick queries of each area; tests/compare.py runs all of them
QUICK = [
    "recon_normalize", "recon_results", "recon_fuzzy_edges", "dq_results", "dq_routed", "dq_iqr", "dq_referential",
    "exc_queue", "exc_queue_top", "recon_long_references", "mart_exception_aging", "exc_resolve", "enroll_validate", "enroll_dual_source", "audit_event_hash",
    "audit_append", "evidence_exceptions", "data_tests", "store_query", "csv_payments",
]


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", QUICK)
def test_query_equals_its_sql(spark, con, name):
    assert compare(spark, con, SF, name, queries()[name], oracle_sql()[name]) is None


def test_every_query_has_a_twin():
    from ledgerloom.plans.oracles import ORACLES
    from ledgerloom.plans.registry import QUERIES

    assert set(ORACLES) == set(QUERIES)
    assert set(oracle_sql()) <= set(queries())


def test_entry(spark):
    rows = entry(spark)
    assert rows.columns[:2] == ["recon_id", "batch_id"] and not rows.isEmpty()


@pytest.mark.parametrize("name", ["dq_results", "mart_exception_aging", "enroll_validate"])
def test_plans_have_no_pairwise_join(spark, name):
    plan = queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin|Python", plan)


def test_a_dataset_is_checked_in_one_pass(spark):
    """Accounts and payments need no shuffle but the final one-row aggregate."""
    plan = queries()["dq_results"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and plan.count("Exchange SinglePartition") == 4
