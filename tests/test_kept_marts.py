"""Marts kept up by change equal the marts of the whole tables, and read what has changed."""

import pytest
from pyspark.sql import functions as F
from test_store import AS_OF, rows, seeded

from ledgerloom.operators.exceptions import AMOUNT_TABLES
from ledgerloom.plans import kept_marts, marts
from ledgerloom.plans.run_all import assign_store, reconcile_store


def listed(df):
    return sorted(map(repr, df.collect()))


def same(store):
    queue, tables = store.read("exception_queue"), {t: store.read(t) for t in AMOUNT_TABLES}
    assert listed(kept_marts.exception_aging(store, AS_OF)) == listed(marts.exception_aging(queue, tables, AS_OF))


def test_recon_counts_add_up(spark, tmp_path):
    store = seeded(spark, tmp_path / "s")
    assert kept_marts.refresh_recon(store) == 0
    for batch in ("B1", "B2"):
        reconcile_store(store, batch, AS_OF)
        assert kept_marts.refresh_recon(store) > 0
        assert store.read("mart_recon_counts", last=True).select("batch_id").distinct().collect() == [(batch,)]
    results = store.read("reconciliation_results")
    assert listed(kept_marts.recon_summary(store)) == listed(marts.recon_summary(results))
    assert listed(kept_marts.outcome_breakdown(store)) == listed(marts.outcome_breakdown(results))
    assert kept_marts.refresh_recon(store) == 0
    assert listed(kept_marts.recon_summary(store)) == listed(marts.recon_summary(results))
    # a replaced table is counted anew
    store.write("reconciliation_results", results.where("batch_id = 'B2'"), "replace")
    kept_marts.refresh_recon(store)
    assert [r.batch_id for r in kept_marts.recon_summary(store).collect()] == ["B2"]
    with pytest.raises(ValueError), store.job():
        kept_marts.refresh_recon(store)


def test_only_touched_parts_are_rewritten(spark, tmp_path):
    store = seeded(spark, tmp_path / "s")
    refs = ["transactions:T1", "payment_records:P1", "payment_records:P2", "pending_enrollments:ENR-1", "transactions:NEW", "none", None, "accounts:A1"]
    queue = [dict(exception_id=f"X{i}", source="dq", reference_id=r, priority="high", status="open", created_at=AS_OF) for i, r in enumerate(refs)]
    store.write("exception_queue", rows(spark, "exception_queue", queue))
    assert len(kept_marts.refresh_exceptions(store)) == store.parts
    same(store)
    assert kept_marts.refresh_exceptions(store) == []
    assign_store(store, spark.createDataFrame([("X3", "me")], "exception_id string, owner string"))
    assert len(kept_marts.refresh_exceptions(store)) == 1
    same(store)
    # a new ledger row gives an exception its amount; a payment's amount changes
    store.write("transactions", store.read("transactions").limit(1).withColumn("transaction_id", F.lit("NEW")))
    asked = spark.createDataFrame([("P2",)], "payment_id string")
    store.update("payment_records", asked, lambda own: own.withColumn("amount", F.when(F.col("payment_id") == "P2", 9e5).otherwise(F.col("amount"))))
    assert 1 <= len(kept_marts.refresh_exceptions(store)) <= 3
    same(store)
    # a row leaves the queue: its part is rewritten, even if nothing stays in it
    gone = spark.createDataFrame([("X0",)], "exception_id string")
    parts = store._parts_of("exception_queue", gone)
    store.rewrite("exception_queue", parts, store.parts_rows("exception_queue", parts).where("exception_id <> 'X0'"))
    assert kept_marts.refresh_exceptions(store) == parts
    same(store)
    assert store.read("mart_exceptions").where("exception_id = 'X0'").isEmpty()
