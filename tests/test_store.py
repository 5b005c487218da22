import csv
from datetime import UTC, date, datetime

import pytest

from ledgerloom.config import ReconConfig, dq_config, enrollment_rules, recon_config
from ledgerloom.operators import audit, datatests, sealed
from ledgerloom.plans import marts
from ledgerloom.plans.run_all import assign_store, decide_store, enroll_store, reconcile_store, resolve_store, run_all, seals_of
from ledgerloom.schemas import ENROLLMENT_COLUMNS, schema_of
from ledgerloom.sources import files, staging
from ledgerloom.sources.tables import TableStore
from ledgerloom.streaming.intake import start_intake

AS_OF = datetime(2026, 9, 1)


def rows(spark, table, data):
    names = schema_of(table).names
    return spark.createDataFrame([tuple(r.get(c) for c in names) for r in data], schema_of(table))


def seeded(spark, root):
    """A small store where every outcome occurs."""
    day, at = date(2026, 8, 25), datetime(2026, 8, 25, 12)
    tx = [dict(transaction_id=f"T{i}", account_id=f"A{i % 3}", transaction_type="debit", amount=100.0 + i, currency="USD",
               posting_date=day, reference_id=f"REF-T-{i:04d}", created_at=at, status="posted") for i in range(1, 9)]
    tx[6]["reference_id"], tx[7]["account_id"] = None, "GONE"
    pay = [("P1", "REF-T-0001", 101.0), ("P2", "ref t 0001", 101.0), ("P3", "REF-T-0002", 150.0), ("P4", "REF-T-000X", 103.4), ("P5", "OTHER", 1.0)]
    store = TableStore(spark, str(root))
    store.write_many({
        "transactions": rows(spark, "transactions", tx),
        "accounts": rows(spark, "accounts", [dict(account_id=f"A{i}", customer_id="C1", account_type="checking", current_balance=5.0, available_balance=4.0, status="active") for i in range(3)]),
        "customers": rows(spark, "customers", [dict(customer_id="C1", email="a@example.com", customer_type="business")]),
        "payment_files": rows(spark, "payment_files", [dict(file_id="F1", record_count=5, total_amount=456.4)]),
        "payment_records": rows(spark, "payment_records", [dict(payment_id=i, file_id="F1", reference_id=r, amount=a, currency="USD", payment_date=day, status="unmatched") for i, r, a in pay]),
        "pending_enrollments": rows(spark, "pending_enrollments", [
            dict(enrollment_id=f"ENR-{i}", entity_id=f"N{i}", program_code="GROWTH", enrollment_date=datetime(2026, 1, 1), incentive_amount=a,
                 term_months="7", region=r, submitted_by="op", status="pending") for i, a, r in ((1, "700.00", "WEST"), (2, "1000.00", "WEST"), (3, "700.00", "MARS"))]),
    }, "replace")
    return store


def test_whole_job(spark, tmp_path):
    store = seeded(spark, tmp_path / "store")
    stages = {r.stage: r for r in run_all(store, AS_OF, "R1").collect()}
    assert stages["audit"].ok and stages["audit"].items > 0, stages
    assert (stages["enroll"].items, stages["enroll"].passed, stages["enroll"].exceptions) == (3, 1, 1)
    assert stages["queue"].top_score > 0
    got = {r.payment_id: (r.match_status, r.exception_reason or r.match_method) for r in store.read("reconciliation_results").where("payment_id IS NOT NULL").collect()}
    assert got == {"P1": ("matched", "exact"), "P2": ("exception", "duplicate"), "P3": ("exception", "amount_mismatch"), "P4": ("matched", "fuzzy"), "P5": ("unmatched_payment", None)}
    assert {r.payment_id: r.status for r in store.read("payment_records").collect()}["P2"] == "exception"
    assert store.count("dq_results") == 17
    assert {r.enrollment_id: r.status for r in store.read("pending_enrollments").collect()} == {"ENR-1": "accepted", "ENR-2": "mismatch", "ENR-3": "rejected"}
    with pytest.raises(audit.BatchIdInUse):
        run_all(store, AS_OF, "R1")

    mart = marts.recon_summary(store.read("reconciliation_results")).first()
    assert (mart.total, mart.matched, mart.reconciliation_rate, mart.unmatched_ledger) == (5, 2, 40.0, 6)
    tables = {t: store.read(t) for t in staging.STAGED}
    tests = datatests.run_all_tests(tables).collect()
    assert len(tests) == 16 and sum(t.failing_rows for t in tests) == 0
    assert datatests.control_totals(store.read("payment_files"), store.read("payment_records")).first().agrees

    # a second batch of reconciliation keeps the first one's rows
    second = reconcile_store(store, "R2-RECON", AS_OF, file_id="F1")
    assert second["matched_total"] == 2 and second["audit_events"] == 4
    assert store.read("reconciliation_results").select("batch_id").distinct().count() == 2
    with pytest.raises(ValueError):
        reconcile_store(store, "R3", AS_OF, file_id="NONE")

    exc = store.read("exception_queue")
    dq_ids = [r.exception_id for r in exc.where("source = 'dq'").orderBy("exception_id").collect()]
    assign_store(store, spark.createDataFrame([(dq_ids[0], "kim")], "exception_id string, owner string"))
    resolve_store(store, spark.createDataFrame([(dq_ids[0], "typo", "n")], "exception_id string, root_cause string, resolution_notes string"), AS_OF)
    decide_store(store, spark.createDataFrame([("EXC-ENR-2-000001", "accept_a", "rounding")], "exception_id string, decision string, root_cause string"), AS_OF)
    left = {r.exception_id: (r.status, r.assigned_to) for r in store.read("exception_queue").collect()}
    assert left[dq_ids[0]] == ("resolved", "kim") and left["EXC-ENR-2-000001"][0] == "resolved"
    assert store.read("accepted_enrollments").where("enrollment_id = 'ENR-2'").first().expected_payout == 1000.02
    assert sealed.verify(store.read("audit_event_log"), seals_of(store)).first()["verified"]


def test_store_modes_time_zone_and_sql(spark, tmp_path):
    store = TableStore(spark, str(tmp_path / "s"))
    assert store.count("customers") == 0
    one = spark.createDataFrame([("C1", "a"), ("C2", "b")], "customer_id string, name string")
    store.write("customers", one)
    store.write("customers", one)
    assert store.count("customers") == 4 and store.read("customers", 3).count() == 3
    store.write("customers", store.read("customers").where("name = 'a'"), "replace")
    assert store.count("customers") == 2 and store.read("customers").columns == schema_of("customers").names
    store.write("odd", spark.createDataFrame([(1,)], "x int"), "replace")
    store.write("odd", spark.createDataFrame([("y",)], "z string"), "replace")
    assert store.read("odd").columns == ["z"]
    with pytest.raises(ValueError):
        store.read("never")
    zoned = spark.createDataFrame([("C9", datetime(2026, 1, 1, 5, tzinfo=UTC))], "customer_id string, created_at timestamp")
    store.write("customers", zoned)
    assert store.read("customers").where("customer_id = 'C9'").first().created_at == datetime(2026, 1, 1, 5)
    found = store.query("SELECT customer_id FROM customers WHERE created_at = :t", {"t": datetime(2026, 1, 1, 5, tzinfo=UTC)})
    assert [r.customer_id for r in found.collect()] == ["C9"]
    assert store.query("SELECT count(*) AS n FROM customers WHERE customer_id = ?", ["C1"]).first().n == 2


def test_csv_in_and_out(spark, tmp_path):
    path = tmp_path / "p.csv"
    path.write_text("payment_id,amount,reference_id,payment_date\nP1,5.50,,2026-08-01\nP2,7,R2,2026-08-02\n")
    got = files.read_payments(spark, str(path)).orderBy("payment_id").collect()
    assert got[0].amount == 5.5 and got[0].reference_id is None and got[1].payment_date == date(2026, 8, 2)
    files.write_csv(files.read_payments(spark, str(path)), str(tmp_path / "out"))
    assert files.read_payments(spark, str(tmp_path / "out")).count() == 2


def enrollment_csv(path, changes):
    base = dict(zip(ENROLLMENT_COLUMNS, ("", "N", "GROWTH", "2026-01-15", "1200.00", "12", "WEST", "op")))
    with open(path, "w", newline="") as out:
        writer = csv.DictWriter(out, ENROLLMENT_COLUMNS)
        writer.writeheader()
        for c in changes:
            writer.writerow({**base, **c})


def test_enrollment_file(spark, tmp_path):
    """File order decides which of two rows with one entity is the duplicate; a blank operator is missing."""
    path = tmp_path / "e.csv"
    enrollment_csv(path, [
        {"enrollment_id": "Z"}, {"enrollment_id": "A"}, {"enrollment_id": "B", "entity_id": "M", "incentive_amount": "1000.00", "term_months": "7"},
        {"enrollment_id": "C", "entity_id": "K", "submitted_by": ""},
    ])
    store = TableStore(spark, str(tmp_path / "s"))
    counts = enroll_store(store, AS_OF, rows=files.read_enrollments(spark, str(path)), order="file_order")
    assert counts == {"processed": 4, "accepted": 1, "mismatch": 1, "rejected": 2, "skipped": 0}
    assert store.read("accepted_enrollments").first().enrollment_id == "Z"
    again = enroll_store(store, AS_OF, rows=files.read_enrollments(spark, str(path)), order="file_order")
    assert again["skipped"] == 4 and store.count("audit_event_log") == 4


def test_streaming_intake(spark, tmp_path):
    store, folder = TableStore(spark, str(tmp_path / "s")), tmp_path / "in"
    folder.mkdir()

    def drain():
        query = start_intake(store, str(folder), str(tmp_path / "cp"), AS_OF)
        query.awaitTermination(120)
        assert query.exception() is None

    enrollment_csv(folder / "1.csv", [{"enrollment_id": "S1"}, {"enrollment_id": "S2", "region": "MARS"}])
    drain()
    # the same entity and a repeated id in a later file: the id is skipped, the entity is fine
    enrollment_csv(folder / "2.csv", [{"enrollment_id": "S1"}, {"enrollment_id": "S3"}])
    drain()
    assert sorted(r.enrollment_id for r in store.read("accepted_enrollments").collect()) == ["S1", "S3"]
    assert store.count("audit_event_log") == 3
    assert sealed.verify(store.read("audit_event_log"), seals_of(store)).first()["verified"]


def test_settings(tmp_path):
    path = tmp_path / "r.yml"
    path.write_text("match_tolerance_amount: 2\nstale_days: 9\n")
    assert recon_config(path) == ReconConfig(amount_tolerance=2.0, stale_days=9)
    assert recon_config(tmp_path / "none.yml") == ReconConfig()
    with pytest.raises(FileNotFoundError):
        dq_config(tmp_path / "none.yml")
    assert str(enrollment_rules().dual_source_tolerance) == "0.01"


def test_staging_and_mart_tests(spark):
    queue = rows(spark, "exception_queue", [
        dict(exception_id="X1", reference_id="transactions:T:1", priority="high", status="open"),
        dict(exception_id="X1", reference_id="bare", priority="urgent", status=None), dict(reference_id=None),
    ])
    staged = staging.stage("exception_queue", queue)
    assert [(r.ref_dataset, r.ref_record_id) for r in staged.collect()] == [("transactions", "T:1"), ("bare", None), (None, None)]
    got = {(t.column_name, t.test): t.failing_rows for t in datatests.run_all_tests({"exception_queue": queue}).collect()}
    assert got == {("exception_id", "not_null"): 1, ("exception_id", "unique"): 1, ("priority", "accepted_values"): 1, ("status", "accepted_values"): 0}
    staging.register({"exception_queue": queue})
    assert spark.table("stg_exception_queue").count() == 3
