"""The registered queries: every operator over the given tables, as (session, folder) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DQConfig, ReconConfig, dq_config, enrollment_rules, recon_config
from ..functions.canonical import event_hash
from ..functions.text import normalize_reference, similarity
from ..operators import audit, datatests, enrollment, exceptions, quality, reconcile, sealed, urgent
from ..operators.fuzzy import fuzzy_edges
from ..operators.kept_checks import kept_results
from ..functions.scratch import materialize, new_path
from ..schemas import ENROLLMENT_COLUMNS
from ..sources import files
from ..sources.staging import stage
from ..sources.tables import TableStore, conform
from ..streaming.intake import start_intake
from . import fixtures as fx
from . import kept_marts, marts
from .run_all import enroll_store, reconcile_store, run_all

BATCH = "BATCH-001"
_SETTINGS = Path(__file__).resolve().parent.parent / "settings"
_CFG = ReconConfig()


def _matched(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    payments, ledger = fx.load(spark, sf, "fx_payment_records"), fx.load(spark, sf, "fx_transactions")
    return payments, ledger, reconcile.match_payments(payments, ledger, _CFG, fx.ORDERS_AS_OF)


def _results(spark: SparkSession, sf: str) -> DataFrame:
    _, ledger, matched = _matched(spark, sf)
    left = reconcile.unmatched_ledger(ledger, matched)
    return reconcile.results(matched, left, BATCH, fx.ORDERS_AS_OF)


def _text(df: DataFrame) -> DataFrame:
    """Timestamps and dates as text, so both engines print the same."""
    return df.withColumns({
        c: F.col(c).cast("string") for c, t in df.dtypes if t.startswith("timestamp") or t == "date"
    })


def _whole(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("bigint") for n in names})


# -- reconciliation -------------------------------------------------------- #


def recon_long_references(spark: SparkSession, sf: str) -> DataFrame:
    """Similarity of texts beyond one number's bits, one to three letters apart."""
    texts = fx.load(spark, sf, "fx_long_references")
    return texts.select("transaction_id", similarity(F.col("a"), F.col("b")).alias("similarity"))


def recon_normalize(spark: SparkSession, sf: str) -> DataFrame:
    return fx.load(spark, sf, "fx_payment_records").select(
        "payment_id", normalize_reference(F.col("reference_id")).alias("normalized")
    )


def recon_results(spark: SparkSession, sf: str) -> DataFrame:
    return _text(_results(spark, sf))


def recon_unmatched_ledger(spark: SparkSession, sf: str) -> DataFrame:
    _, ledger, matched = _matched(spark, sf)
    return reconcile.unmatched_ledger(ledger, matched).select(F.col("id").alias("transaction_id"), "seq")


def recon_summary(spark: SparkSession, sf: str) -> DataFrame:
    _, ledger, matched = _matched(spark, sf)
    return reconcile.run_summary(matched, ledger, BATCH)


def recon_status_update(spark: SparkSession, sf: str) -> DataFrame:
    payments, _, matched = _matched(spark, sf)
    return reconcile.payment_status(payments, matched).select("payment_id", "status")


def recon_fuzzy_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Fuzzy pairs of all payments whose reference is unknown to the ledger."""
    payments, ledger = fx.load(spark, sf, "fx_payment_records"), fx.load(spark, sf, "fx_transactions")
    asked = payments.select(
        normalize_reference(F.col("reference_id")).alias("ref"), F.col("currency").alias("cur"), "amount",
        F.col("payment_date").alias("day"), F.col("payment_id").alias("pt"), F.lit(1).alias("n_p"),
    )
    book = ledger.select(
        F.col("transaction_id").alias("id"), F.col("transaction_id").alias("ord"),
        normalize_reference(F.col("reference_id")).alias("ref"), F.col("currency").alias("cur"), "amount",
        F.col("posting_date").alias("day"),
    )
    unknown = asked.join(book.select("ref").distinct(), "ref", "left_anti")
    return fuzzy_edges(unknown, book, _CFG).select(
        F.col("pt").alias("payment_id"), F.col("lt").alias("transaction_id"), F.round("score", 4).alias("score")
    )


def recon_copies(spark: SparkSession, sf: str) -> DataFrame:
    """Copies against copies: the k-th payment of a group gets the k-th ledger row, the rest are duplicates."""
    cfg = ReconConfig(amount_tolerance=0.5, date_window_days=0, fuzzy_threshold=1.0)
    payments, ledger = fx.load(spark, sf, "fx_copied_payments"), fx.load(spark, sf, "fx_copied_ledger")
    matched = reconcile.match_payments(payments, ledger, cfg, fx.EVENTS_AS_OF)
    linked = F.col("match_method").isNotNull() | (F.col("exception_reason") == "duplicate")
    return matched.select(
        "payment_id", "match_status", "match_method", "exception_reason",
        F.when(linked, F.col("ledger_transaction_id")).alias("ledger_transaction_id"),
    )


def recon_events(spark: SparkSession, sf: str) -> DataFrame:
    _, _, matched = _matched(spark, sf)
    return reconcile.audit_rows(matched, BATCH).drop("ord")


def recon_breakdown(spark: SparkSession, sf: str) -> DataFrame:
    return marts.outcome_breakdown(_results(spark, sf))


def recon_control_totals(spark: SparkSession, sf: str) -> DataFrame:
    """One file states what it holds, one states a row too many, one has no records."""
    payments = fx.load(spark, sf, "fx_payment_records")
    stated = payments.groupBy("file_id").agg(
        (F.count(F.lit(1)) + F.when(F.col("file_id") == "FILE-0002", 1).otherwise(0)).alias("record_count"),
        F.round(F.sum("amount"), 2).alias("total_amount"),
    )
    none = payments.limit(1).select(F.lit("FILE-0003").alias("file_id"), F.lit(5).cast("bigint").alias("record_count"), F.lit(1.0).alias("total_amount"))
    return datatests.control_totals(stated.unionByName(none), payments)


def recon_configured(spark: SparkSession, sf: str) -> DataFrame:
    """Matching by a settings file: no tolerance, no window, no fuzzy step, stale after 60 days."""
    payments, ledger = fx.load(spark, sf, "fx_payment_records"), fx.load(spark, sf, "fx_transactions")
    matched = reconcile.match_payments(payments, ledger, recon_config(_SETTINGS / "strict_recon.yml"), fx.ORDERS_AS_OF)
    return matched.select("payment_id", "match_status", "match_method", "exception_reason")


def mart_recon_summary(spark: SparkSession, sf: str) -> DataFrame:
    return _text(marts.recon_summary(_results(spark, sf)))


def mart_recon_kept(spark: SparkSession, sf: str) -> DataFrame:
    """A batch stored in two commits and another after it, the mart's counts refreshed after each."""
    store, results = TableStore(spark, new_path(spark, "store")), materialize(_results(spark, sf), "results")
    matched = F.col("match_status") == "matched"
    store.write("reconciliation_results", results.where(~matched))
    kept_marts.refresh_recon(store)
    store.write("reconciliation_results", results.where(matched))
    kept_marts.refresh_recon(store)
    store.write("reconciliation_results", results.withColumn("batch_id", F.lit("BATCH-002")))
    kept_marts.refresh_recon(store)
    return _text(kept_marts.recon_summary(store))


def mart_aging_kept(spark: SparkSession, sf: str) -> DataFrame:
    """Two thirds of the queue and nine tenths of the ledger, then the rest: the mart after its parts were refreshed."""
    store, tables = TableStore(spark, new_path(spark, "store")), _amount_tables(spark, sf)
    queue, ledger = fx.load(spark, sf, "fx_exception_queue"), tables["transactions"]
    late, third = F.crc32("transaction_id") % 10 == 0, F.crc32("exception_id") % 3 == 0
    store.write_many({**tables, "transactions": ledger.where(~late), "exception_queue": queue.where(~third)}, "replace")
    kept_marts.refresh_exceptions(store)
    store.write_many({"transactions": ledger.where(late), "exception_queue": queue.where(third)}, "append")
    kept_marts.refresh_exceptions(store)
    return _whole(_text(kept_marts.exception_aging(store, fx.EVENTS_AS_OF)), "age_days", "sla_days")


# -- data quality ---------------------------------------------------------- #


def _dq(names: dict[str, str], cap: int | None = None) -> DQConfig:
    base = dq_config()
    return DQConfig({k: {**base.datasets[k], "table": v} for k, v in names.items()}, base.type_weights, cap)


_FX_SETS = {
    "transactions": "fx_transactions", "accounts": "fx_accounts",
    "customers": "fx_customers", "payment_records": "fx_payment_records",
}


def _quality(spark: SparkSession, sf: str, cap: int | None = None) -> quality.QualityRun:
    return quality.run_quality(_dq(_FX_SETS, cap), lambda t: fx.load(spark, sf, t), fx.ORDERS_AS_OF, "DQ-001")


def _dq_rows(spark: SparkSession, sf: str) -> DataFrame:
    return quality.quality_results(_dq(_FX_SETS), lambda t: fx.load(spark, sf, t), fx.ORDERS_AS_OF)


def dq_results(spark: SparkSession, sf: str) -> DataFrame:
    return _whole(_text(_dq_rows(spark, sf).drop("checked", "warning")), "failing_records")


def dq_routed(spark: SparkSession, sf: str) -> DataFrame:
    return _quality(spark, sf).exceptions.select("exception_id", "source", "reference_id", "priority", "status")


def dq_routed_capped(spark: SparkSession, sf: str) -> DataFrame:
    """A queue cut to 25 rows a check, as a caller may ask for, and how many rows each check withheld."""
    run = _quality(spark, sf, cap=25)
    kept = run.exceptions.groupBy(F.split("reference_id", ":")[0].alias("dataset_name")).agg(F.count(F.lit(1)).alias("routed"))
    held = run.results.groupBy("dataset_name").agg(F.sum("withheld").alias("withheld"))
    return held.join(kept, "dataset_name", "left").select("dataset_name", F.coalesce("routed", F.lit(0)).alias("routed"), "withheld")


def dq_configured(spark: SparkSession, sf: str) -> DataFrame:
    """Checks of a settings file: a range, a column the table lacks (passes, with a warning), a wrong count."""
    run = quality.run_quality(dq_config(_SETTINGS / "small_quality.yml"), lambda t: fx.load(spark, sf, t), fx.ORDERS_AS_OF, "DQ-002")
    return _whole(run.results.select("check_name", "passed", "failing_records", "quality_score", "warning", "withheld"), "failing_records")


def dq_kept(spark: SparkSession, sf: str) -> DataFrame:
    """Nine tenths of every dataset checked and kept, then the last tenth read alone: the results of all rows."""
    root, cfg = new_path(spark, "kept"), _dq(_FX_SETS)
    for last in (False, True):
        for name, view in _FX_SETS.items():
            rows = fx.load(spark, sf, view)
            tenth = F.crc32(cfg.datasets[name]["id_field"]) % 10 == 0
            rows.where(tenth if last else ~tenth).write.mode("append").parquet(f"{root}/{view}")
        found = kept_results(spark, f"{root}/state", cfg, lambda t: spark.read.parquet(f"{root}/{t}"), fx.ORDERS_AS_OF)
    return _whole(_text(found.drop("checked", "warning")), "failing_records")


def dq_check_view(spark: SparkSession, sf: str) -> DataFrame:
    return _whole(quality.check_view(_dq_rows(spark, sf)), "failing_records")


def dq_events(spark: SparkSession, sf: str) -> DataFrame:
    return _quality(spark, sf).events.select("event_type", "entity_type", "entity_id", "action", "batch_id")


def dq_summary_totals(spark: SparkSession, sf: str) -> DataFrame:
    return _whole(quality.run_totals(_dq_rows(spark, sf)), "total_failing_records")


def _outliers(spark: SparkSession, sf: str, rule: str, threshold: float) -> DataFrame:
    df = fx.load(spark, sf, "fx_transactions")
    fails = quality.zscore_fails if rule == "zscore" else quality.iqr_fails
    return df.where(fails(df, "amount", threshold)).select("transaction_id", "amount")


def dq_zscore(spark: SparkSession, sf: str) -> DataFrame:
    return _outliers(spark, sf, "zscore", 3.0)


def dq_iqr(spark: SparkSession, sf: str) -> DataFrame:
    return _outliers(spark, sf, "iqr", 1.5)


def dq_referential(spark: SparkSession, sf: str) -> DataFrame:
    ledger, accounts = fx.load(spark, sf, "fx_transactions"), fx.load(spark, sf, "fx_accounts")
    lost = quality.missing_parents(ledger, "account_id", accounts, "account_id").withColumnRenamed("key", "account_id")
    return ledger.join(lost, "account_id", "left_semi").select("transaction_id", "account_id")


def dq_range(spark: SparkSession, sf: str) -> DataFrame:
    df = fx.load(spark, sf, "fx_accounts")
    return df.where(quality.range_fails(F.col("current_balance"), 0.0, 9000.0)).select("account_id", "current_balance")


def dq_record_count(spark: SparkSession, sf: str) -> DataFrame:
    check = {"type": "completeness", "name": "Expected count", "expected_count": 15000}
    cfg = DQConfig({"transactions": {"table": "fx_transactions", "id_field": "transaction_id", "checks": [check]}})
    run = quality.flag_dataset("transactions", cfg, lambda t: fx.load(spark, sf, t), fx.ORDERS_AS_OF)
    return _whole(quality.check_results(run, fx.ORDERS_AS_OF).select("check_name", "passed", "failing_records", "quality_score"), "failing_records")


def mart_dq_summary(spark: SparkSession, sf: str) -> DataFrame:
    return _whole(_text(marts.dq_summary(_dq_rows(spark, sf), dq_config().type_weights)), "total_failing_records")


def dq_dataset_scores(spark: SparkSession, sf: str) -> DataFrame:
    return quality.dataset_scores(_dq_rows(spark, sf), {})


# -- exceptions ------------------------------------------------------------ #


def _amount_tables(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    return {t: fx.load(spark, sf, f"fx_{t}") for t in exceptions.AMOUNT_TABLES}


def exc_amount_at_risk(spark: SparkSession, sf: str) -> DataFrame:
    queue = fx.load(spark, sf, "fx_exception_queue")
    return exceptions.scored(queue, _amount_tables(spark, sf), fx.EVENTS_AS_OF).select(
        "exception_id", "amount_at_risk", "amount_basis", "amount_at_risk_factor"
    )


def exc_queue(spark: SparkSession, sf: str) -> DataFrame:
    queue = fx.load(spark, sf, "fx_exception_queue")
    ranked = exceptions.ranked_queue(queue, _amount_tables(spark, sf), fx.EVENTS_AS_OF, status="open")
    return _whole(_text(ranked.drop("assigned_to")), "age_days", "sla_days")


def exc_queue_top(spark: SparkSession, sf: str) -> DataFrame:
    """The hundred most urgent open items at several dates, from one stored order."""
    queue = fx.load(spark, sf, "fx_exception_queue")
    order = urgent.stored_order(queue, _amount_tables(spark, sf), status="open")
    tops = [
        urgent.most_urgent(order, at).select(F.lit(str(at)).alias("as_of"), "exception_id", "age_days", "age_factor", "priority_score")
        for at in fx.QUEUE_DATES
    ]
    return _whole(reduce(DataFrame.unionByName, tops), "age_days")


def exc_queue_fixed_sla(spark: SparkSession, sf: str) -> DataFrame:
    queue = fx.load(spark, sf, "fx_exception_queue")
    ranked = exceptions.ranked_queue(queue, _amount_tables(spark, sf), fx.EVENTS_AS_OF, sla_override=5)
    return ranked.select("exception_id", "age_factor", "priority_score")


# ids of the queue have six digits of an event's number, so from a million events on one may stand for several items
_ITEM = ("exception_id", "source", "priority", "status")


def exc_assign(spark: SparkSession, sf: str) -> DataFrame:
    queue = fx.load(spark, sf, "fx_exception_queue")
    owners = queue.where("status = 'open' AND lower(priority) = 'high'").select(*_ITEM).distinct().withColumn(
        "owner", F.concat(F.lit("team-"), "source")
    )
    return exceptions.assign(queue, owners, _ITEM).select("exception_id", "assigned_to", "status")


def exc_resolve(spark: SparkSession, sf: str) -> DataFrame:
    queue = fx.load(spark, sf, "fx_exception_queue")
    decisions = queue.where("status = 'in_progress'").select(*_ITEM).distinct().withColumns(
        {"root_cause": F.lit("bad feed"), "resolution_notes": F.concat(F.lit("was "), "priority")}
    )
    updated, _ = exceptions.resolve(queue, decisions, fx.EVENTS_AS_OF, _ITEM)
    return _text(updated.select("exception_id", "status", "resolved_at", "root_cause", "resolution_notes"))


def mart_exception_aging(spark: SparkSession, sf: str) -> DataFrame:
    queue = fx.load(spark, sf, "fx_exception_queue")
    aged = marts.exception_aging(queue, _amount_tables(spark, sf), fx.EVENTS_AS_OF)
    return _whole(_text(aged), "age_days", "sla_days")


def staging_exception_queue(spark: SparkSession, sf: str) -> DataFrame:
    return stage("exception_queue", fx.load(spark, sf, "fx_exception_queue")).select(
        "exception_id", "reference_id", "ref_dataset", "ref_record_id", "priority", "status"
    )


# -- enrollment ------------------------------------------------------------ #


def _enrolled(spark: SparkSession, sf: str) -> enrollment.EnrollmentRun:
    return enrollment.run_enrollment(
        fx.load(spark, sf, "fx_pending_enrollments"), enrollment_rules(), fx.ENROLL_AS_OF
    )


def enroll_validate(spark: SparkSession, sf: str) -> DataFrame:
    return _enrolled(spark, sf).outcomes.select(
        "enrollment_id", "outcome", F.array_join("issues", "; ").alias("issues")
    )


def enroll_configured(spark: SparkSession, sf: str) -> DataFrame:
    """Enrollment by a settings file with a lower cap and a wider gate."""
    run = enrollment.run_enrollment(
        fx.load(spark, sf, "fx_pending_enrollments"), enrollment_rules(_SETTINGS / "tight_enrollment.yml"), fx.ENROLL_AS_OF
    )
    return run.outcomes.select("enrollment_id", "outcome", F.array_join("issues", "; ").alias("issues"))


def enroll_skip(spark: SparkSession, sf: str) -> DataFrame:
    """Every seventh enrollment is in the audit log and is not judged again."""
    pending = fx.load(spark, sf, "fx_pending_enrollments")
    log = pending.where("CAST(substr(enrollment_id, 5) AS INT) % 7 = 0").select(
        F.concat(F.lit("EVT-"), "enrollment_id", F.lit("-000001")).alias("event_id")
    )
    run = enrollment.run_enrollment(pending, enrollment_rules(), fx.ENROLL_AS_OF, log, within_batch=False)
    return run.outcomes.select("enrollment_id", "outcome")


def enroll_csv(spark: SparkSession, sf: str) -> DataFrame:
    """Enrollments read from CSV, judged in the order of the files."""
    path = new_path(spark, "csv")
    files.write_csv(fx.load(spark, sf, "fx_pending_enrollments").select(*ENROLLMENT_COLUMNS).orderBy("enrollment_id"), path)
    rows = files.read_enrollments(spark, path)
    run = enrollment.run_enrollment(rows, enrollment_rules(), fx.ENROLL_AS_OF, order="file_order")
    return run.outcomes.select("enrollment_id", "outcome", F.array_join("issues", "; ").alias("issues"))


def enroll_dual_source(spark: SparkSession, sf: str) -> DataFrame:
    return _enrolled(spark, sf).evaluations.drop("evaluated_at")


def enroll_accepted(spark: SparkSession, sf: str) -> DataFrame:
    return _whole(_text(_enrolled(spark, sf).accepted), "term_months")


def enroll_mismatch(spark: SparkSession, sf: str) -> DataFrame:
    return _enrolled(spark, sf).exceptions.select("exception_id", "source", "reference_id", "priority", "status")


def enroll_events(spark: SparkSession, sf: str) -> DataFrame:
    return _enrolled(spark, sf).events.drop("ord")


def enroll_status_update(spark: SparkSession, sf: str) -> DataFrame:
    pending = fx.load(spark, sf, "fx_pending_enrollments")
    return enrollment.pending_status(pending, _enrolled(spark, sf).outcomes).select("enrollment_id", "status")


def enroll_summary(spark: SparkSession, sf: str) -> DataFrame:
    pending = fx.load(spark, sf, "fx_pending_enrollments")
    return enrollment.pending_counts(enrollment.pending_status(pending, _enrolled(spark, sf).outcomes))


def enroll_mismatch_view(spark: SparkSession, sf: str) -> DataFrame:
    run, tables = _enrolled(spark, sf), _amount_tables(spark, sf)
    view = exceptions.mismatch_view(run.exceptions, run.evaluations, tables, fx.ENROLL_AS_OF)
    return view.select(
        "exception_id", "enrollment_id", "amount_at_risk", "priority_score", "method_a_amount", "method_b_amount", "delta"
    )


def enroll_decide(spark: SparkSession, sf: str) -> DataFrame:
    run, pending = _enrolled(spark, sf), fx.load(spark, sf, "fx_pending_enrollments")
    choice = F.when(F.col("reference_id").endswith("0"), "accept_a").when(F.col("reference_id").endswith("5"), "accept_b")
    decisions = run.exceptions.select(
        "exception_id", F.coalesce(choice, F.lit("reject")).alias("decision"), F.lit("rounding").alias("root_cause")
    )
    made = enrollment.decide(decisions, run.exceptions, run.evaluations, pending, fx.ENROLL_AS_OF)
    return made.accepted.select("enrollment_id", "incentive_amount", F.col("term_months").cast("bigint"), "expected_payout")


# -- audit ----------------------------------------------------------------- #


def _loose_log(spark: SparkSession, sf: str) -> DataFrame:
    """Event rows whose ``previous_hash`` is the hash of the id before: hashing without the chain."""
    return fx.load(spark, sf, "fx_audit_events").select(
        F.concat(F.lit("EVT-B1-"), F.col("ord").cast("string")).alias("event_id"), "timestamp", "event_type", "actor",
        "entity_type", "entity_id", "action", F.sha2((F.col("ord") - 1).cast("string"), 256).alias("previous_hash"),
    ).withColumn("event_hash", event_hash())


def _chained(spark: SparkSession, sf: str) -> DataFrame:
    events = fx.load(spark, sf, "fx_audit_events")
    return audit.append(events, None, fx.EVENTS_AS_OF)


def audit_event_hash(spark: SparkSession, sf: str) -> DataFrame:
    return _loose_log(spark, sf).select("event_id", "event_hash")


def audit_append(spark: SparkSession, sf: str) -> DataFrame:
    return _chained(spark, sf).select("event_id", "previous_hash", "event_hash")


def audit_tip(spark: SparkSession, sf: str) -> DataFrame:
    return audit.chain_tip(_chained(spark, sf)).select("event_id")


def audit_verify(spark: SparkSession, sf: str) -> DataFrame:
    return audit.verify(_chained(spark, sf))


def audit_verify_altered(spark: SparkSession, sf: str) -> DataFrame:
    log = _chained(spark, sf)
    changed = F.when(F.col("entity_id").endswith("77"), F.lit("changed")).otherwise(F.col("action"))
    return audit.verify(log.withColumn("action", changed))


def audit_verify_removed(spark: SparkSession, sf: str) -> DataFrame:
    return audit.verify(_chained(spark, sf).where("entity_id <> 'E0'"))


def _sealed(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """The events in two appends, with blocks of 100 hashes."""
    events, seals = fx.load(spark, sf, "fx_audit_events"), sealed.no_seals(spark)
    parts = []
    for batch, keep in (("B1", "ord % 3 <> 0"), ("B2", "ord % 3 = 0")):
        rows, seal = sealed.append(events.where(keep).withColumn("batch_id", F.lit(batch)), seals, fx.EVENTS_AS_OF, width=100)
        parts.append(rows)
        seals = seals.unionByName(seal)
    return parts[0].unionByName(parts[1]), seals


def seal_append(spark: SparkSession, sf: str) -> DataFrame:
    return _sealed(spark, sf)[0].select("event_id", "previous_hash", "event_hash")


def seal_chain(spark: SparkSession, sf: str) -> DataFrame:
    return _sealed(spark, sf)[1]


def seal_verify(spark: SparkSession, sf: str) -> DataFrame:
    """The sound log, and logs with an event altered, rehashed, removed, and a seal changed."""
    log, seals = _sealed(spark, sf)
    changed = F.when(F.col("entity_id").endswith("77"), F.lit("changed")).otherwise(F.col("action"))
    rehashed = log.withColumn("action", changed).withColumn("event_hash", event_hash())
    cases = {
        "sound": (log, seals), "altered": (log.withColumn("action", changed), seals), "rehashed": (rehashed, seals),
        "removed": (log.where("event_id <> 'EVT-B2-000001'"), seals),
        "resealed": (log, seals.withColumn("root", F.when(F.col("append") == 1, F.sha2(F.lit("x"), 256)).otherwise(F.col("root")))),
    }
    return reduce(DataFrame.unionByName, [
        sealed.verify(*case, width=100).select(F.lit(name).alias("case"), "*") for name, case in cases.items()
    ])


def _chosen(log: DataFrame) -> DataFrame:
    return log.where("entity_id LIKE '%7'")


def seal_proof(spark: SparkSession, sf: str) -> DataFrame:
    """The blocks that lead from some events to their seals."""
    log, seals = _sealed(spark, sf)
    return sealed.proof_nodes(sealed.proof(log, seals, _chosen(log), width=100), seals, width=100)


def seal_proof_altered(spark: SparkSession, sf: str) -> DataFrame:
    """Proofs of sound and of altered events, of a proof with an exchanged hash, and against another seal."""
    log, seals = _sealed(spark, sf)
    own, rows = _chosen(log), materialize(sealed.proof(log, seals, _chosen(log), width=100), "proof")
    changed = own.withColumn("action", F.when(F.col("entity_id").endswith("77"), F.lit("changed")).otherwise(F.col("action")))
    exchanged = rows.withColumn("h", F.when((F.col("level") == 0) & (F.col("append") == 1), F.sha2("h", 256)).otherwise(F.col("h")))
    other = seals.withColumn("root", F.when(F.col("append") == 2, F.sha2("root", 256)).otherwise(F.col("root")))
    cases = {"sound": (own, rows, seals), "altered": (changed, rows, seals), "exchanged": (own, exchanged, seals), "resealed": (own, rows, other)}
    return reduce(DataFrame.unionByName, [
        sealed.verify_proof(*case, width=100).select(F.lit(name).alias("case"), "*") for name, case in cases.items()
    ])


class _Stopping(TableStore):
    """A store whose writer stops before its ``after``-th write."""

    def __init__(self, spark: SparkSession, root: str, after: int) -> None:
        super().__init__(spark, root)
        self.after = after

    def _put(self, *args) -> None:
        self.after -= 1
        if self.after < 0:
            raise InterruptedError("stopped")
        super()._put(*args)


def _rerun(spark: SparkSession, root: str, after: int, work: Callable[[TableStore], object]) -> TableStore:
    """``work`` stopped after so many writes, then run again."""
    try:
        work(_Stopping(spark, root, after))
    except InterruptedError:
        pass
    store = TableStore(spark, root)
    work(store)
    return store


def seal_recovered(spark: SparkSession, sf: str) -> DataFrame:
    """Two appends to a stored log, each stopped between events and seal and run again: the seals, and whether all verifies."""
    events, root = fx.load(spark, sf, "fx_audit_events"), new_path(spark, "store")

    def grow(store: TableStore, batch: str, keep: str) -> None:
        seals = store.read("audit_seals") if store.exists("audit_seals") else sealed.no_seals(spark)
        with store.job(batch):
            rows, seal = sealed.append(events.where(keep).withColumn("batch_id", F.lit(batch)), seals, fx.EVENTS_AS_OF, width=100)
            store.write("audit_event_log", rows)
            store.write("audit_seals", seal)

    for batch, keep in (("B1", "ord % 3 <> 0"), ("B2", "ord % 3 = 0")):
        store = _rerun(spark, root, 1, lambda s, b=batch, k=keep: grow(s, b, k))
    checked = sealed.verify(store.read("audit_event_log"), store.read("audit_seals"), width=100).first()
    return store.read("audit_seals").withColumns({"verified": F.lit(checked["verified"]), "event_count": F.lit(checked["event_count"])})


def enroll_replayed(spark: SparkSession, sf: str) -> DataFrame:
    """Enrollment stopped half way and before its last write, and run again: rows of every table, once each."""
    pending, kept = fx.load(spark, sf, "fx_pending_enrollments"), []
    for after in (4, 7):
        root = new_path(spark, "store")
        TableStore(spark, root).write("pending_enrollments", pending.withColumn("status", F.lit("pending")), "replace")
        store = _rerun(spark, root, after, lambda s: enroll_store(s, fx.ENROLL_AS_OF))
        tables = ("accepted_enrollments", "enrollment_dual_source_results", "exception_queue", "audit_event_log", "processed_enrollments")
        kept += [store.read(t).agg(F.lit(after).alias("stopped_after"), F.lit(t).alias("table"), F.count(F.lit(1)).alias("rows")) for t in tables]
        states = store.read("pending_enrollments").groupBy("status").agg(F.count(F.lit(1)).alias("rows"))
        kept.append(states.select(F.lit(after).alias("stopped_after"), F.concat(F.lit("pending_enrollments:"), "status").alias("table"), "rows"))
    return reduce(DataFrame.unionByName, kept)


def job_replayed(spark: SparkSession, sf: str) -> DataFrame:
    """Reconciliation stopped after its results were written, and run again: results and payment status."""
    root = new_path(spark, "store")
    tables = {t: fx.load(spark, sf, f"fx_{t}") for t in ("transactions", "payment_records")}
    TableStore(spark, root).write_many(tables, "replace")
    store = _rerun(spark, root, 1, lambda s: reconcile_store(s, BATCH, fx.ORDERS_AS_OF, _CFG))
    results = store.read("reconciliation_results").where("payment_id IS NOT NULL").select("payment_id", "match_status", "match_method", "exception_reason")
    return results.join(store.read("payment_records").select("payment_id", "status"), "payment_id")


def run_all_stages(spark: SparkSession, sf: str) -> DataFrame:
    """The whole job over the given tables, stopped in its quality stage and called again."""
    root = new_path(spark, "store")
    names = ("transactions", "payment_records", "accounts", "customers", "pending_enrollments")
    TableStore(spark, root).write_many({t: fx.load(spark, sf, f"fx_{t}") for t in names}, "replace")
    try:
        run_all(_Stopping(spark, root, 6), fx.ENROLL_AS_OF, "R1")
    except InterruptedError:
        pass
    return run_all(TableStore(spark, root), fx.ENROLL_AS_OF, "R1").select("stage", "ok", "items", "passed", "exceptions")


def _forked(log: DataFrame) -> DataFrame:
    """The log and an event that follows the first one of an entity ``...77`` beside its true successor."""
    at = log.where("entity_id LIKE '%77'").orderBy("event_id").limit(1)
    return log.unionByName(at.withColumns({"previous_hash": F.col("event_hash"), "event_id": F.lit("EVT-B1-900000")}).withColumn("event_hash", event_hash()))


def audit_verify_forked(spark: SparkSession, sf: str) -> DataFrame:
    return audit.verify(_forked(_chained(spark, sf)))


def audit_verify_orphaned(spark: SparkSession, sf: str) -> DataFrame:
    """Two events that follow each other and no event of the chain."""
    log = _chained(spark, sf)
    pair = log.where("event_id IN ('EVT-B1-000001', 'EVT-B1-000002')")
    first = F.col("event_id") == "EVT-B1-000001"
    ring = pair.withColumns({
        "event_id": F.concat(F.lit("EVT-R1-"), F.right("event_id", F.lit(6))),
        "previous_hash": F.when(first, "ring-2").otherwise("ring-1"), "event_hash": F.when(first, "ring-1").otherwise("ring-2"),
    })
    return audit.verify(log.unionByName(ring))


def audit_verify_batch(spark: SparkSession, sf: str) -> DataFrame:
    """The second batch of a chain alone, which begins after an event outside it; and a batch without events."""
    events = fx.load(spark, sf, "fx_audit_events")
    first = audit.append(events.where("ord % 2 = 0"), None, fx.EVENTS_AS_OF)
    second = audit.append(events.where("ord % 2 = 1").withColumn("batch_id", F.lit("B2")), first, fx.EVENTS_AS_OF)
    log = first.unionByName(second)
    return audit.verify(log, "B2").unionByName(audit.verify(log, "B9"))


def audit_batch_used(spark: SparkSession, sf: str) -> DataFrame:
    """Batch ids that a log holds are refused; a beginning of one is another id."""
    log, asked = _loose_log(spark, sf), []
    for batch in ("B1", "B", "B1-2"):
        try:
            audit.require_unused(log, batch)
            asked.append((batch, False))
        except audit.BatchIdInUse:
            asked.append((batch, True))
    return spark.createDataFrame(asked, "batch_id string, used boolean")


def audit_recent(spark: SparkSession, sf: str) -> DataFrame:
    return _text(audit.recent(_loose_log(spark, sf), 100))


def evidence_summary(spark: SparkSession, sf: str) -> DataFrame:
    return audit.recon_counts(_results(spark, sf))


def evidence_exceptions(spark: SparkSession, sf: str) -> DataFrame:
    queue = fx.load(spark, sf, "fx_exception_queue")
    return audit.exception_counts(audit.of_batch(queue, "DQ", "exception_id", "EXC"))


def evidence_files(spark: SparkSession, sf: str) -> DataFrame:
    """The exceptions of an evidence package, through JSON files and back."""
    queue, path = fx.load(spark, sf, "fx_exception_queue"), new_path(spark, "evidence")
    opened = audit.of_batch(queue, "DQ", "exception_id", "EXC")
    audit.write_evidence({"exceptions": opened, "exception_summary": audit.exception_counts(opened)}, path)
    back = spark.read.schema("exception_id string, reference_id string, priority string, assigned_to string, status string").json(f"{path}/exceptions")
    return back


def evidence_manifest(spark: SparkSession, sf: str) -> DataFrame:
    package = audit.evidence(
        _chained(spark, sf), _results(spark, sf), fx.load(spark, sf, "fx_exception_queue"), "B1", exported_at=fx.EVENTS_AS_OF
    )
    return package["manifest"].select(
        "batch_id", F.col("scope.audit_events_rows").alias("events"), F.col("verification.verified").alias("verified"),
        F.col("scope.event_timestamp_range")[0].alias("first_event"), F.col("scope.event_timestamp_range")[1].alias("last_event"),
    )


def audit_time_range(spark: SparkSession, sf: str) -> DataFrame:
    log = audit.of_batch(_loose_log(spark, sf), "B1")
    return _text(log.agg(F.min("timestamp").alias("first_event"), F.max("timestamp").alias("last_event")))


# -- sources and sinks ------------------------------------------------------ #


def staging_transactions(spark: SparkSession, sf: str) -> DataFrame:
    staged = stage("transactions", conform(fx.load(spark, sf, "fx_transactions"), "transactions"))
    return _text(staged.drop("value_date"))


def staging_payment_records(spark: SparkSession, sf: str) -> DataFrame:
    staged = stage("payment_records", conform(fx.load(spark, sf, "fx_payment_records"), "payment_records"))
    return _text(staged.drop("direction", "counterparty", "expected_posting_date"))


def staging_pending_enrollments(spark: SparkSession, sf: str) -> DataFrame:
    staged = stage("pending_enrollments", conform(fx.load(spark, sf, "fx_pending_enrollments"), "pending_enrollments"))
    return _text(staged.drop("created_at"))


def staging_reconciliation_results(spark: SparkSession, sf: str) -> DataFrame:
    return _text(stage("reconciliation_results", conform(_results(spark, sf), "reconciliation_results")))


def staging_dq_results(spark: SparkSession, sf: str) -> DataFrame:
    return _whole(_text(stage("dq_results", conform(_dq_rows(spark, sf), "dq_results"))), "failing_records")


def source_file_filter(spark: SparkSession, sf: str) -> DataFrame:
    return files.payments_of_file(fx.load(spark, sf, "fx_payment_records"), "FILE-0001").select("payment_id", "amount")


def store_replace_and_append(spark: SparkSession, sf: str) -> DataFrame:
    """Written, replaced by a part of itself, and appended to."""
    store, accounts = TableStore(spark, new_path(spark, "store")), fx.load(spark, sf, "fx_accounts")
    store.write("accounts", accounts, "replace")
    store.write("accounts", store.read("accounts").where("status = 'active'"), "replace")
    store.write("accounts", accounts.where("status <> 'active'"), "append")
    return store.read("accounts").select("account_id", "account_type", "current_balance", "status")


def store_versions(spark: SparkSession, sf: str) -> DataFrame:
    """Replaced five times with two versions kept; several tables at once; counts and a limit."""
    store, accounts = TableStore(spark, new_path(spark, "store"), keep=2), fx.load(spark, sf, "fx_accounts")
    for part in range(5):
        store.write("accounts", accounts.where(F.expr(f"CAST(substr(account_id, 6) AS INT) % 5 = {part}")), "replace")
    store.write_many({"accounts": accounts, "customers": fx.load(spark, sf, "fx_customers")}, "append")
    kept = [n for n, finished in store.versions("accounts") if finished]
    rows = [(t, store.count(t), store.read(t, limit=3).count()) for t in ("accounts", "customers", "transactions")]
    return spark.createDataFrame([(*r, str(kept) if r[0] == "accounts" else None) for r in rows], "table string, n bigint, limited bigint, kept string")


def store_utc(spark: SparkSession, sf: str) -> DataFrame:
    """Instants are stored as UTC without a zone."""
    store = TableStore(spark, new_path(spark, "store"))
    events = spark.read.parquet(f"{sf}/events.parquet").select("event_id", F.col("ts").cast("timestamp").alias("at"))
    store.write("instants", events.where("event_id IS NOT NULL"), "replace")
    return _text(store.read("instants"))


def store_query(spark: SparkSession, sf: str) -> DataFrame:
    store = TableStore(spark, new_path(spark, "store"))
    store.write("transactions", fx.load(spark, sf, "fx_transactions"), "replace")
    sql = "SELECT status, count(*) AS n, round(sum(amount), 2) AS total FROM transactions WHERE amount > :least AND created_at < :until GROUP BY status"
    return store.query(sql, {"least": 1000.0, "until": fx.ORDERS_AS_OF})


def csv_payments(spark: SparkSession, sf: str) -> DataFrame:
    path = new_path(spark, "csv")
    files.write_csv(fx.load(spark, sf, "fx_payment_records"), path)
    return _text(files.read_payments(spark, path).select("payment_id", "reference_id", "amount", "currency", "payment_date"))


def enroll_stream(spark: SparkSession, sf: str) -> DataFrame:
    """Enrollment files through the streaming intake; entities are not compared within a file."""
    folder, store = new_path(spark, "intake"), TableStore(spark, new_path(spark, "store"))
    files.write_csv(fx.load(spark, sf, "fx_pending_enrollments").select(*ENROLLMENT_COLUMNS), folder)
    query = start_intake(store, folder, new_path(spark, "stream"), fx.ENROLL_AS_OF)
    query.awaitTermination()
    return store.read("accepted_enrollments").select("enrollment_id", "entity_id", "incentive_amount", "expected_payout")


# -- data tests ------------------------------------------------------------ #


def data_tests(spark: SparkSession, sf: str) -> DataFrame:
    tables = {
        "transactions": fx.load(spark, sf, "fx_transactions"), "payment_records": fx.load(spark, sf, "fx_payment_records"),
        "exception_queue": fx.load(spark, sf, "fx_exception_queue"),
        "pending_enrollments": fx.load(spark, sf, "fx_pending_enrollments"),
    }
    return datatests.run_all_tests(tables)


def data_tests_marts(spark: SparkSession, sf: str) -> DataFrame:
    results, queue = _results(spark, sf), fx.load(spark, sf, "fx_exception_queue")
    return datatests.run_all_tests({
        "mart_recon_summary": marts.recon_summary(results),
        "mart_dq_summary": marts.dq_summary(_dq_rows(spark, sf), dq_config().type_weights),
        "mart_exception_aging": marts.exception_aging(queue, _amount_tables(spark, sf), fx.EVENTS_AS_OF),
    })


def data_tests_defects(spark: SparkSession, sf: str) -> DataFrame:
    """The same tests over marts with repeated rows, missing keys and scores, wrong names and impossible rates."""
    recon = marts.recon_summary(_results(spark, sf))
    recon = recon.unionByName(recon.withColumn("reconciliation_rate", F.col("reconciliation_rate") + 100.5)).unionByName(
        recon.withColumns({"batch_id": F.lit(None).cast("string"), "ledger_coverage_rate": F.lit(-1.0)})
    )
    checks = marts.dq_summary(_dq_rows(spark, sf), dq_config().type_weights)
    checks = checks.unionByName(checks.where("anomaly_rate IS NOT NULL")).unionByName(
        checks.where("checks_failed > 0").withColumn("dataset_name", F.lit(None).cast("string"))
    )
    aging = marts.exception_aging(fx.load(spark, sf, "fx_exception_queue"), _amount_tables(spark, sf), fx.EVENTS_AS_OF)
    aging = aging.unionByName(aging.where("status = 'resolved'")).withColumns({
        "amount_basis": F.when(F.col("priority") == "LOW", "guess").otherwise(F.col("amount_basis")),
        "priority_score": F.when((F.col("priority") != "low") | (F.col("status") != "resolved"), F.col("priority_score")),
        "exception_id": F.when((F.col("source") != "enrollment_dual_source") | (F.col("status") != "in_progress"), F.col("exception_id")),
    })
    return datatests.run_all_tests({"mart_recon_summary": recon, "mart_dq_summary": checks, "mart_exception_aging": aging})


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        recon_normalize, recon_long_references, recon_results, recon_unmatched_ledger, recon_summary, recon_status_update, recon_fuzzy_edges,
        recon_copies, recon_configured, recon_events, recon_breakdown, recon_control_totals, mart_recon_summary, mart_recon_kept, mart_aging_kept,
        dq_results, dq_kept, dq_routed, dq_routed_capped, dq_configured, dq_check_view, dq_events, dq_summary_totals, dq_zscore, dq_iqr, dq_referential, dq_range,
        dq_record_count, mart_dq_summary, dq_dataset_scores,
        exc_amount_at_risk, exc_queue, exc_queue_top, exc_queue_fixed_sla, exc_assign, exc_resolve, mart_exception_aging,
        staging_exception_queue,
        enroll_validate, enroll_configured, enroll_skip, enroll_csv, enroll_dual_source, enroll_accepted, enroll_mismatch, enroll_events, enroll_status_update,
        enroll_summary, enroll_mismatch_view, enroll_decide,
        audit_event_hash, audit_append, audit_tip, audit_verify, audit_verify_altered, audit_verify_removed,
        audit_recent, audit_time_range, audit_batch_used, seal_append, seal_chain, seal_verify, evidence_summary, evidence_exceptions, evidence_files, evidence_manifest,
        seal_proof, seal_proof_altered, seal_recovered, enroll_replayed, job_replayed, run_all_stages,
        audit_verify_forked, audit_verify_orphaned, audit_verify_batch,
        staging_transactions, staging_reconciliation_results, staging_dq_results, staging_payment_records, staging_pending_enrollments, source_file_filter,
        store_replace_and_append, store_versions, store_utc, store_query, csv_payments, enroll_stream,
        data_tests, data_tests_marts, data_tests_defects,
    )
}
