"""The twelve tables. Timestamps carry no zone and mean UTC."""

from __future__ import annotations

from pyspark.sql import types as T

# fixed values: table and column names and types
_TABLES = {
    "customers": "customer_id string, name string, email string, phone string, address string, "
    "customer_type string, created_at timestamp_ntz, status string",
    "accounts": "account_id string, customer_id string, account_type string, "
    "account_number_masked string, currency string, current_balance double, "
    "available_balance double, opened_at timestamp_ntz, status string",
    "transactions": "transaction_id string, account_id string, transaction_type string, "
    "amount double, currency string, posting_date date, value_date date, description string, "
    "reference_id string, created_at timestamp_ntz, status string",
    "payment_files": "file_id string, file_name string, received_at timestamp_ntz, "
    "record_count int, total_amount double, source_system string, status string",
    "payment_records": "payment_id string, file_id string, reference_id string, amount double, "
    "currency string, direction string, counterparty string, payment_date date, "
    "expected_posting_date date, status string",
    "reconciliation_results": "recon_id string, batch_id string, payment_id string, "
    "ledger_transaction_id string, match_status string, match_confidence double, "
    "match_method string, exception_reason string, reconciled_at timestamp_ntz, "
    "reconciled_by string",
    "dq_results": "dq_check_id string, dataset_name string, check_type string, check_name string, "
    "passed boolean, failing_records int, quality_score double, checked_at timestamp_ntz",
    "exception_queue": "exception_id string, source string, reference_id string, priority string, "
    "assigned_to string, status string, created_at timestamp_ntz, resolved_at timestamp_ntz, "
    "resolution_notes string, root_cause string",
    "audit_event_log": "event_id string, timestamp timestamp_ntz, event_type string, actor string, "
    "entity_type string, entity_id string, action string, previous_hash string, event_hash string",
    "pending_enrollments": "enrollment_id string, entity_id string, program_code string, "
    "enrollment_date timestamp_ntz, incentive_amount string, term_months string, region string, "
    "submitted_by string, status string, created_at timestamp_ntz",
    "accepted_enrollments": "enrollment_id string, entity_id string, program_code string, "
    "enrollment_date timestamp_ntz, incentive_amount double, term_months int, region string, "
    "submitted_by string, expected_payout double, accepted_at timestamp_ntz, batch_id string",
    "enrollment_dual_source_results": "result_id string, enrollment_id string, "
    "method_a_amount double, method_b_amount double, delta double, tolerance double, "
    "agreed boolean, evaluated_at timestamp_ntz",
}
# tables of the library's own: ids of enrollments that were processed, and the stages of a whole job
_OWN = {
    "processed_enrollments": "enrollment_id string",
    "mart_recon_counts": "batch_id string, match_status string, match_method string, rows bigint, reconciled_at timestamp_ntz, upto bigint, version string",
    "mart_exceptions": "exception_id string, source string, reference_id string, priority string, status string, created_at timestamp_ntz, "
    "resolved_at timestamp_ntz, amount double",
    "mart_marks": "mart string, upto bigint, versions string",
    "job_stages": "run_id string, stage string, ok boolean, items bigint, passed bigint, exceptions bigint, top_score double",
}

# fixed values: the columns an enrollment file carries, all read as text
ENROLLMENT_COLUMNS = (
    "enrollment_id", "entity_id", "program_code", "enrollment_date",
    "incentive_amount", "term_months", "region", "submitted_by",
)


_TYPES = {
    "string": T.StringType(), "double": T.DoubleType(), "int": T.IntegerType(), "boolean": T.BooleanType(),
    "bigint": T.LongType(), "date": T.DateType(), "timestamp_ntz": T.TimestampNTZType(),
}


def schema_of(table: str) -> T.StructType:
    columns = (c.split() for c in (_TABLES.get(table) or _OWN[table]).split(","))
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in columns])


def known(table: str) -> bool:
    return table in _TABLES or table in _OWN


def table_names() -> list[str]:
    return list(_TABLES)
