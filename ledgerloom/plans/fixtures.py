"""Governance tables derived from the given star-schema tables, in SQL both Spark and DuckDB run."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

ORDERS_AS_OF = datetime(1998, 7, 1)
EVENTS_AS_OF = datetime(2024, 2, 1)
# days on which the queue is asked for its most urgent items: early, at midnight, at noon, late
QUEUE_DATES = (datetime(2024, 1, 9), datetime(2024, 1, 20), EVENTS_AS_OF, datetime(2024, 3, 5, 13, 30))
ENROLL_AS_OF = datetime(2026, 9, 1)

# each view's SQL and the tables it reads
VIEWS = {
    "fx_accounts": ("""
SELECT 'ACCT-' || lpad(CAST(c_custkey AS STRING), 8, '0') AS account_id,
       'CUST-' || lpad(CAST(c_custkey AS STRING), 8, '0') AS customer_id,
       CASE c_custkey % 4 WHEN 0 THEN 'checking' WHEN 1 THEN 'savings' WHEN 2 THEN 'loan' ELSE 'credit_card' END AS account_type,
       'USD' AS currency, c_acctbal AS current_balance,
       CASE WHEN c_custkey % 50 = 7 THEN c_acctbal + 10.0 ELSE c_acctbal - 10.0 END AS available_balance,
       CASE WHEN c_custkey % 97 = 5 THEN 'bogus' ELSE 'active' END AS status
FROM customer""", ("customer",)),
    "fx_customers": ("""
SELECT 'CUST-' || lpad(CAST(c_custkey AS STRING), 8, '0') AS customer_id,
       CASE WHEN c_custkey % 61 = 8 THEN ' ' ELSE 'c' || CAST(c_custkey AS STRING) || '@example.com' END AS email,
       CASE c_mktsegment WHEN 'BUILDING' THEN 'business' WHEN 'MACHINERY' THEN 'trust' ELSE 'individual' END AS customer_type
FROM customer""", ("customer",)),
    "fx_transactions": ("""
SELECT 'TXN-' || lpad(CAST(o_orderkey AS STRING), 8, '0') AS transaction_id,
       CASE WHEN o_orderkey % 211 = 9 THEN 'ACCT-MISSING' ELSE 'ACCT-' || lpad(CAST(o_custkey AS STRING), 8, '0') END AS account_id,
       CASE WHEN o_orderkey % 2 = 0 THEN 'debit' ELSE 'credit' END AS transaction_type,
       CASE WHEN o_orderkey % 499 = 11 THEN NULL WHEN o_orderkey % 997 = 12 THEN o_totalprice * 40 ELSE o_totalprice END AS amount,
       'USD' AS currency, CAST(o_orderdate AS DATE) AS posting_date,
       CASE WHEN o_orderkey % 401 = 17 THEN '  ' ELSE 'REF-T-' || lpad(CAST(o_orderkey AS STRING), 8, '0') END AS reference_id,
       o_orderdate AS created_at,
       CASE o_orderstatus WHEN 'F' THEN 'posted' WHEN 'O' THEN 'pending' ELSE 'reversed' END AS status
FROM orders""", ("orders",)),
    # two texts of more than 60 letters: b lacks one to three letters of a and has up to two marks that a never holds
    "fx_long_references": ("""
WITH t AS (SELECT o_orderkey AS n, 'TXN-' || lpad(CAST(o_orderkey AS STRING), 8, '0') AS transaction_id FROM orders),
     u AS (SELECT n, transaction_id, repeat(transaction_id, 7) AS a FROM t)
SELECT n, transaction_id, a,
       substr(a, 1, 9) || '~' || substr(a, 11, 20) || CASE WHEN n % 3 = 0 THEN '~' ELSE substr(a, 31, 1) END || substr(a, 32, 30)
       || CASE WHEN n % 2 = 0 THEN '' ELSE substr(a, 62, 1) END || substr(a, 63) AS b
FROM u""", ("orders",)),
    "fx_payment_records": ("""
WITH b AS (SELECT o_orderkey, o_totalprice, CAST(o_orderdate AS DATE) AS d, o_orderkey % 100 AS k,
                  'REF-T-' || lpad(CAST(o_orderkey AS STRING), 8, '0') AS ref
           FROM orders)
SELECT 'PMT-' || lpad(CAST(o_orderkey AS STRING), 8, '0') || '-1' AS payment_id,
       CASE WHEN o_orderkey % 3 = 0 THEN 'FILE-0002' ELSE 'FILE-0001' END AS file_id,
       CASE WHEN k = 1 THEN 'REF-UNMATCHED-' || CAST(o_orderkey AS STRING)
            WHEN k = 2 THEN substr(ref, 1, length(ref) - 1) || 'X' WHEN k = 6 THEN substr(ref, 1, length(ref) - 3) || substr(ref, length(ref) - 1)
            WHEN k = 7 THEN ref || 'Q' WHEN k = 8 THEN '  ' || replace(ref, '-', '_') ELSE lower(ref) END AS reference_id,
       CASE WHEN k = 4 THEN o_totalprice + 15.0 WHEN k = 2 THEN o_totalprice + 0.5 ELSE o_totalprice END AS amount,
       'USD' AS currency,
       CASE WHEN k = 2 THEN d + 1 WHEN k = 5 THEN d + 5 ELSE d END AS payment_date, 'unmatched' AS status
FROM b
UNION ALL
SELECT 'PMT-' || lpad(CAST(o_orderkey AS STRING), 8, '0') || '-2', 'FILE-0001', ref, o_totalprice, 'USD', d, 'unmatched'
FROM b WHERE k = 13""", ("orders",)),
    "fx_pending_enrollments": ("""
SELECT 'ENR-' || lpad(CAST(c_custkey AS STRING), 8, '0') AS enrollment_id,
       CASE WHEN c_custkey % 40 = 3 THEN 'ENT-DUP' ELSE 'ENT-' || lpad(CAST(c_custkey AS STRING), 8, '0') END AS entity_id,
       CASE WHEN c_custkey % 40 = 4 THEN 'NOPE' WHEN c_custkey % 3 = 0 THEN 'STARTER' WHEN c_custkey % 3 = 1 THEN 'GROWTH' ELSE 'ENTERPRISE' END AS program_code,
       CASE WHEN c_custkey % 40 = 5 THEN '2019-12-31' WHEN c_custkey % 40 = 6 THEN '2027-01-01' ELSE '2025-01-15' END AS enrollment_date,
       CASE WHEN c_custkey % 40 = 7 THEN '150 0.00' WHEN c_custkey % 40 = 8 THEN '-5.00' WHEN c_custkey % 40 = 9 THEN '900000.00'
            WHEN c_custkey % 5 = 0 THEN '1000.00' ELSE ' 1200.00 ' END AS incentive_amount,
       CASE WHEN c_custkey % 40 = 10 THEN 'x' WHEN c_custkey % 40 = 11 THEN '99' WHEN c_custkey % 5 = 0 AND c_custkey % 3 = 1 THEN '7' ELSE '12' END AS term_months,
       CASE WHEN c_custkey % 40 = 12 THEN 'MARS' ELSE 'WEST' END AS region,
       CASE WHEN c_custkey % 40 = 13 THEN '' ELSE 'operator-01' END AS submitted_by,
       'pending' AS status
FROM customer""", ("customer",)),
    "fx_exception_queue": ("""
SELECT 'EXC-DQ-' || lpad(CAST(event_id AS STRING), 6, '0') AS exception_id,
       CASE event_id % 5 WHEN 3 THEN 'enrollment_dual_source' ELSE 'dq' END AS source,
       CASE event_id % 5 WHEN 0 THEN 'transactions:TXN-' || lpad(CAST(event_id AS STRING), 8, '0')
            WHEN 1 THEN 'accounts:ACCT-' || lpad(CAST(event_id AS STRING), 8, '0')
            WHEN 2 THEN 'payment_records:PMT-' || lpad(CAST(event_id AS STRING), 8, '0') || '-1'
            WHEN 3 THEN 'pending_enrollments:ENR-' || lpad(CAST(event_id AS STRING), 8, '0') ELSE 'noprefix' END AS reference_id,
       CASE user_id % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' WHEN 2 THEN 'low' ELSE 'LOW' END AS priority,
       CAST(NULL AS STRING) AS assigned_to,
       CASE event_type WHEN 'error' THEN 'in_progress' WHEN 'signup' THEN 'resolved' ELSE 'open' END AS status,
       ts AS created_at, CAST(NULL AS TIMESTAMP) AS resolved_at,
       CAST(NULL AS STRING) AS resolution_notes, CAST(NULL AS STRING) AS root_cause
FROM events""", ("events",)),
    # many equal rows on both sides: payments and ledger rows of one user, amount and day are copies
    "fx_copied_payments": ("""
SELECT 'P' || lpad(CAST(event_id AS STRING), 10, '0') AS payment_id, 'user-' || CAST(user_id % 200 AS STRING) AS reference_id,
       CAST(event_id % 3 AS DOUBLE) * 10 AS amount, 'USD' AS currency, CAST(ts AS DATE) AS payment_date, 'unmatched' AS status
FROM events WHERE event_type IN ('purchase', 'click', 'error')""", ("events",)),
    "fx_copied_ledger": ("""
SELECT 'T' || lpad(CAST(event_id AS STRING), 10, '0') AS transaction_id, 'USER_' || CAST(user_id % 200 AS STRING) AS reference_id,
       CAST(event_id % 3 AS DOUBLE) * 10 AS amount, 'USD' AS currency, CAST(ts AS DATE) AS posting_date
FROM events WHERE event_type IN ('view', 'signup')""", ("events",)),
    "fx_audit_events": ("""
SELECT event_id AS ord, ts AS timestamp,
       CASE event_type WHEN 'purchase' THEN 'match' WHEN 'error' THEN 'exception_open' ELSE 'dq_check' END AS event_type,
       'user "' || CAST(user_id AS STRING) || '"' AS actor, 'event' AS entity_type,
       'E' || CAST(event_id AS STRING) AS entity_id, event_type || ':' || coalesce(props, '') AS action, 'B1' AS batch_id
FROM events""", ("events",)),
}

def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A fixture table over the Parquet files of ``sf_dir``."""
    for table in VIEWS[name][1]:
        spark.read.parquet(f"{sf_dir}/{table}.parquet").createOrReplaceTempView(table)
    found = spark.sql(VIEWS[name][0])
    return found.withColumns({
        c: found[c].cast("timestamp_ntz") for c, t in found.dtypes if t == "timestamp"
    })


def with_clause(*names: str) -> str:
    """The same tables as the head of a DuckDB query."""
    return "WITH " + ",\n".join(f"{n} AS ({VIEWS[n][0]})" for n in names)
