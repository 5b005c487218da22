"""DuckDB SQL giving the answers of the registered queries over the same Parquet tables."""

from __future__ import annotations

from .fixtures import QUEUE_DATES, with_clause

_RECON = with_clause("fx_transactions", "fx_payment_records") + """,
p AS (SELECT payment_id, upper(regexp_replace(coalesce(reference_id, ''), '[\\s\\-_]+', '', 'g')) AS ref, amount, currency,
             payment_date AS d, row_number() OVER (ORDER BY payment_id) AS seq FROM fx_payment_records),
l AS (SELECT transaction_id, upper(regexp_replace(coalesce(reference_id, ''), '[\\s\\-_]+', '', 'g')) AS ref, amount, currency,
             posting_date AS d FROM fx_transactions),
e AS (SELECT p.payment_id, p.seq, l.transaction_id FROM p JOIN l ON p.ref = l.ref AND p.currency = l.currency
      AND abs(p.amount - l.amount) <= 1.0 AND abs(date_diff('day', p.d, l.d)) <= 1),
ematch AS (SELECT transaction_id, min(seq) AS seq FROM e GROUP BY 1),
efirst AS (SELECT seq, min(transaction_id) AS transaction_id FROM e GROUP BY 1),
known AS (SELECT p.seq, bool_or(p.currency = l.currency AND coalesce(abs(p.amount - l.amount) <= 1.0, false)) AS agrees,
                 min(l.transaction_id) FILTER (WHERE l.transaction_id NOT IN (SELECT transaction_id FROM ematch)) AS free_link,
                 min(l.transaction_id) AS any_link
          FROM p JOIN l ON p.ref = l.ref GROUP BY 1),
fz AS (SELECT p.seq, l.transaction_id, (CAST(1 AS DOUBLE) - CAST(CASE WHEN length(p.ref) = length(l.ref) THEN 2 ELSE 1 END AS DOUBLE) / (length(p.ref) + length(l.ref))) AS score
       FROM p JOIN l ON p.currency = l.currency AND p.d BETWEEN l.d - 1 AND l.d + 1 AND abs(p.amount - l.amount) <= 1.0
       WHERE p.ref <> '' AND p.seq NOT IN (SELECT seq FROM efirst) AND p.seq NOT IN (SELECT seq FROM known WHERE NOT agrees)
         AND l.transaction_id NOT IN (SELECT transaction_id FROM ematch)
         AND levenshtein(p.ref, l.ref) = 1),
fbest AS (SELECT seq, max_by(transaction_id, (score, transaction_id)) AS transaction_id, max(score) AS score FROM fz WHERE score >= 0.85 GROUP BY 1),
fmatch AS (SELECT transaction_id, min(seq) AS seq FROM fbest GROUP BY 1),
matched AS (
  SELECT p.seq, p.payment_id, p.amount,
    coalesce(em.transaction_id, efirst.transaction_id, CASE WHEN NOT k.agrees THEN coalesce(k.free_link, k.any_link) END, fm.transaction_id) AS ledger_transaction_id,
    CASE WHEN em.seq IS NOT NULL OR fm.seq IS NOT NULL THEN 'matched' WHEN efirst.seq IS NOT NULL OR NOT k.agrees
         OR date_diff('day', p.d, DATE '1998-07-01') > 30 THEN 'exception' ELSE 'unmatched_payment' END AS match_status,
    CASE WHEN em.seq IS NOT NULL OR efirst.seq IS NOT NULL THEN CAST(1 AS DOUBLE) WHEN fm.seq IS NOT NULL THEN round(fb.score, 4) ELSE CAST(0 AS DOUBLE) END AS match_confidence,
    CASE WHEN em.seq IS NOT NULL THEN 'exact' WHEN fm.seq IS NOT NULL THEN 'fuzzy' END AS match_method,
    CASE WHEN em.seq IS NOT NULL OR fm.seq IS NOT NULL THEN NULL WHEN efirst.seq IS NOT NULL THEN 'duplicate' WHEN NOT k.agrees THEN 'amount_mismatch'
         WHEN date_diff('day', p.d, DATE '1998-07-01') > 30 THEN 'stale' END AS exception_reason
  FROM p LEFT JOIN ematch em USING (seq) LEFT JOIN efirst USING (seq) LEFT JOIN known k USING (seq)
    LEFT JOIN fmatch fm USING (seq) LEFT JOIN fbest fb USING (seq)),
unused AS (SELECT transaction_id, row_number() OVER (ORDER BY transaction_id) AS seq FROM l
           WHERE transaction_id NOT IN (SELECT ledger_transaction_id FROM matched WHERE match_status = 'matched')),
results AS (
  SELECT 'RECON-BATCH-001-' || lpad(CAST(seq AS VARCHAR), 6, '0') AS recon_id, 'BATCH-001' AS batch_id, payment_id, ledger_transaction_id,
         match_status, match_confidence, match_method, exception_reason, '1998-07-01 00:00:00' AS reconciled_at, 'system' AS reconciled_by FROM matched
  UNION ALL
  SELECT 'RECON-BATCH-001-L' || lpad(CAST(seq AS VARCHAR), 6, '0'), 'BATCH-001', NULL, transaction_id, 'unmatched_ledger', 0.0, NULL, NULL,
         '1998-07-01 00:00:00', 'system' FROM unused)
"""

# no tolerance, no window, no fuzzy step, stale after 60 days
_STRICT = (
    _RECON.replace("<= 1.0", "<= 0").replace("abs(date_diff('day', p.d, l.d)) <= 1)", "abs(date_diff('day', p.d, l.d)) <= 0)")
    .replace("WHERE score >= 0.85", "WHERE score >= 1.0").replace("DATE '1998-07-01') > 30", "DATE '1998-07-01') > 60")
)

_MART_RECON = """SELECT batch_id, count(*) FILTER (WHERE match_status <> 'unmatched_ledger') AS total,
  count(*) FILTER (WHERE match_status = 'matched') AS matched,
  count(*) FILTER (WHERE match_status NOT IN ('unmatched_ledger', 'matched')) AS exceptions,
  round(100 * CAST(count(*) FILTER (WHERE match_status = 'matched') AS DOUBLE) / nullif(count(*) FILTER (WHERE match_status <> 'unmatched_ledger'), 0), 2) AS reconciliation_rate,
  count(*) AS ledger_total, count(*) FILTER (WHERE match_status = 'unmatched_ledger') AS unmatched_ledger,
  round(100 * CAST(count(*) FILTER (WHERE match_status <> 'unmatched_ledger') AS DOUBLE) / count(*), 2) AS ledger_coverage_rate,
  max(reconciled_at) AS reconciled_at FROM results GROUP BY 1"""


def _check(place: int, dataset: str, seq: int, kind: str, name: str, severity: str, source: str, key: str, fails: str) -> str:
    return (
        f"SELECT {place} AS place, '{dataset}' AS dataset_name, {seq} AS seq, '{kind}' AS check_type, '{name}' AS check_name, "
        f"'{severity}' AS severity, {key} AS id, coalesce({fails}, false) AS fails FROM {source}"
    )


_AGE = "floor(date_diff('second', {c}, TIMESTAMP '1998-07-01 00:00:00') / CAST(86400 AS DOUBLE)) > 30"
_TX = ("fx_transactions", "transaction_id")
_CHECKS = [
    (0, "transactions", 1, "completeness", "No null reference ids", "high", *_TX, "reference_id IS NULL OR trim(reference_id) = ''"),
    (0, "transactions", 2, "completeness", "No null amounts", "high", *_TX, "amount IS NULL"),
    (0, "transactions", 3, "accuracy", "Amount non-negative", "high", *_TX, "amount IS NULL OR amount < 0"),
    (0, "transactions", 4, "accuracy", "Valid transaction type", "medium", *_TX, "transaction_type NOT IN ('debit', 'credit')"),
    (0, "transactions", 5, "accuracy", "Valid status", "medium", *_TX, "status NOT IN ('posted', 'pending', 'reversed')"),
    (0, "transactions", 6, "accuracy", "Account exists", "high", *_TX, "account_id NOT IN (SELECT account_id FROM fx_accounts)"),
    (0, "transactions", 7, "timeliness", "Not stale (>30d)", "low", *_TX, _AGE.format(c="created_at")),
    (0, "transactions", 8, "anomaly", "Amount z-score outliers", "low", *_TX,
     "abs(amount - (SELECT avg(amount) FROM fx_transactions)) / (SELECT stddev_pop(amount) FROM fx_transactions) > 3"),
    (1, "accounts", 1, "completeness", "No null customer ids", "high", "fx_accounts", "account_id", "customer_id IS NULL"),
    (1, "accounts", 2, "accuracy", "Valid account type", "medium", "fx_accounts", "account_id", "account_type NOT IN ('checking', 'savings', 'loan', 'credit_card')"),
    (1, "accounts", 3, "accuracy", "Valid status", "medium", "fx_accounts", "account_id", "status NOT IN ('active', 'closed')"),
    (1, "accounts", 4, "consistency", "Available <= current (non-loan)", "high", "fx_accounts", "account_id", "account_type <> 'loan' AND available_balance > current_balance"),
    (2, "customers", 1, "completeness", "No null emails", "medium", "fx_customers", "customer_id", "trim(email) = ''"),
    (2, "customers", 2, "accuracy", "Valid customer type", "low", "fx_customers", "customer_id", "customer_type NOT IN ('individual', 'business')"),
    (3, "payment_records", 1, "completeness", "No null reference ids", "high", "fx_payment_records", "payment_id", "trim(reference_id) = ''"),
    (3, "payment_records", 2, "accuracy", "Amount non-negative", "high", "fx_payment_records", "payment_id", "amount IS NULL OR amount < 0"),
    (3, "payment_records", 3, "timeliness", "Not stale (>30d)", "low", "fx_payment_records", "payment_id", _AGE.format(c="CAST(payment_date AS TIMESTAMP)")),
]
_DQ = with_clause("fx_accounts", "fx_customers", "fx_transactions", "fx_payment_records") + ",\nflags AS (" + "\nUNION ALL ".join(
    _check(*c) for c in _CHECKS
) + """),
dq AS (SELECT place, 'DQ-' || dataset_name || '-' || lpad(CAST(seq AS VARCHAR), 4, '0') AS dq_check_id, dataset_name, check_type, check_name,
              count(*) FILTER (WHERE fails) = 0 AS passed, count(*) FILTER (WHERE fails) AS failing_records,
              round(100 * CAST(count(*) FILTER (WHERE NOT fails) AS DOUBLE) / count(*), 4) AS quality_score, '1998-07-01 00:00:00' AS checked_at
       FROM flags GROUP BY place, dataset_name, seq, check_type, check_name),
listed AS (SELECT *, row_number() OVER (PARTITION BY place, seq ORDER BY id) AS n FROM flags WHERE fails AND check_type <> 'anomaly'),
routed AS (SELECT 'EXC-DQ-001-' || lpad(CAST(row_number() OVER (ORDER BY place, seq, n) AS VARCHAR), 6, '0') AS exception_id, 'dq' AS source,
                  dataset_name || ':' || id AS reference_id, severity AS priority, 'open' AS status, check_name FROM listed),
typed AS (SELECT dataset_name, check_type, avg(quality_score) AS s, CASE check_type WHEN 'anomaly' THEN 0 ELSE 1 END AS w FROM dq GROUP BY 1, 2)
"""

_EXC = with_clause("fx_transactions", "fx_payment_records", "fx_pending_enrollments", "fx_exception_queue") + """,
q AS (SELECT *, split_part(reference_id, ':', 1) AS ds, CASE WHEN contains(reference_id, ':') THEN substr(reference_id, instr(reference_id, ':') + 1) END AS rid
      FROM fx_exception_queue),
a AS (SELECT q.*, CASE ds WHEN 'transactions' THEN t.amount WHEN 'payment_records' THEN p.amount
                          WHEN 'pending_enrollments' THEN try_cast(trim(n.incentive_amount) AS DOUBLE) END AS amt
      FROM q LEFT JOIN fx_transactions t ON ds = 'transactions' AND rid = t.transaction_id
             LEFT JOIN fx_payment_records p ON ds = 'payment_records' AND rid = p.payment_id
             LEFT JOIN fx_pending_enrollments n ON ds = 'pending_enrollments' AND rid = n.enrollment_id),
f AS (SELECT *, CASE WHEN amt IS NULL OR isnan(amt) THEN NULL ELSE amt END AS risk,
             CASE lower(priority) WHEN 'high' THEN 3 WHEN 'medium' THEN 7 WHEN 'low' THEN 14 ELSE 7 END AS sla,
             CAST(CASE lower(priority) WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END AS DOUBLE) AS weight,
             CAST(greatest(0, floor(date_diff('microsecond', created_at, TIMESTAMP '2024-02-01 00:00:00') / CAST(86400000000 AS DOUBLE))) AS BIGINT) AS age FROM a),
g AS (SELECT *, CAST(CASE WHEN risk IS NULL THEN 2.5 WHEN risk < 100 THEN 1 WHEN risk < 1000 THEN 2 WHEN risk < 10000 THEN 3 ELSE 4 END AS DOUBLE) AS factor,
             CAST(CASE WHEN age <= sla THEN 1 ELSE round(1 + 0.5 * (age - sla), 4) END AS DOUBLE) AS late FROM f)
"""

_ENROLL = with_clause("fx_pending_enrollments") + """,
t AS (SELECT *, trim(incentive_amount) AS atext, trim(term_months) AS mtext,
             CASE WHEN regexp_full_match(trim(incentive_amount), '[+-]?[0-9]+(\\.[0-9]*)?') THEN CAST(trim(incentive_amount) AS DECIMAL(18, 6)) END AS amt,
             CASE WHEN regexp_full_match(trim(term_months), '[+-]?[0-9]+') THEN CAST(trim(term_months) AS INTEGER) END AS term,
             CAST(enrollment_date AS DATE) AS d, min(enrollment_id) OVER (PARTITION BY trim(entity_id)) < enrollment_id AS again,
             CASE program_code WHEN 'STARTER' THEN 5000 WHEN 'GROWTH' THEN 25000 WHEN 'ENTERPRISE' THEN 100000 END AS cap,
             CASE program_code WHEN 'STARTER' THEN 1 WHEN 'GROWTH' THEN 6 WHEN 'ENTERPRISE' THEN 12 END AS lo,
             CASE program_code WHEN 'STARTER' THEN 12 WHEN 'GROWTH' THEN 36 WHEN 'ENTERPRISE' THEN 60 END AS hi
      FROM fx_pending_enrollments),
v AS (SELECT *, CASE WHEN trim(submitted_by) = '' THEN 'submitted_by: required field is missing or blank' ELSE concat_ws('; ',
        CASE WHEN cap IS NULL THEN 'program_code: ''' || program_code || ''' is not a configured program' END,
        CASE WHEN region NOT IN ('NORTHEAST', 'SOUTHEAST', 'MIDWEST', 'SOUTHWEST', 'WEST') THEN 'region: ''' || region || ''' is not a valid region' END,
        CASE WHEN again THEN 'entity_id: duplicate entity_id ''' || entity_id || ''' in this batch' END,
        CASE WHEN amt IS NULL THEN 'incentive_amount: ''' || atext || ''' is not a valid number' WHEN amt <= 0 THEN 'incentive_amount: incentive_amount must be > 0'
             WHEN amt > cap THEN 'incentive_amount: ' || atext || ' exceeds program ' || program_code || '''s cap (' || cap || ')' END,
        CASE WHEN term IS NULL THEN 'term_months: ''' || mtext || ''' is not a valid integer'
             WHEN term NOT BETWEEN lo AND hi THEN 'term_months: ' || term || ' is outside program ' || program_code || '''s range (' || lo || '-' || hi || ')' END,
        CASE WHEN d < DATE '2020-01-01' THEN 'enrollment_date: enrollment_date is before the earliest allowed date (2020-01-01)'
             WHEN d > DATE '2026-09-01' THEN 'enrollment_date: enrollment_date is in the future' END) END AS issues FROM t),
w AS (SELECT *, CAST(round(CAST(amt AS DOUBLE) / term * 100) AS BIGINT) * term AS a_cents, CAST(round(CAST(amt AS DOUBLE) * 100) AS BIGINT) AS b_cents FROM v),
o AS (SELECT *, CASE WHEN issues <> '' THEN 'rejected' WHEN abs(a_cents - b_cents) <= 1 THEN 'accepted' ELSE 'mismatch' END AS outcome FROM w)
"""

_AUDIT = with_clause("fx_audit_events") + """,
ev AS (SELECT *, row_number() OVER (ORDER BY ord) AS n, strftime(timestamp, '%Y-%m-%dT%H:%M:%S') ||
              CASE WHEN microsecond(timestamp) % 1000000 = 0 THEN '' ELSE strftime(timestamp, '.%f') END || '+00:00' AS iso FROM fx_audit_events),
body AS (SELECT *, '{"action": ' || CAST(to_json(action) AS VARCHAR) || ', "actor": ' || CAST(to_json(actor) AS VARCHAR) || ', "entity_id": ' || CAST(to_json(entity_id) AS VARCHAR)
              || ', "entity_type": "' || entity_type || '", "event_id": "EVT-B1-' AS head1, '", "event_type": "' || event_type || '", "previous_hash": "' AS head2,
              '", "timestamp": "' || iso || '"}' AS tail FROM ev)
"""

# two appends; three levels of blocks of 100 hashes
_SEALED = _AUDIT + """, s AS (SELECT *, CASE WHEN ord % 3 = 0 THEN 2 ELSE 1 END AS append FROM body),
t AS (SELECT *, row_number() OVER (PARTITION BY append ORDER BY ord) AS k FROM s),
named AS (SELECT *, 'EVT-B' || append || '-' || lpad(CAST(k AS VARCHAR), 6, '0') AS event_id, replace(head1, 'EVT-B1-', 'EVT-B' || append || '-') || lpad(CAST(k AS VARCHAR), 6, '0') || head2 AS head FROM t),
f AS (SELECT CAST(append AS BIGINT) AS append, entity_id, event_id, '' AS previous_hash, sha256(head || tail) AS event_hash FROM named WHERE append = 1),
fa AS (SELECT CAST(floor((pos - 1) / 100) AS BIGINT) AS b, sha256(string_agg(event_hash, '' ORDER BY pos)) AS h FROM (SELECT event_hash, row_number() OVER (ORDER BY event_id) AS pos FROM f) GROUP BY 1),
fb AS (SELECT CAST(floor(b / 100) AS BIGINT) AS b, CASE WHEN (SELECT count(*) FROM fa) = 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY b)) END AS h FROM fa GROUP BY 1),
fr AS (SELECT CASE WHEN (SELECT count(*) FROM fb) = 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY b)) END AS root, (SELECT count(*) FROM f) AS events FROM fb),
g AS (SELECT CAST(append AS BIGINT) AS append, entity_id, event_id, p AS previous_hash, sha256(head || p || tail) AS event_hash FROM named, (SELECT sha256(root) AS p FROM fr) WHERE append = 2),
ga AS (SELECT CAST(floor((pos - 1) / 100) AS BIGINT) AS b, sha256(string_agg(event_hash, '' ORDER BY pos)) AS h FROM (SELECT event_hash, row_number() OVER (ORDER BY event_id) AS pos FROM g) GROUP BY 1),
gb AS (SELECT CAST(floor(b / 100) AS BIGINT) AS b, CASE WHEN (SELECT count(*) FROM ga) = 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY b)) END AS h FROM ga GROUP BY 1),
gr AS (SELECT CASE WHEN (SELECT count(*) FROM gb) = 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY b)) END AS root, (SELECT count(*) FROM g) AS events FROM gb),
e2 AS (SELECT * FROM f UNION ALL SELECT * FROM g),
seals AS (SELECT CAST(1 AS BIGINT) AS append, '' AS previous_seal, root, events, sha256(root) AS seal FROM fr
  UNION ALL SELECT 2, p, root, events, sha256(p || root) FROM gr, (SELECT sha256(root) AS p FROM fr))
"""

_REPORT = "CAST(NULL AS VARCHAR) AS event_id, CAST(NULL AS VARCHAR) AS reason, CAST(NULL AS BIGINT) AS position"

ORACLES: dict[str, str] = {
    "recon_long_references": with_clause("fx_long_references") + """, s AS (SELECT transaction_id, length(a) + length(b) AS total,
      length(a) - 1 - CASE WHEN n % 3 = 0 THEN 1 ELSE 0 END - CASE WHEN n % 2 = 0 THEN 1 ELSE 0 END AS shared FROM fx_long_references)
      SELECT transaction_id, (CAST(1 AS DOUBLE) - CAST(total - 2 * shared AS DOUBLE) / total) * CAST(100 AS DOUBLE) / CAST(100 AS DOUBLE) AS similarity FROM s""",
    "recon_normalize": with_clause("fx_payment_records") + "SELECT payment_id, upper(regexp_replace(reference_id, '[\\s\\-_]+', '', 'g')) AS normalized FROM fx_payment_records",
    "recon_results": _RECON + "SELECT * FROM results",
    "recon_unmatched_ledger": _RECON + "SELECT transaction_id, seq FROM unused",
    "recon_summary": _RECON + """SELECT 'BATCH-001' AS batch_id, count(*) AS payments_processed, (SELECT count(*) FROM l) AS ledger_records_processed,
      count(*) FILTER (WHERE match_method = 'exact') AS matched_exact, count(*) FILTER (WHERE match_method = 'fuzzy') AS matched_fuzzy,
      count(*) FILTER (WHERE match_status = 'matched') AS matched_total, count(*) FILTER (WHERE match_status = 'unmatched_payment') AS unmatched_payment,
      count(*) FILTER (WHERE exception_reason = 'duplicate') AS exception_duplicate, count(*) FILTER (WHERE exception_reason = 'amount_mismatch') AS exception_amount_mismatch,
      count(*) FILTER (WHERE exception_reason = 'stale') AS exception_stale, count(*) FILTER (WHERE match_status = 'exception') AS exception_total,
      (SELECT count(*) FROM unused) AS unmatched_ledger, round(sum(amount) FILTER (WHERE match_status = 'matched'), 2) AS total_amount_reconciled,
      round(CAST(count(*) FILTER (WHERE match_status = 'matched') AS DOUBLE) / count(*), 4) AS reconciliation_rate FROM matched""",
    "recon_status_update": _RECON + "SELECT payment_id, CASE match_status WHEN 'matched' THEN 'matched' WHEN 'exception' THEN 'exception' ELSE 'unmatched' END AS status FROM matched",
    "recon_fuzzy_edges": _RECON + """SELECT p.payment_id, l.transaction_id,
      round(CAST(1 AS DOUBLE) - CAST(CASE WHEN length(p.ref) = length(l.ref) THEN 2 ELSE 1 END AS DOUBLE) / (length(p.ref) + length(l.ref)), 4) AS score
      FROM p JOIN l ON p.currency = l.currency AND p.d BETWEEN l.d - 1 AND l.d + 1 AND abs(p.amount - l.amount) <= 1.0
      WHERE p.ref NOT IN (SELECT ref FROM l) AND levenshtein(p.ref, l.ref) = 1""",
    "recon_copies": with_clause("fx_copied_payments", "fx_copied_ledger") + """,
      p AS (SELECT payment_id, split_part(reference_id, '-', 2) AS u, amount, payment_date AS d, row_number() OVER (PARTITION BY reference_id, amount, payment_date ORDER BY payment_id) AS k FROM fx_copied_payments),
      l AS (SELECT transaction_id, split_part(reference_id, '_', 2) AS u, amount, posting_date AS d, row_number() OVER (PARTITION BY reference_id, amount, posting_date ORDER BY transaction_id) AS k FROM fx_copied_ledger),
      j AS (SELECT p.payment_id, p.d, m.transaction_id AS own, f.transaction_id AS first_one,
                   p.u IN (SELECT u FROM l) AND (p.u, p.amount) NOT IN (SELECT (u, amount) FROM l) AS off
            FROM p LEFT JOIN l m USING (u, amount, d, k) LEFT JOIN l f ON f.u = p.u AND f.amount = p.amount AND f.d = p.d AND f.k = 1)
      SELECT payment_id, CASE WHEN own IS NOT NULL THEN 'matched' WHEN first_one IS NOT NULL OR off OR date_diff('day', d, DATE '2024-02-01') > 30 THEN 'exception' ELSE 'unmatched_payment' END AS match_status,
        CASE WHEN own IS NOT NULL THEN 'exact' END AS match_method,
        CASE WHEN own IS NOT NULL THEN NULL WHEN first_one IS NOT NULL THEN 'duplicate' WHEN off THEN 'amount_mismatch' WHEN date_diff('day', d, DATE '2024-02-01') > 30 THEN 'stale' END AS exception_reason,
        coalesce(own, first_one) AS ledger_transaction_id FROM j""",
    "recon_events": _RECON + """SELECT CASE match_status WHEN 'matched' THEN 'match' ELSE 'exception_open' END AS event_type,
      CASE match_status WHEN 'matched' THEN 'reconciliation' ELSE 'exception' END AS entity_type, 'RECON-BATCH-001-' || lpad(CAST(seq AS VARCHAR), 6, '0') AS entity_id,
      CASE match_status WHEN 'matched' THEN 'match' ELSE 'exception_open' END AS action, 'BATCH-001' AS batch_id FROM matched WHERE match_status IN ('matched', 'exception')""",
    "recon_breakdown": _RECON + """SELECT batch_id, 'status' AS kind, match_status AS name, count(*) AS rows FROM results GROUP BY ALL
      UNION ALL SELECT batch_id, 'method', match_method, count(*) FROM results WHERE match_method IS NOT NULL GROUP BY ALL""",
    "recon_control_totals": with_clause("fx_payment_records") + """, f AS (SELECT file_id, count(*) AS n, round(sum(amount), 2) AS total FROM fx_payment_records GROUP BY 1)
      SELECT file_id, n + CASE file_id WHEN 'FILE-0002' THEN 1 ELSE 0 END AS record_count, total AS total_amount, n AS found_count, total AS found_amount, file_id <> 'FILE-0002' AS agrees FROM f
      UNION ALL SELECT 'FILE-0003', 5, CAST(1 AS DOUBLE), 0, CAST(0 AS DOUBLE), false""",
    "recon_configured": _STRICT + "SELECT payment_id, match_status, match_method, exception_reason FROM matched",
    "dq_configured": with_clause("fx_accounts") + """, n AS (SELECT count(*) AS n, count(*) FILTER (WHERE current_balance IS NULL OR current_balance < 0 OR current_balance > 5000) AS bad FROM fx_accounts)
      SELECT 'Balance in range' AS check_name, bad = 0 AS passed, bad AS failing_records, round(100 * CAST(n - bad AS DOUBLE) / n, 4) AS quality_score, NULL AS warning, greatest(bad - 10, 0) AS withheld FROM n
      UNION ALL SELECT 'Owner named', true, 0, 100, 'no column no_such_column', 0
      UNION ALL SELECT 'Far too many', n = 7, CASE WHEN n = 7 THEN 0 ELSE n END, CASE WHEN n = 7 THEN 100 ELSE 0 END, NULL, 0 FROM n""",
    "dq_check_view": _DQ + "SELECT dataset_name, check_name, check_type, passed, failing_records, quality_score FROM dq",
    "enroll_configured": _ENROLL.replace("WHEN 'STARTER' THEN 5000", "WHEN 'STARTER' THEN 1100").replace("abs(a_cents - b_cents) <= 1", "abs(a_cents - b_cents) <= 5") + "SELECT enrollment_id, outcome, issues FROM o",
    "enroll_skip": _ENROLL.replace("min(enrollment_id) OVER (PARTITION BY trim(entity_id)) < enrollment_id AS again", "false AS again")
    + "SELECT enrollment_id, CASE WHEN CAST(substr(enrollment_id, 5) AS INTEGER) % 7 = 0 THEN 'skipped' ELSE outcome END AS outcome FROM o",
    "enroll_csv": _ENROLL + "SELECT enrollment_id, outcome, issues FROM o",
    "seal_append": _SEALED + "SELECT event_id, previous_hash, event_hash FROM e2",
    "seal_chain": _SEALED + "SELECT append, previous_seal, root, events, seal FROM seals",
    "seal_verify": _SEALED + """SELECT 'sound' AS "case", true AS verified, (SELECT count(*) FROM e2) AS event_count, CAST(2 AS BIGINT) AS appends, CAST(NULL AS BIGINT) AS append, CAST(NULL AS VARCHAR) AS event_id, CAST(NULL AS VARCHAR) AS reason
      UNION ALL SELECT 'altered', false, (SELECT count(*) FROM e2), 2, a.append, a.event_id, 'content_hash_mismatch' FROM (SELECT append, event_id FROM e2 WHERE entity_id LIKE '%77' ORDER BY append, event_id LIMIT 1) a
      UNION ALL SELECT 'rehashed', false, (SELECT count(*) FROM e2), 2, min(append), NULL, 'events_differ' FROM e2 WHERE entity_id LIKE '%77'
      UNION ALL SELECT 'removed', false, (SELECT count(*) - 1 FROM e2), 2, 2, NULL, 'events_differ'
      UNION ALL SELECT 'resealed', false, (SELECT count(*) FROM e2), 2, 1, NULL, 'seal_broken'""",
    "audit_batch_used": """SELECT b AS batch_id, EXISTS (SELECT 1 FROM events WHERE starts_with('EVT-B1-' || event_id, 'EVT-' || b || '-')
      AND regexp_full_match(substr('EVT-B1-' || event_id, length(b) + 6), '[0-9]+')) AS used FROM (VALUES ('B1'), ('B'), ('B1-2')) t(b)""",
    "evidence_files": with_clause("fx_exception_queue") + "SELECT exception_id, reference_id, priority, assigned_to, status FROM fx_exception_queue",
    "staging_reconciliation_results": _RECON + "SELECT * FROM results",
    "staging_dq_results": _DQ + "SELECT * EXCLUDE (place) FROM dq",
    "store_versions": with_clause("fx_accounts", "fx_customers") + """SELECT 'accounts' AS "table", (SELECT count(*) FROM fx_accounts) + (SELECT count(*) FROM fx_accounts WHERE CAST(substr(account_id, 6) AS INTEGER) % 5 = 4) AS n,
      CAST(3 AS BIGINT) AS limited, '[4, 5]' AS kept UNION ALL SELECT 'customers', (SELECT count(*) FROM fx_customers), 3, NULL UNION ALL SELECT 'transactions', 0, 0, NULL""",
    "store_utc": "SELECT event_id, CAST(ts AS VARCHAR) AS at FROM events",
    "mart_recon_summary": _RECON + _MART_RECON,
    "dq_results": _DQ + "SELECT * EXCLUDE (place) FROM dq",
    "dq_routed": _DQ + "SELECT * EXCLUDE (check_name) FROM routed",
    "dq_routed_capped": _DQ + """SELECT dataset_name, coalesce(r, 0) AS routed, coalesce(w, 0) AS withheld FROM (SELECT DISTINCT dataset_name FROM flags) LEFT JOIN (
      SELECT dataset_name, count(*) FILTER (WHERE n <= 25) AS r, count(*) FILTER (WHERE n > 25) AS w FROM listed GROUP BY 1) USING (dataset_name)""",
    "dq_events": _DQ + """SELECT 'exception_open' AS event_type, 'exception' AS entity_type, exception_id AS entity_id, 'exception_open:' || check_name AS action, 'DQ-001' AS batch_id FROM routed
      UNION ALL SELECT 'dq_check', 'dq_check', dq_check_id, check_name, 'DQ-001' FROM dq""",
    "dq_summary_totals": _DQ + """SELECT count(*) AS checks_run, count(*) FILTER (WHERE passed) AS checks_passed, count(*) FILTER (WHERE NOT passed) AS checks_failed,
      CAST(sum(failing_records) AS BIGINT) AS total_failing_records FROM dq""",
    "dq_zscore": _DQ + "SELECT transaction_id, amount FROM fx_transactions JOIN flags ON transaction_id = id AND place = 0 AND seq = 8 AND fails",
    "dq_iqr": with_clause("fx_transactions") + """, q AS (SELECT quantile_cont(amount, 0.25) AS a, quantile_cont(amount, 0.75) AS b FROM fx_transactions)
      SELECT transaction_id, amount FROM fx_transactions, q WHERE amount < a - 1.5 * (b - a) OR amount > b + 1.5 * (b - a)""",
    "dq_referential": with_clause("fx_transactions", "fx_accounts") + "SELECT transaction_id, account_id FROM fx_transactions WHERE account_id NOT IN (SELECT account_id FROM fx_accounts)",
    "dq_range": with_clause("fx_accounts") + "SELECT account_id, current_balance FROM fx_accounts WHERE current_balance < 0 OR current_balance > 9000",
    "dq_record_count": with_clause("fx_transactions") + """SELECT 'Expected count' AS check_name, count(*) = 15000 AS passed, CASE WHEN count(*) = 15000 THEN 0 ELSE count(*) END AS failing_records,
      CAST(CASE WHEN count(*) = 15000 THEN 100 ELSE 0 END AS DOUBLE) AS quality_score FROM fx_transactions""",
    "mart_dq_summary": _DQ + """SELECT dataset_name, coalesce(max(t.score), 100) AS quality_score, max(t.rate) AS anomaly_rate, count(*) AS checks_run,
      count(*) FILTER (WHERE passed) AS checks_passed, count(*) FILTER (WHERE NOT passed) AS checks_failed, CAST(sum(failing_records) AS BIGINT) AS total_failing_records,
      max(checked_at) AS checked_at FROM dq JOIN (SELECT dataset_name, round(sum(s * w) / nullif(sum(w), 0), 4) AS score,
      round(100 - max(s) FILTER (WHERE check_type = 'anomaly'), 4) AS rate FROM typed GROUP BY 1) t USING (dataset_name) GROUP BY 1""",
    "dq_dataset_scores": _DQ + """SELECT dataset_name, round(avg(s), 4) AS quality_score, round(100 - max(s) FILTER (WHERE check_type = 'anomaly'), 4) AS anomaly_rate,
      CAST(max(n) AS BIGINT) AS checks FROM typed JOIN (SELECT dataset_name, count(*) AS n FROM dq GROUP BY 1) USING (dataset_name) GROUP BY 1""",
    "exc_amount_at_risk": _EXC + "SELECT exception_id, round(risk, 2) AS amount_at_risk, CASE WHEN risk IS NULL THEN 'n/a' ELSE 'amount' END AS amount_basis, factor AS amount_at_risk_factor FROM g",
    "exc_queue": _EXC + """SELECT exception_id, source, reference_id, priority, status, age AS age_days, CAST(sla AS BIGINT) AS sla_days, round(risk, 2) AS amount_at_risk,
      CASE WHEN risk IS NULL THEN 'n/a' ELSE 'amount' END AS amount_basis, factor AS amount_at_risk_factor, late AS age_factor, round(weight * factor * late, 4) AS priority_score,
      CAST(created_at AS VARCHAR) AS created_at FROM g WHERE status = 'open'""",
    "exc_queue_top": " UNION ALL ".join(
        "SELECT * FROM (" + _EXC.replace("2024-02-01 00:00:00", str(at)) + f"""SELECT '{at}' AS as_of, exception_id, age AS age_days, late AS age_factor,
      round(weight * factor * late, 4) AS priority_score FROM g WHERE status = 'open' ORDER BY priority_score DESC, exception_id LIMIT 100)"""
        for at in QUEUE_DATES
    ),
    "exc_queue_fixed_sla": _EXC + """SELECT exception_id, CAST(CASE WHEN age <= 5 THEN 1 ELSE round(1 + 0.5 * (age - 5), 4) END AS DOUBLE) AS age_factor,
      round(weight * factor * CAST(CASE WHEN age <= 5 THEN 1 ELSE round(1 + 0.5 * (age - 5), 4) END AS DOUBLE), 4) AS priority_score FROM g""",
    "exc_assign": with_clause("fx_exception_queue") + """SELECT exception_id, CASE WHEN status = 'open' AND lower(priority) = 'high' THEN 'team-' || source END AS assigned_to,
      CASE WHEN status = 'open' AND lower(priority) = 'high' THEN 'in_progress' ELSE status END AS status FROM fx_exception_queue""",
    "exc_resolve": with_clause("fx_exception_queue") + """SELECT exception_id, CASE WHEN status = 'in_progress' THEN 'resolved' ELSE status END AS status,
      CASE WHEN status = 'in_progress' THEN '2024-02-01 00:00:00' END AS resolved_at, CASE WHEN status = 'in_progress' THEN 'bad feed' END AS root_cause,
      CASE WHEN status = 'in_progress' THEN 'was ' || priority END AS resolution_notes FROM fx_exception_queue""",
    "mart_exception_aging": _EXC + """SELECT exception_id, source, reference_id, priority, status, CAST(created_at AS VARCHAR) AS created_at, CAST(resolved_at AS VARCHAR) AS resolved_at,
      round(risk, 2) AS amount_at_risk, CASE WHEN risk IS NULL THEN 'n/a' ELSE 'amount' END AS amount_basis, weight AS severity_weight, CAST(sla AS BIGINT) AS sla_days, age AS age_days,
      late AS age_factor, factor AS amount_at_risk_factor, round(weight * factor * late, 4) AS priority_score FROM g""",
    "staging_exception_queue": _EXC + "SELECT exception_id, reference_id, ds AS ref_dataset, rid AS ref_record_id, priority, status FROM q",
    "enroll_validate": _ENROLL + "SELECT enrollment_id, outcome, issues FROM o",
    "enroll_dual_source": _ENROLL + """SELECT 'DSR-' || enrollment_id AS result_id, enrollment_id, a_cents / CAST(100 AS DOUBLE) AS method_a_amount, b_cents / CAST(100 AS DOUBLE) AS method_b_amount,
      abs(a_cents - b_cents) / CAST(100 AS DOUBLE) AS delta, CAST(0.01 AS DOUBLE) AS tolerance, abs(a_cents - b_cents) <= 1 AS agreed FROM o WHERE outcome <> 'rejected'""",
    "enroll_accepted": _ENROLL + """SELECT enrollment_id, entity_id, program_code, enrollment_date || ' 00:00:00' AS enrollment_date, CAST(amt AS DOUBLE) AS incentive_amount, CAST(term AS BIGINT) AS term_months,
      region, submitted_by, a_cents / CAST(100 AS DOUBLE) AS expected_payout, '2026-09-01 00:00:00' AS accepted_at, enrollment_id AS batch_id FROM o WHERE outcome = 'accepted'""",
    "enroll_mismatch": _ENROLL + """SELECT 'EXC-' || enrollment_id || '-000001' AS exception_id, 'enrollment_dual_source' AS source, 'pending_enrollments:' || enrollment_id AS reference_id,
      'medium' AS priority, 'open' AS status FROM o WHERE outcome = 'mismatch'""",
    "enroll_events": _ENROLL + """SELECT CASE outcome WHEN 'rejected' THEN 'enrollment_validate' WHEN 'accepted' THEN 'enrollment_accept' ELSE 'enrollment_mismatch' END AS event_type,
      'enrollment' AS entity_type, enrollment_id AS entity_id, CASE outcome WHEN 'rejected' THEN 'enrollment_rejected:' || issues WHEN 'accepted' THEN 'enrollment_accepted'
      ELSE 'enrollment_mismatch:delta=' || CAST(CAST(abs(a_cents - b_cents) AS DECIMAL(18, 2)) / 100 AS DECIMAL(18, 2)) END AS action, enrollment_id AS batch_id FROM o""",
    "enroll_status_update": _ENROLL + "SELECT enrollment_id, outcome AS status FROM o",
    "enroll_summary": _ENROLL + """SELECT count(*) AS total, count(*) FILTER (WHERE outcome = 'pending') AS pending, count(*) FILTER (WHERE outcome = 'accepted') AS accepted,
      count(*) FILTER (WHERE outcome = 'mismatch') AS mismatch, count(*) FILTER (WHERE outcome = 'rejected') AS rejected FROM o""",
    "enroll_mismatch_view": _ENROLL + """SELECT 'EXC-' || enrollment_id || '-000001' AS exception_id, enrollment_id, round(CAST(amt AS DOUBLE), 2) AS amount_at_risk,
      CAST(2 * CASE WHEN amt < 100 THEN 1 WHEN amt < 1000 THEN 2 WHEN amt < 10000 THEN 3 ELSE 4 END AS DOUBLE) AS priority_score, a_cents / CAST(100 AS DOUBLE) AS method_a_amount,
      b_cents / CAST(100 AS DOUBLE) AS method_b_amount, abs(a_cents - b_cents) / CAST(100 AS DOUBLE) AS delta FROM o WHERE outcome = 'mismatch'""",
    "enroll_decide": _ENROLL + """SELECT enrollment_id, CAST(amt AS DOUBLE) AS incentive_amount, CAST(term AS BIGINT) AS term_months,
      CASE WHEN enrollment_id LIKE '%0' THEN a_cents ELSE b_cents END / CAST(100 AS DOUBLE) AS expected_payout FROM o
      WHERE outcome = 'mismatch' AND (enrollment_id LIKE '%0' OR enrollment_id LIKE '%5')""",
    "audit_event_hash": _AUDIT + """SELECT 'EVT-B1-' || ord AS event_id, sha256(head1 || ord || head2 || sha256(CAST(ord - 1 AS VARCHAR)) || tail) AS event_hash FROM body""",
    "audit_append": _AUDIT.replace("WITH ", "WITH RECURSIVE ", 1) + """, numbered AS MATERIALIZED (SELECT n, head1 || lpad(CAST(n AS VARCHAR), 6, '0') || head2 AS head, tail FROM body),
      chain AS (SELECT CAST(0 AS BIGINT) AS n, '' AS previous_hash, '' AS event_hash
        UNION ALL SELECT c.n + 1, c.event_hash, sha256(b.head || c.event_hash || b.tail) FROM chain c JOIN numbered b ON b.n = c.n + 1)
      SELECT 'EVT-B1-' || lpad(CAST(n AS VARCHAR), 6, '0') AS event_id, previous_hash, event_hash FROM chain WHERE n > 0""",
    "audit_tip": "SELECT 'EVT-B1-' || lpad(CAST(count(*) AS VARCHAR), 6, '0') AS event_id FROM events",
    "audit_verify": f"SELECT true AS verified, count(*) AS event_count, CAST(NULL AS VARCHAR) AS batch_id, {_REPORT} FROM events",
    "audit_verify_altered": """SELECT false AS verified, count(*) AS event_count, CAST(NULL AS VARCHAR) AS batch_id,
      'EVT-B1-' || lpad(CAST(min(n) FILTER (WHERE event_id % 100 = 77) AS VARCHAR), 6, '0') AS event_id, 'content_hash_mismatch' AS reason,
      min(n) FILTER (WHERE event_id % 100 = 77) - 1 AS position FROM (SELECT event_id, row_number() OVER (ORDER BY event_id) AS n FROM events)""",
    "audit_verify_removed": """SELECT false AS verified, count(*) - 1 AS event_count, CAST(NULL AS VARCHAR) AS batch_id, CAST(NULL AS VARCHAR) AS event_id, 'no_genesis' AS reason,
      CAST(0 AS BIGINT) AS position FROM events""",
    "audit_recent": with_clause("fx_audit_events") + """SELECT 'EVT-B1-' || ord AS event_id, CAST(timestamp AS VARCHAR) AS timestamp, event_type, actor, entity_type, entity_id, action
      FROM fx_audit_events ORDER BY fx_audit_events.timestamp DESC, event_id DESC LIMIT 100""",
    "audit_time_range": "SELECT CAST(min(ts) AS VARCHAR) AS first_event, CAST(max(ts) AS VARCHAR) AS last_event FROM events",
    "evidence_summary": _RECON + """SELECT batch_id, count(*) AS total, count(*) FILTER (WHERE match_status = 'matched') AS matched,
      count(*) FILTER (WHERE match_status <> 'matched') AS exceptions FROM results GROUP BY 1""",
    "evidence_exceptions": with_clause("fx_exception_queue") + """SELECT count(*) AS total, count(*) FILTER (WHERE status = 'open') AS open, count(*) FILTER (WHERE status = 'in_progress') AS in_progress,
      count(*) FILTER (WHERE status = 'resolved') AS resolved FROM fx_exception_queue""",
    "evidence_manifest": "SELECT 'B1' AS batch_id, count(*) AS events, true AS verified, CAST(min(ts) AS VARCHAR) AS first_event, CAST(max(ts) AS VARCHAR) AS last_event FROM events",
    "staging_transactions": with_clause("fx_transactions") + """SELECT transaction_id, account_id, transaction_type, amount, currency, CAST(posting_date AS VARCHAR) AS posting_date,
      reference_id, CAST(created_at AS VARCHAR) AS created_at, status FROM fx_transactions""",
    "staging_payment_records": with_clause("fx_payment_records") + """SELECT payment_id, file_id, reference_id, amount, currency, CAST(payment_date AS VARCHAR) AS payment_date,
      status FROM fx_payment_records""",
    "staging_pending_enrollments": with_clause("fx_pending_enrollments") + """SELECT enrollment_id, entity_id, program_code, enrollment_date || ' 00:00:00' AS enrollment_date,
      incentive_amount, term_months, region, submitted_by, status FROM fx_pending_enrollments""",
    "source_file_filter": with_clause("fx_payment_records") + "SELECT payment_id, amount FROM fx_payment_records WHERE file_id = 'FILE-0001'",
    "store_replace_and_append": with_clause("fx_accounts") + "SELECT account_id, account_type, current_balance, status FROM fx_accounts",
    "store_query": with_clause("fx_transactions") + """SELECT status, count(*) AS n, round(sum(amount), 2) AS total FROM fx_transactions
      WHERE amount > 1000 AND created_at < TIMESTAMP '1998-07-01 00:00:00' GROUP BY 1""",
    "csv_payments": with_clause("fx_payment_records") + "SELECT payment_id, reference_id, amount, currency, CAST(payment_date AS VARCHAR) AS payment_date FROM fx_payment_records",
    "enroll_stream": _ENROLL.replace("min(enrollment_id) OVER (PARTITION BY trim(entity_id)) < enrollment_id AS again", "false AS again")
    + "SELECT enrollment_id, entity_id, CAST(amt AS DOUBLE) AS incentive_amount, a_cents / CAST(100 AS DOUBLE) AS expected_payout FROM o WHERE outcome = 'accepted'",
    "data_tests": with_clause("fx_transactions", "fx_payment_records", "fx_exception_queue", "fx_pending_enrollments") + "\nUNION ALL ".join(
        [
            f"SELECT '{t}' AS table_name, '{c}' AS column_name, 'not_null' AS test, count(*) FILTER (WHERE {c} IS NULL) AS failing_rows FROM fx_{t} "
            f"UNION ALL SELECT '{t}', '{c}', 'unique', (SELECT count(*) FROM (SELECT {c} FROM fx_{t} WHERE {c} IS NOT NULL GROUP BY 1 HAVING count(*) > 1))"
            for t, c in (
                ("transactions", "transaction_id"), ("payment_records", "payment_id"),
                ("exception_queue", "exception_id"), ("pending_enrollments", "enrollment_id"),
            )
        ]
        + [
            f"SELECT 'exception_queue', '{c}', 'accepted_values', count(*) FILTER (WHERE {c} NOT IN ({v})) FROM fx_exception_queue"
            for c, v in (("priority", "'high', 'medium', 'low'"), ("status", "'open', 'in_progress', 'resolved'"))
        ]
    ),
    "data_tests_marts": """SELECT * FROM (VALUES ('mart_recon_summary', 'batch_id', 'not_null'), ('mart_recon_summary', 'batch_id', 'unique'),
      ('mart_recon_summary', 'reconciliation_rate', 'percent'), ('mart_recon_summary', 'ledger_coverage_rate', 'percent'), ('mart_dq_summary', 'dataset_name', 'not_null'),
      ('mart_dq_summary', 'dataset_name', 'unique'), ('mart_exception_aging', 'exception_id', 'not_null'), ('mart_exception_aging', 'exception_id', 'unique'),
      ('mart_exception_aging', 'amount_basis', 'accepted_values'), ('mart_exception_aging', 'priority_score', 'not_null')) t(table_name, column_name, test), (SELECT CAST(0 AS BIGINT) AS failing_rows)""",
}

# the blocks above chosen events, from the hashes of the twin of the seals
_PROOF = _SEALED + """, leaves AS (SELECT append, entity_id, event_hash AS h, row_number() OVER (PARTITION BY append ORDER BY event_id) - 1 AS k FROM e2),
n0 AS (SELECT append, 0 AS level, CAST(k // 100 AS BIGINT) AS block, count(*) AS hashes, sha256(string_agg(h, '' ORDER BY k)) AS node, bool_or(entity_id LIKE '%7') AS kept FROM leaves GROUP BY 1, 3),
n1 AS (SELECT append, 1 AS level, CAST(block // 100 AS BIGINT) AS block, count(*) AS hashes, sha256(string_agg(node, '' ORDER BY block)) AS node, bool_or(kept) AS kept FROM n0 GROUP BY 1, 3 HAVING (SELECT count(*) FROM n0 z WHERE z.append = n0.append) > 1),
n2 AS (SELECT append, 2 AS level, CAST(block // 100 AS BIGINT) AS block, count(*) AS hashes, sha256(string_agg(node, '' ORDER BY block)) AS node, bool_or(kept) AS kept FROM n1 GROUP BY 1, 3 HAVING (SELECT count(*) FROM n1 z WHERE z.append = n1.append) > 1),
nodes AS (SELECT * FROM n0 UNION ALL SELECT * FROM n1 UNION ALL SELECT * FROM n2)
"""
_LATER = {k: v.replace("1998-07-01", "2026-09-01") for k, v in (("recon", _RECON), ("dq", _DQ))}
ORACLES |= {
    "dq_kept": ORACLES["dq_results"],
    "data_tests_defects": f"""WITH r AS ({_RECON} SELECT count(DISTINCT batch_id) AS n FROM results),
      d AS ({_DQ} SELECT count(DISTINCT dataset_name) FILTER (WHERE check_type = 'anomaly') AS again, count(DISTINCT dataset_name) FILTER (WHERE NOT passed) AS lost FROM dq),
      q AS ({with_clause("fx_exception_queue")} SELECT count(*) FILTER (WHERE status = 'resolved') AS again,
        count(*) FILTER (WHERE source = 'enrollment_dual_source' AND status = 'in_progress') AS lost,
        sum(CASE WHEN priority = 'LOW' THEN CASE status WHEN 'resolved' THEN 2 ELSE 1 END ELSE 0 END) AS odd,
        2 * count(*) FILTER (WHERE status = 'resolved' AND priority = 'low') AS unscored FROM fx_exception_queue),
      t AS (SELECT 'mart_recon_summary' AS table_name, 'batch_id' AS column_name, 'not_null' AS test, n AS failing_rows FROM r
      UNION ALL SELECT 'mart_recon_summary', 'batch_id', 'unique', n FROM r
      UNION ALL SELECT 'mart_recon_summary', 'reconciliation_rate', 'percent', n FROM r
      UNION ALL SELECT 'mart_recon_summary', 'ledger_coverage_rate', 'percent', n FROM r
      UNION ALL SELECT 'mart_dq_summary', 'dataset_name', 'not_null', lost FROM d UNION ALL SELECT 'mart_dq_summary', 'dataset_name', 'unique', again FROM d
      UNION ALL SELECT 'mart_exception_aging', 'exception_id', 'not_null', lost FROM q UNION ALL SELECT 'mart_exception_aging', 'exception_id', 'unique', again FROM q
      UNION ALL SELECT 'mart_exception_aging', 'amount_basis', 'accepted_values', odd FROM q UNION ALL SELECT 'mart_exception_aging', 'priority_score', 'not_null', unscored FROM q)
      SELECT table_name, column_name, test, CAST(failing_rows AS BIGINT) AS failing_rows FROM t""",
    "mart_recon_kept": ORACLES["mart_recon_summary"].replace(
        "max(reconciled_at) AS reconciled_at FROM results", "max(reconciled_at) AS reconciled_at FROM (FROM results UNION ALL SELECT * REPLACE ('BATCH-002' AS batch_id) FROM results)"
    ),
    "mart_aging_kept": ORACLES["mart_exception_aging"],
    "seal_proof": _PROOF + """SELECT append, level, block, hashes, node,
      level < (SELECT max(level) FROM nodes m WHERE m.append = nodes.append) OR node = (SELECT root FROM seals WHERE seals.append = nodes.append) AS sound FROM nodes WHERE kept""",
    "seal_proof_altered": _PROOF + """, c AS (SELECT count(*) AS events, count(*) FILTER (WHERE append = 1) AS first, count(*) FILTER (WHERE entity_id LIKE '%77') AS changed FROM leaves WHERE entity_id LIKE '%7'),
      b AS (SELECT count(*) FILTER (WHERE append = 1 AND level = 0) AS bottom FROM nodes WHERE kept)
      SELECT 'sound' AS "case", true AS verified, events, CAST(0 AS BIGINT) AS unproven, CAST(0 AS BIGINT) AS broken FROM c
      UNION ALL SELECT 'altered', changed = 0, events, changed, 0 FROM c
      UNION ALL SELECT 'exchanged', first = 0, events, first, bottom FROM c, b
      UNION ALL SELECT 'resealed', false, events, 0, 1 FROM c""",
    "seal_recovered": _SEALED + """SELECT append, previous_seal, root, events, seal, (SELECT sum(events) FROM seals) = (SELECT count(*) FROM e2) AS verified,
      (SELECT count(*) FROM e2) AS event_count FROM seals""",
    "enroll_replayed": _ENROLL + """, n AS (SELECT 'accepted_enrollments' AS "table", count(*) FILTER (WHERE outcome = 'accepted') AS rows FROM o
      UNION ALL SELECT 'enrollment_dual_source_results', count(*) FILTER (WHERE outcome <> 'rejected') FROM o
      UNION ALL SELECT 'exception_queue', count(*) FILTER (WHERE outcome = 'mismatch') FROM o
      UNION ALL SELECT t, count(*) FROM o, (VALUES ('audit_event_log'), ('processed_enrollments')) v(t) GROUP BY t
      UNION ALL SELECT 'pending_enrollments:' || outcome, count(*) FROM o GROUP BY outcome)
      SELECT stopped_after, "table", rows FROM n, (VALUES (4), (7)) s(stopped_after)""",
    "job_replayed": _RECON + """SELECT payment_id, match_status, match_method, exception_reason,
      CASE match_status WHEN 'matched' THEN 'matched' WHEN 'exception' THEN 'exception' ELSE 'unmatched' END AS status FROM matched""",
    "run_all_stages": f"""WITH r AS ({_LATER["recon"]} SELECT count(*) AS n, count(*) FILTER (WHERE match_status = 'matched') AS m, count(*) FILTER (WHERE match_status = 'exception') AS x FROM matched),
      q AS ({_LATER["dq"]} SELECT count(*) AS n, count(*) FILTER (WHERE passed) AS m, (SELECT count(*) FROM routed) AS x FROM dq),
      e AS ({_ENROLL} SELECT count(*) AS n, count(*) FILTER (WHERE outcome = 'accepted') AS m, count(*) FILTER (WHERE outcome = 'mismatch') AS x FROM o)
      SELECT 'reconcile' AS stage, true AS ok, n AS items, m AS passed, x AS exceptions FROM r
      UNION ALL SELECT 'quality', n = m, n, m, x FROM q UNION ALL SELECT 'enroll', true, n, m, x FROM e
      UNION ALL SELECT 'queue', true, q.x + e.x, NULL, NULL FROM q, e
      UNION ALL SELECT 'audit', true, r.m + r.x + q.n + q.x + e.n, NULL, NULL FROM r, q, e""",
    "audit_verify_forked": """SELECT false AS verified, count(*) + 1 AS event_count, CAST(NULL AS VARCHAR) AS batch_id,
      'EVT-B1-' || lpad(CAST(min(n) FILTER (WHERE event_id % 100 = 77) AS VARCHAR), 6, '0') AS event_id, 'chain_fork' AS reason,
      min(n) FILTER (WHERE event_id % 100 = 77) - 1 AS position FROM (SELECT event_id, row_number() OVER (ORDER BY event_id) AS n FROM events)""",
    "audit_verify_orphaned": """SELECT false AS verified, count(*) + 2 AS event_count, CAST(NULL AS VARCHAR) AS batch_id, CAST(NULL AS VARCHAR) AS event_id,
      'orphaned_events' AS reason, count(*) AS position FROM events""",
    "audit_verify_batch": with_clause("fx_audit_events") + f"""SELECT true AS verified, count(*) AS event_count, 'B2' AS batch_id, {_REPORT} FROM fx_audit_events WHERE ord % 2 = 1
      UNION ALL SELECT true, 0, 'B9', NULL, NULL, NULL""",
}
