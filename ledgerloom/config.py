"""Settings of the jobs. Defaults are given here; each loader also reads a YAML file of the same shape."""

from __future__ import annotations

from dataclasses import dataclass, field
from decimal import Decimal
from pathlib import Path
from typing import Any

import yaml


@dataclass(frozen=True)
class ReconConfig:
    amount_tolerance: float = 1.0
    date_window_days: int = 1
    fuzzy_threshold: float = 0.85
    stale_days: int = 30


@dataclass(frozen=True)
class DQConfig:
    datasets: dict[str, dict[str, Any]] = field(default_factory=dict)
    type_weights: dict[str, float] = field(default_factory=dict)
    # None routes every failing row; a number keeps the first of each check and counts the rest as withheld
    max_exceptions_per_check: int | None = None


@dataclass(frozen=True)
class EnrollmentRules:
    programs: dict[str, dict[str, Any]]
    regions: list[str]
    min_enrollment_date: str | None = "2020-01-01"
    dual_source_tolerance: Decimal = Decimal("0.01")


# fixed values: the standard quality checks
DEFAULT_DQ = yaml.safe_load("""
type_weights: {completeness: 1.0, accuracy: 1.0, consistency: 1.0, timeliness: 1.0, anomaly: 0.0}
datasets:
  transactions:
    table: transactions
    id_field: transaction_id
    checks:
      - {type: completeness, name: "No null reference ids", field: reference_id, severity: high}
      - {type: completeness, name: "No null amounts", field: amount, severity: high}
      - {type: accuracy, name: "Amount non-negative", rule: range, field: amount, min: 0, severity: high}
      - {type: accuracy, name: "Valid transaction type", rule: enum, field: transaction_type, values: [debit, credit], severity: medium}
      - {type: accuracy, name: "Valid status", rule: enum, field: status, values: [posted, pending, reversed], severity: medium}
      - {type: accuracy, name: "Account exists", rule: referential, field: account_id, reference_dataset: accounts, reference_field: account_id, severity: high}
      - {type: timeliness, name: "Not stale (>30d)", field: created_at, max_age_days: 30, severity: low}
      - {type: anomaly, name: "Amount z-score outliers", rule: zscore, field: amount, threshold: 3.0, severity: low, route_failures: false}
  accounts:
    table: accounts
    id_field: account_id
    checks:
      - {type: completeness, name: "No null customer ids", field: customer_id, severity: high}
      - {type: accuracy, name: "Valid account type", rule: enum, field: account_type, values: [checking, savings, loan, credit_card], severity: medium}
      - {type: accuracy, name: "Valid status", rule: enum, field: status, values: [active, closed], severity: medium}
      - {type: consistency, name: "Available <= current (non-loan)", rule: available_le_current, severity: high}
  customers:
    table: customers
    id_field: customer_id
    checks:
      - {type: completeness, name: "No null emails", field: email, severity: medium}
      - {type: accuracy, name: "Valid customer type", rule: enum, field: customer_type, values: [individual, business], severity: low}
  payment_records:
    table: payment_records
    id_field: payment_id
    checks:
      - {type: completeness, name: "No null reference ids", field: reference_id, severity: high}
      - {type: accuracy, name: "Amount non-negative", rule: range, field: amount, min: 0, severity: high}
      - {type: timeliness, name: "Not stale (>30d)", field: payment_date, max_age_days: 30, severity: low}
""")

# fixed values: the standard enrollment programs
DEFAULT_ENROLLMENT = yaml.safe_load("""
programs:
  STARTER: {max_incentive_amount: 5000, term_months: {min: 1, max: 12}}
  GROWTH: {max_incentive_amount: 25000, term_months: {min: 6, max: 36}}
  ENTERPRISE: {max_incentive_amount: 100000, term_months: {min: 12, max: 60}}
regions: [NORTHEAST, SOUTHEAST, MIDWEST, SOUTHWEST, WEST]
min_enrollment_date: "2020-01-01"
dual_source_tolerance: 0.01
""")


def _read(path: str | Path) -> dict[str, Any]:
    with open(path, encoding="utf-8") as handle:
        return yaml.safe_load(handle) or {}


def recon_config(path: str | Path | None = None) -> ReconConfig:
    """Recon settings; the two older key names of tolerance and window are understood too."""
    raw = _read(path) if path and Path(path).exists() else {}
    base = ReconConfig()
    tolerance = raw.get("match_tolerance_amount", base.amount_tolerance)
    window = raw.get("match_date_window_days", base.date_window_days)
    return ReconConfig(
        amount_tolerance=float(raw.get("amount_tolerance", tolerance)),
        date_window_days=int(raw.get("date_window_days", window)),
        fuzzy_threshold=float(raw.get("fuzzy_threshold", base.fuzzy_threshold)),
        stale_days=int(raw.get("stale_days", base.stale_days)),
    )


def dq_config(path: str | Path | None = None) -> DQConfig:
    """Quality settings. A path that does not exist is an error, not an empty set of checks."""
    raw = _read(path) if path else DEFAULT_DQ
    cap = raw.get("max_exceptions_per_check")
    return DQConfig(
        datasets=raw.get("datasets", {}),
        type_weights=raw.get("type_weights", {}),
        max_exceptions_per_check=None if cap is None else int(cap),
    )


def enrollment_rules(path: str | Path | None = None) -> EnrollmentRules:
    raw = _read(path) if path else DEFAULT_ENROLLMENT
    earliest = raw.get("min_enrollment_date")
    return EnrollmentRules(
        programs=raw.get("programs", {}),
        regions=list(raw.get("regions", [])),
        min_enrollment_date=str(earliest) if earliest else None,
        dual_source_tolerance=Decimal(str(raw.get("dual_source_tolerance", "0.01"))),
    )
