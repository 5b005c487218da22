"""Data tests: each names a rule, a table and a column, and counts the rows that break it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: the tests of the staging views
STAGING_TESTS = {
    "transactions": {"transaction_id": ("not_null", "unique")},
    "payment_records": {"payment_id": ("not_null", "unique")},
    "reconciliation_results": {
        "recon_id": ("not_null", "unique"),
        "match_status": (["matched", "unmatched_payment", "unmatched_ledger", "exception"],),
    },
    "dq_results": {
        "dq_check_id": ("not_null", "unique"),
        "check_type": (["completeness", "accuracy", "consistency", "timeliness", "anomaly"],),
    },
    "exception_queue": {
        "exception_id": ("not_null", "unique"),
        "priority": (["high", "medium", "low"],),
        "status": (["open", "in_progress", "resolved"],),
    },
    "pending_enrollments": {"enrollment_id": ("not_null", "unique")},
}
# fixed values: the tests of the marts
MART_TESTS = {
    "mart_recon_summary": {
        "batch_id": ("not_null", "unique"), "reconciliation_rate": ("percent",), "ledger_coverage_rate": ("percent",),
    },
    "mart_dq_summary": {"dataset_name": ("not_null", "unique")},
    "mart_exception_aging": {
        "exception_id": ("not_null", "unique"), "amount_basis": (["amount", "n/a"],), "priority_score": ("not_null",),
    },
}


def _row_rule(column: str, rule: str | list[str]) -> Column:
    value = F.col(column)
    if rule == "not_null":
        return value.isNull()
    if rule == "percent":
        return value.isNotNull() & ~value.between(0, 100)
    return value.isNotNull() & ~value.cast("string").isin(rule)


def _name(rule: str | list[str]) -> str:
    return "accepted_values" if isinstance(rule, list) else rule


def run_tests(table: str, df: DataFrame, tests: dict[str, tuple]) -> DataFrame:
    """(``table_name``, ``column_name``, ``test``, ``failing_rows``): row rules in one pass, ``unique`` by grouping."""
    row_rules = [(c, r) for c, rules in tests.items() for r in rules if r != "unique"]
    found = []
    if row_rules:
        counts = [F.count_if(_row_rule(c, r)).alias(f"_{i}") for i, (c, r) in enumerate(row_rules)]
        listed = F.array(*[
            F.struct(F.lit(c).alias("column_name"), F.lit(_name(r)).alias("test"), F.col(f"_{i}").alias("failing_rows"))
            for i, (c, r) in enumerate(row_rules)
        ])
        found.append(df.agg(*counts).select(F.explode(listed).alias("t")).select("t.*"))
    for column, rules in tests.items():
        if "unique" in rules:
            repeated = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
            found.append(repeated.agg(F.count(F.lit(1)).alias("failing_rows")).select(
                F.lit(column).alias("column_name"), F.lit("unique").alias("test"), "failing_rows"
            ))
    return reduce(DataFrame.unionByName, found).select(F.lit(table).alias("table_name"), "*")


def run_all_tests(tables: dict[str, DataFrame]) -> DataFrame:
    known = {**STAGING_TESTS, **MART_TESTS}
    return reduce(DataFrame.unionByName, [run_tests(n, df, known[n]) for n, df in tables.items() if n in known])


def control_totals(files: DataFrame, payments: DataFrame) -> DataFrame:
    """Payment files against their records: stated and found count and total."""
    found = payments.groupBy("file_id").agg(
        F.count(F.lit(1)).alias("found_count"), F.round(F.sum("amount"), 2).alias("found_amount")
    )
    both = files.select("file_id", "record_count", "total_amount").join(found, "file_id", "left")
    return both.withColumns({
        "found_count": F.coalesce("found_count", F.lit(0)), "found_amount": F.coalesce("found_amount", F.lit(0.0)),
    }).withColumn(
        "agrees", (F.col("record_count") == F.col("found_count")) & (F.abs(F.col("total_amount") - F.col("found_amount")) < 0.005)
    )
