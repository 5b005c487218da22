"""The three marts."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.exceptions import scored_rows, with_amounts
from ..operators.quality import dataset_scores


def recon_summary(results: DataFrame) -> DataFrame:
    """Per batch: payment side and ledger side apart, rates in percent."""
    return recon_summary_of(results.withColumn("rows", F.lit(1)))


def recon_summary_of(counts: DataFrame) -> DataFrame:
    """The same from rows that stand for ``rows`` results each."""
    payment, matched = F.col("match_status") != "unmatched_ledger", F.col("match_status") == "matched"

    def of(kept: Column) -> Column:
        return F.coalesce(F.sum(F.when(kept, F.col("rows"))), F.lit(0)).cast("bigint")

    counted = counts.groupBy("batch_id").agg(
        of(payment).alias("total"), of(matched).alias("matched"), of(F.lit(True)).alias("ledger_total"),
        of(~payment).alias("unmatched_ledger"), F.max("reconciled_at").alias("reconciled_at"),
    )
    covered = F.col("ledger_total") - F.col("unmatched_ledger")
    return counted.select(
        "batch_id", "total", "matched", (F.col("total") - F.col("matched")).alias("exceptions"),
        F.when(F.col("total") > 0, F.round(F.lit(100.0) * F.col("matched") / F.col("total"), 2)).alias("reconciliation_rate"),
        "ledger_total", "unmatched_ledger",
        F.round(F.lit(100.0) * covered / F.col("ledger_total"), 2).alias("ledger_coverage_rate"), "reconciled_at",
    ).orderBy(F.desc("reconciled_at"), "batch_id")


def outcome_breakdown(results: DataFrame) -> DataFrame:
    """Per batch, rows by status and payments by method: (``batch_id``, ``kind``, ``name``, ``rows``)."""
    return outcome_breakdown_of(results.withColumn("rows", F.lit(1)))


def outcome_breakdown_of(counts: DataFrame) -> DataFrame:
    payment = F.col("match_status") != "unmatched_ledger"
    named = counts.select("batch_id", "rows", F.explode(F.filter(F.array(
        F.struct(F.lit("status").alias("kind"), F.col("match_status").alias("name")),
        F.when(payment & F.col("match_method").isNotNull(), F.struct(F.lit("method").alias("kind"), F.col("match_method").alias("name"))),
    ), lambda e: e.isNotNull())).alias("e"))
    return named.groupBy("batch_id", "e.kind", "e.name").agg(F.sum("rows").cast("bigint").alias("rows"))


def dq_summary(results: DataFrame, weights: dict[str, float]) -> DataFrame:
    totals = results.groupBy("dataset_name").agg(
        F.count(F.lit(1)).alias("checks_run"), F.count_if("passed").alias("checks_passed"),
        F.count_if(~F.col("passed")).alias("checks_failed"), F.sum("failing_records").alias("total_failing_records"),
        F.max("checked_at").alias("checked_at"),
    )
    return totals.join(dataset_scores(results, weights).drop("checks"), "dataset_name", "left").select(
        "dataset_name", "quality_score", "anomaly_rate", "checks_run", "checks_passed", "checks_failed",
        "total_failing_records", "checked_at",
    ).orderBy("dataset_name")


def exception_aging(queue: DataFrame, tables: dict[str, DataFrame], as_of: datetime) -> DataFrame:
    return exception_aging_of(with_amounts(queue, tables), as_of)


def exception_aging_of(rows: DataFrame, as_of: datetime) -> DataFrame:
    """The mart at a date from queue rows that carry their record's ``amount``: no join."""
    return scored_rows(rows, as_of).select(
        "exception_id", "source", "reference_id", "priority", "status", "created_at", "resolved_at", "amount_at_risk",
        "amount_basis", "severity_weight", "sla_days", "age_days", "age_factor", "amount_at_risk_factor", "priority_score",
    ).orderBy(F.desc("priority_score"), "exception_id")
