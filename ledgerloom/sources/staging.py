"""Staging projections the marts read."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import schema_of

# fixed values: columns a staging view leaves out of its table
_LEFT_OUT = {"transactions": {"description"}}
STAGED = (
    "transactions",
    "payment_records",
    "reconciliation_results",
    "dq_results",
    "exception_queue",
    "pending_enrollments",
)


def split_reference(ref):
    """``dataset:record`` apart at the first colon; without a colon there is no record."""
    parts = F.split(ref, ":", 2)
    return parts[0], F.when(F.size(parts) > 1, F.get(parts, F.lit(1)))


def stage(table: str, df: DataFrame) -> DataFrame:
    wanted = [f.name for f in schema_of(table) if f.name not in _LEFT_OUT.get(table, set())]
    staged = df.select(*wanted)
    if table == "exception_queue":
        dataset, record = split_reference(F.col("reference_id"))
        staged = staged.select(
            "exception_id", "source", "reference_id", dataset.alias("ref_dataset"),
            record.alias("ref_record_id"), *wanted[3:],
        )
    return staged


def register(tables: dict[str, DataFrame]) -> None:
    for name in STAGED:
        if name in tables:
            stage(name, tables[name]).createOrReplaceTempView(f"stg_{name}")
