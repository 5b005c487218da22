"""Marts of a table store kept up by change: a refresh reads what commits since the last one have written.

``mart_recon_counts`` holds rows by batch, status and method for every refresh; counts add up, so a refresh counts the newly appended
results alone. ``mart_exceptions`` is the queue with the amount at risk, in the queue's parts; a refresh rewrites the parts
that the queue or a changed record has touched, and the mart at any date is a pass over it without a join. A replaced table is read anew.

A refresh is a job of the store: a stopped one has changed nothing, one that another job overtook fails at its commit.
Defined results: as ``marts`` over the stored tables at the commit of the refresh.
"""

from __future__ import annotations

import json
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.exceptions import AMOUNT_TABLES, with_amounts
from ..schemas import schema_of
from ..sources.staging import split_reference
from ..sources.tables import PARTED, TableStore
from . import marts

_COUNTS, _QUEUE, _MARKS = "mart_recon_counts", "mart_exceptions", "mart_marks"


def _mark(store: TableStore, mart: str) -> tuple[int, dict[str, str]]:
    """The last commit a mart has taken in, and the versions of its tables then."""
    row = store.read(_MARKS).where(F.col("mart") == mart).orderBy(F.desc("upto")).first()
    return (row["upto"], json.loads(row["versions"])) if row else (-1, {})


def _note(store: TableStore, mart: str, versions: dict[str, str]) -> None:
    rows = [(mart, store.latest(), json.dumps(versions, sort_keys=True))]
    store.write(_MARKS, store.spark.createDataFrame(rows, schema_of(_MARKS)))


def refresh_recon(store: TableStore) -> int:
    """Count the results appended since the last refresh; returns how many rows of the counts that made."""
    table = "reconciliation_results"
    _alone(store)
    with store.job():
        upto, versions = _mark(store, table)
        same = versions.get(table) == store.version(table)
        rows = store.changes(table, upto) if same else store.read(table)
        counts = rows.groupBy("batch_id", "match_status", "match_method").agg(
            F.count(F.lit(1)).alias("rows"), F.max("reconciled_at").alias("reconciled_at")
        ).withColumns({"upto": F.lit(store.latest()), "version": F.lit(store.version(table))})
        store.write(_COUNTS, counts, "append" if same else "replace")
        _note(store, table, {table: store.version(table)})
        return store.read(_COUNTS, last=True).count()


def recon_summary(store: TableStore) -> DataFrame:
    return marts.recon_summary_of(store.read(_COUNTS))


def outcome_breakdown(store: TableStore) -> DataFrame:
    return marts.outcome_breakdown_of(store.read(_COUNTS))


def _alone(store: TableStore) -> None:
    if store.busy():
        raise ValueError("a mart is refreshed in a job of its own, after the job that changes its tables")


def _pointing(store: TableStore, name: str, upto: int) -> DataFrame:
    """Exceptions whose record of table ``name`` may have changed since: a new row, or one in a part that was written."""
    rows, key = store.read(_QUEUE), AMOUNT_TABLES[name][0]
    if name in PARTED:
        dataset, record = split_reference(F.col("reference_id"))
        asked = rows.select("exception_id", dataset.alias("dataset"), record.alias(PARTED[name])).where(F.col("dataset") == name)
        return store.in_parts(name, asked, store.touched(name, upto))
    asked = store.changes(name, upto).select(F.concat(F.lit(f"{name}:"), F.col(key).cast("string")).alias("reference_id"))
    return rows.join(asked.distinct(), "reference_id", "left_semi")


def refresh_exceptions(store: TableStore) -> list[int]:
    """Rewrite the parts with changed exceptions or changed records; returns them."""
    names = ["exception_queue", *AMOUNT_TABLES]
    _alone(store)
    with store.job():
        upto, versions = _mark(store, _QUEUE)
        now = {n: store.version(n) for n in names}
        tables = {n: store.read(n) for n in AMOUNT_TABLES}
        if now != versions:
            parts = list(range(store.parts))
            store.write(_QUEUE, with_amounts(store.read("exception_queue"), tables), "replace")
        else:
            parts = set(store.touched("exception_queue", upto))
            for name in AMOUNT_TABLES:
                if store.has_changes(name, upto):
                    parts |= set(store._parts_of(_QUEUE, _pointing(store, name, upto)))
            parts = sorted(parts)
            if parts:
                store.rewrite(_QUEUE, parts, with_amounts(store.parts_rows("exception_queue", parts), tables))
        _note(store, _QUEUE, now)
    return parts


def exception_aging(store: TableStore, as_of: datetime) -> DataFrame:
    return marts.exception_aging_of(store.read(_QUEUE), as_of)
