"""Enrollment files picked up as they land: each micro-batch goes through the batch job.

A micro-batch is one job, named by its stream and number, so all its tables change together or not at all, and a
replayed one does nothing. It reads the processed ids of the parts that its own ids fall in, and of the audit log
the last seal alone.
"""

from __future__ import annotations

import hashlib
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..config import EnrollmentRules
from ..plans.run_all import enroll_store
from ..sources.files import stream_enrollments
from ..sources.tables import TableStore


def start_intake(
    store: TableStore, folder: str, checkpoint: str, as_of: datetime, rules: EnrollmentRules | None = None,
    actor: str = "operator",
) -> StreamingQuery:
    """Submissions are single: entities are not compared with others in the same file."""

    stream = hashlib.md5(checkpoint.encode()).hexdigest()

    def take(rows: DataFrame, epoch: int) -> None:
        run_id = f"intake:{stream}:{epoch}"
        if not store.done(run_id) and not rows.isEmpty():
            enroll_store(store, as_of, rules, rows, actor, within_batch=False, run_id=run_id)

    return (
        stream_enrollments(store.spark, folder)
        .writeStream.foreachBatch(take)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
