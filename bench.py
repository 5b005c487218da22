"""Timed headline queries. Prints one JSON line.

Each query runs once to warm the session and once for the record, with its full result
written to Spark's ``noop`` sink. Marts read stored results, which are written before.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from ledgerloom.config import dq_config  # noqa: E402
from ledgerloom.functions.scratch import materialize  # noqa: E402
from ledgerloom.plans import marts  # noqa: E402
from ledgerloom.plans.registry import QUERIES  # noqa: E402
from ledgerloom.session import build_session  # noqa: E402

HEADLINE = (
    "recon_results", "mart_recon_summary", "dq_results", "dq_routed", "dq_iqr", "mart_dq_summary",
    "mart_exception_aging", "exc_queue", "enroll_validate", "enroll_dual_source", "audit_event_hash",
    "seal_append", "audit_append", "audit_verify",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]")
    times = {}
    stored = {"mart_recon_summary": "recon_results", "mart_dq_summary": "dq_results"}
    stored = {mart: materialize(QUERIES[name](spark, sf_dir), name) for mart, name in stored.items()}
    over = {
        "mart_recon_summary": lambda *_: marts.recon_summary(stored["mart_recon_summary"]),
        "mart_dq_summary": lambda *_: marts.dq_summary(stored["mart_dq_summary"], dq_config().type_weights),
    }
    for name in HEADLINE:
        for _ in range(2):
            start = time.perf_counter()
            over.get(name, QUERIES[name])(spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(json.dumps({
        "metric": "headline queries, warm, summed", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": sf_dir.rsplit("sf", 1)[-1], "cpus": cpus,
    }))


if __name__ == "__main__":
    main()
