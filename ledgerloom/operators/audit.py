"""The audit log: appending chained events, verifying the chain, and evidence per batch."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from datetime import UTC, datetime
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..functions.canonical import canonical_parts, event_hash
from ..functions.scan import with_rank, with_sequence
from ..functions.scratch import materialize, new_path
from ..schemas import schema_of

_LOG = "audit_event_log"
# events one task links into the chain
BLOCK_ROWS = 1_000_000
# steps of a shortened chain that are walked one by one
FEW_EDGES = 1 << 16


class BatchIdInUse(ValueError):
    def __init__(self, batch_id: str) -> None:
        super().__init__(f"batch id '{batch_id}' already has audit events; the log is append-only, use a new id")


class UnknownBatchId(ValueError):
    def __init__(self, batch_id: str) -> None:
        super().__init__(f"no audit events for batch id '{batch_id}', nothing to export")


def of_batch(log: DataFrame, batch_id: str | None, column: str = "event_id", prefix: str = "EVT") -> DataFrame:
    """Rows of one batch by id: prefix, batch and a number. A longer batch id does not match."""
    if not batch_id:
        return log
    lead = f"{prefix}-{batch_id}-"
    # the prefix test reaches the file scan, the pattern settles it
    return log.where(F.col(column).startswith(lead) & F.col(column).rlike(f"^{re.escape(lead)}[0-9]+$"))


def require_unused(log: DataFrame, batch_id: str) -> None:
    if not of_batch(log, batch_id).isEmpty():
        raise BatchIdInUse(batch_id)


def chain_tip(log: DataFrame) -> DataFrame:
    """The event no other event follows (one row in a sound log)."""
    followed = log.select(F.col("previous_hash").alias("event_hash")).distinct()
    return log.join(followed, "event_hash", "left_anti").select("event_id", "event_hash")


def unchained(events: DataFrame, as_of: datetime, actor: str = "system") -> DataFrame:
    """Event rows without hashes, numbered per batch, with ``seq`` for their place in the append.

    ``events``: ``ord``, ``event_type``, ``entity_type``, ``entity_id``, ``action``, ``batch_id``, and
    optionally ``timestamp`` and ``actor``.
    """
    stamp = F.lit(as_of.replace(tzinfo=None).isoformat(sep=" ")).cast("timestamp_ntz")
    own_time = F.coalesce("timestamp", stamp) if "timestamp" in events.columns else stamp
    own_actor = F.coalesce("actor", F.lit(actor)) if "actor" in events.columns else F.lit(actor)
    numbered = with_rank(with_sequence(events, ["ord"], "seq"), ["batch_id"], ["seq"], "n")
    return numbered.select(
        "seq", F.concat(F.lit("EVT-"), "batch_id", F.format_string("-%06d", "n")).alias("event_id"),
        own_time.alias("timestamp"), "event_type", own_actor.alias("actor"), "entity_type", "entity_id", "action",
    )


def _link(tip: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = tip
        for batch in batches:
            before, now = [], []
            for head, tail in zip(batch["head"], batch["tail"], strict=True):
                before.append(last)
                last = hashlib.sha256(f'{head}"{last}"{tail}'.encode()).hexdigest()
                now.append(last)
            yield pd.DataFrame({"seq": batch["seq"], "previous_hash": before, "event_hash": now})

    return run


def append(
    events: DataFrame, log: DataFrame | None, as_of: datetime, actor: str = "system", block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """The rows to add to the log: ``events`` in ``ord`` order, each holding the hash before it.

    A hash chain is sequential by definition. Everything but the two hash columns is built
    in parallel; the linking then goes block by block, each block one task over a bounded
    number of rows, stored before the next one starts. Only a block's last hash passes on.
    """
    spark = events.sparkSession
    rows = unchained(events, as_of, actor)
    head, tail = canonical_parts()
    block = F.floor((F.col("seq") - 1) / F.lit(block_rows)).cast("bigint")
    rows = rows.withColumns({"head": head, "tail": tail, "block": block})
    # one folder per block, so that linking a block reads that block alone
    stored = materialize(rows.repartition("block"), "events", partition_by=["block"])
    last = stored.groupBy("block").agg(F.max("seq").alias("seq")).orderBy("block").collect()
    tip = "" if log is None else chain_tip(log).select(F.min("event_hash")).first()[0] or ""
    schema = "seq bigint, previous_hash string, event_hash string"
    folder = new_path(spark, "links")
    for number, end in last:
        texts = stored.where(F.col("block") == number).select("seq", "head", "tail")
        in_order = texts.coalesce(1).sortWithinPartitions("seq")
        path = f"{folder}/{number}"
        in_order.mapInPandas(_link(tip), schema).write.parquet(path)
        tip = spark.read.schema(schema).parquet(path).where(F.col("seq") == end).first()["event_hash"]
    names = schema_of(_LOG).names
    if not last:
        return stored.withColumns({"previous_hash": F.lit(""), "event_hash": F.lit("")}).select(*names)
    return stored.join(spark.read.schema(schema).parquet(f"{folder}/*"), "seq").select(*names)


_REPORT = "verified boolean, event_count bigint, batch_id string, event_id string, reason string, position bigint"


def verify(log: DataFrame, batch_id: str | None = None, few: int = FEW_EDGES) -> DataFrame:
    """One row: ``verified``, ``event_count``, ``batch_id``, and the first break in chain order.

    A sound log is recognised by counts alone: one first event, every content hash right,
    every other event linked to exactly one predecessor and no event followed twice. Only
    a log that fails these is walked, once it is shortened to ``few`` steps.
    """
    spark = log.sparkSession
    chosen = of_batch(log, batch_id)
    events = materialize(
        chosen.select(
            "event_id", F.coalesce("previous_hash", F.lit("")).alias("prev"), "event_hash",
            (event_hash() != F.coalesce("event_hash", F.lit(""))).alias("altered"),
        ),
        "chain",
    )
    hashes = events.groupBy("event_hash").agg(F.count(F.lit(1)).alias("holders"))
    followers = events.groupBy("prev").agg(F.count(F.lit(1)).alias("followers"))
    linked = followers.join(hashes, followers["prev"] == hashes["event_hash"], "left")
    total, altered = events.agg(F.count(F.lit(1)), F.count_if("altered")).first()
    loose = F.col("holders").isNull()
    counts = linked.agg(
        F.sum(F.when(loose, F.col("followers")).otherwise(0)).alias("loose"),
        F.sum(F.when(F.col("prev") == "", F.col("followers")).otherwise(0)).alias("blank"),
        F.count_if((F.col("followers") > 1) & ~loose).alias("forks"),
        F.count_if(F.col("holders") > 1).alias("twins"),
        F.count_if(loose & (F.col("prev") != "")).alias("dangling"),
    ).first()

    def report(event: Any, reason: str | None, position: int | None) -> DataFrame:
        return spark.createDataFrame([(reason is None, total, batch_id, event, reason, position)], _REPORT)

    if total == 0:
        return report(None, None, None)
    first_events, starts = events.where("prev = ''"), counts["blank"]
    if batch_id is not None:
        # a batch may begin after an event outside it
        known = hashes.select(F.col("event_hash").alias("prev"))
        first_events = first_events.unionByName(events.where("prev <> ''").join(known, "prev", "left_anti"))
        starts = first_events.count()
    if starts != 1:
        named = log.select("event_id", "timestamp").join(first_events.select("event_id"), "event_id", "left_semi")
        first = named.orderBy("timestamp", "event_id").select("event_id").first() if starts else None
        return report(first and first[0], "chain_linkage_broken" if starts else "no_genesis", 0)
    unlinked = counts["dangling"] if batch_id is None else 0
    if altered == 0 and counts["forks"] == 0 and counts["twins"] == 0 and unlinked == 0:
        return report(None, None, None)
    return report(*_first_break(events, first_events, few))


def _first_break(events: DataFrame, first_events: DataFrame, few: int) -> tuple[str | None, str | None, int | None]:
    """Shorten the chain until a walk from its first event is short, and name the first break.

    Nodes are hash values; an event is the edge from ``prev`` to ``event_hash``. An edge stands for ``steps`` events and
    ends (``to`` null) with the first broken one. A round joins about a third of the edges to the edge before them, so all
    rounds together move a few times the rows of the log. It ends when ``few`` edges are left or the first one is whole.
    """
    genesis = first_events.select("event_id", "event_hash", "altered").first()
    event = F.struct("event_id", "event_hash", "altered")
    followers = materialize(events.groupBy("prev").agg(F.count(F.lit(1)).alias("n"), F.min(event).alias("e")), "followers")
    start = genesis["event_hash"]
    after = followers.where(F.col("prev") == start).select("n").first()
    if genesis["altered"]:
        return genesis["event_id"], "content_hash_mismatch", 0
    if after is not None and after["n"] > 1:
        return genesis["event_id"], "chain_fork", 0
    branches = followers.select(F.col("prev").alias("to"), F.col("n").alias("branches"))
    steps = followers.where("n = 1").select(F.col("prev").alias("at"), F.col("e.event_hash").alias("to"), "e.event_id", "e.altered")
    reason = F.when(F.col("altered"), "content_hash_mismatch").when(F.col("branches") > 1, "chain_fork")
    edges = steps.join(branches, "to", "left").select(
        "at", F.when(reason.isNull(), F.col("to")).alias("to"), F.lit(1).cast("bigint").alias("steps"),
        F.when(reason.isNotNull(), F.col("event_id")).alias("event_id"), reason.alias("reason"),
    )
    edges, number = materialize(edges, "edges"), 0
    while edges.count() > few:
        first = edges.where(F.col("at") == start).first()
        if first is None or first["to"] is None or edges.where(F.col("at") == first["to"]).isEmpty():
            break
        number += 1
        edges = materialize(_shortened(edges, start, number), "edges")
    else:
        return _walked({e["at"]: e for e in edges.collect()}, events, start)
    return _walked({} if first is None else {start: first}, events, start)


def _shortened(edges: DataFrame, start: str, number: int) -> DataFrame:
    """The edges with each whose node has a lower number than both neighbours joined to the edge before; numbers are new each round."""
    numbered = edges.withColumns({"a": F.xxhash64("at", F.lit(number)), "b": F.xxhash64("to", F.lit(number))})
    takes = F.col("to").isNotNull() & (F.col("b") < F.col("a"))
    goes = (F.col("at") != start) & (F.col("to").isNull() | (F.col("a") < F.col("b")))
    head = numbered.where(takes).select(F.col("to").alias("node"), F.col("at").alias("h_at"), F.col("steps").alias("h_steps"))
    tail = numbered.where(goes).select(F.col("at").alias("node"), *[F.col(c).alias(f"t_{c}") for c in edges.columns])
    met = head.join(tail, "node", "full")
    left, right = F.col("h_at").isNotNull(), F.col("t_at").isNotNull()
    joined = met.select(
        F.when(left, F.col("h_at")).otherwise(F.col("t_at")).alias("at"),
        F.when(right, F.col("t_to")).otherwise(F.col("node")).alias("to"),
        (F.coalesce("h_steps", F.lit(0)) + F.coalesce("t_steps", F.lit(0))).alias("steps"),
        F.col("t_event_id").alias("event_id"), F.col("t_reason").alias("reason"),
    )
    return joined.unionByName(numbered.where(~takes & ~goes).select(*edges.columns))


def _walked(after: dict[str, Row], events: DataFrame, start: str) -> tuple[str | None, str | None, int | None]:
    """The first break on the way from ``start`` over edges by their node."""
    at, position, met = start, 0, set()
    while at in after and at not in met:
        met.add(at)
        edge = after[at]
        position += edge["steps"]
        if edge["reason"] is not None:
            return edge["event_id"], edge["reason"], position
        at = edge["to"]
    if at in met:
        return events.where(F.col("prev") == at).first()["event_id"], "cycle_detected", position + 1
    return None, "orphaned_events", position + 1


def recent(log: DataFrame, limit: int = 100) -> DataFrame:
    return (
        log.select("event_id", "timestamp", "event_type", "actor", "entity_type", "entity_id", "action")
        .orderBy(F.desc("timestamp"), F.desc("event_id"))
        .limit(limit)
    )


def recon_counts(results: DataFrame) -> DataFrame:
    """Per batch; here everything not matched counts as an exception, ledger rows included."""
    matched = F.count_if(F.col("match_status") == "matched")
    return results.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("total"), matched.alias("matched"), (F.count(F.lit(1)) - matched).alias("exceptions")
    )


def exception_counts(queue: DataFrame) -> DataFrame:
    return queue.agg(
        F.count(F.lit(1)).alias("total"),
        *[F.count_if(F.col("status") == s).alias(s) for s in ("open", "in_progress", "resolved")],
    )



def evidence(
    log: DataFrame, results: DataFrame, queue: DataFrame, batch_id: str, full: bool = True,
    exported_at: datetime | None = None, checked: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """The evidence package of one batch, a DataFrame per section.

    ``manifest`` is one row: scope, verification and summaries. The row sections stay
    distributed; ``full=False`` leaves reconciliation rows out and says so in the scope.
    ``checked`` is the report of a sealed log; without it the log is checked as a chain of events.
    """
    events = of_batch(log, batch_id)
    checked = verify(log, batch_id) if checked is None else checked
    outcome = checked.first()
    if outcome["event_count"] == 0:
        raise UnknownBatchId(batch_id)
    recon = results.where(F.col("batch_id") == batch_id)
    opened = of_batch(queue, batch_id, "exception_id", "EXC")
    span = events.agg(F.min("timestamp").alias("a"), F.max("timestamp").alias("b")).first()
    sums = recon.agg(
        F.count(F.lit(1)).alias("total"), F.count_if(F.col("match_status") == "matched").alias("matched")
    ).first()
    states = exception_counts(opened).first()
    when = (exported_at or datetime.now(UTC)).isoformat()
    whole = lambda n: F.lit(int(n)).cast("bigint")
    manifest = checked.select(
        F.lit(batch_id).alias("batch_id"), F.lit(when).alias("exported_at"),
        F.struct(
            whole(outcome["event_count"]).alias("audit_events_rows"), whole(sums["total"]).alias("reconciliation_results_rows"),
            F.lit(full).alias("reconciliation_results_included"), whole(states["total"]).alias("exception_rows"),
            F.array(F.lit(str(span["a"])), F.lit(str(span["b"]))).alias("event_timestamp_range"),
        ).alias("scope"),
        F.struct(
            "verified", "event_count", "batch_id",
            F.when(F.col("reason").isNotNull(), F.struct("event_id", "reason", "position")).alias("broken_event"),
        ).alias("verification"),
        F.struct(
            whole(sums["total"]).alias("total"), whole(sums["matched"]).alias("matched"),
            whole(sums["total"] - sums["matched"]).alias("exceptions"),
        ).alias("reconciliation_summary"),
        F.struct(*[whole(states[k]).alias(k) for k in ("total", "open", "in_progress", "resolved")]).alias("exception_summary"),
    )
    return {
        "manifest": manifest,
        "audit_events": events.orderBy("timestamp", "event_id"),
        "reconciliation_results": recon if full else recon.limit(0),
        "exceptions": opened.orderBy("exception_id"),
    }


def write_evidence(package: dict[str, DataFrame], folder: str) -> None:
    """Each section as JSON lines below ``folder``."""
    from ..sources.files import write_json

    for name, section in package.items():
        write_json(section, f"{folder.rstrip('/')}/{name}")
