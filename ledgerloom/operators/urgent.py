"""The most urgent exceptions at any date, from one stored order of the queue.

Until its days are used up an exception keeps its first score; after that the score rises with every day. Rows with one
weight, amount factor and allowance so keep their order by age for ever, whatever the date. They are stored in cells: one
such group, one day of creation. A cell's rows are at most two ages apart in score, so the counts of the cells alone
tell which of them can hold one of the top rows at a date, and only those are read. In a cell with a single score
the smallest ids decide, and these are stored apart from the rest.

Rows without a creation time have age 0 at any date and lie in a cell of the last day there is. Repeated ids are
rows of their own. An empty queue gives an empty answer. A queue that changes is stored anew.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scan import running, with_rank
from ..functions.scratch import materialize
from .exceptions import age_days, age_factor, scored

_GROUP = ["severity_weight", "amount_at_risk_factor", "sla_days"]
_UNDATED = "9999-12-31"


@dataclass(frozen=True)
class UrgentOrder:
    """``rows`` of the queue with ``day`` and ``head`` (among the ``heads`` smallest ids of the cell); ``cells`` with counts."""

    rows: DataFrame
    cells: DataFrame
    heads: int


def stored_order(
    queue: DataFrame, tables: dict[str, DataFrame], status: str | None = None, sla_override: int | None = None, heads: int = 100
) -> UrgentOrder:
    """Store what the score of a row is made of, sorted by group, head or not, day and id."""
    chosen = queue.where(F.col("status") == status) if status else queue
    parts = scored(chosen, tables, datetime(1970, 1, 1), sla_override).select(
        "exception_id", "source", F.coalesce("reference_id", F.lit("")).alias("reference_id"), "priority", "status",
        "assigned_to", "amount_at_risk", "amount_basis", "created_at", *_GROUP,
        F.coalesce(F.to_date(F.col("created_at") - _tick()), F.lit(_UNDATED).cast("date")).alias("day"),
    )
    placed = with_rank(parts, [*_GROUP, "day"], ["exception_id"], "place")
    order = [*_GROUP, "head", "day", "exception_id"]
    rows = placed.withColumn("head", F.col("place") <= heads).drop("place").repartitionByRange(*order).sortWithinPartitions(*order)
    rows = materialize(rows, "urgent")
    return UrgentOrder(rows, materialize(rows.groupBy(*_GROUP, "day").agg(F.count(F.lit(1)).alias("n")), "urgent-cells"), heads)


def _tick() -> Column:
    """A day's cell begins just after its midnight and ends with the next: at a midnight all its rows are of one age."""
    return F.expr("INTERVAL '0.000001' SECOND")


def _score(age: Column) -> Column:
    return F.round(F.col("severity_weight") * F.col("amount_at_risk_factor") * age_factor(age, F.col("sla_days")), 4)


def _wanted(order: UrgentOrder, as_of: datetime, top: int) -> Column | None:
    """Which rows can be among the first ``top``, as a test on stored columns; None where there are no rows."""
    start = F.col("day").cast("timestamp_ntz")
    dated = F.col("day") != F.lit(_UNDATED).cast("date")
    cells = order.cells.select(
        *_GROUP, "day", "n",
        _score(age_days(F.when(dated, start + F.expr("INTERVAL '1' DAY")), as_of)).alias("least"),
        _score(age_days(F.when(dated, start + _tick()), as_of)).alias("most"),
    )
    # the highest score that enough rows reach for certain
    reached = running(cells.groupBy("least").agg(F.sum("n").alias("n")).withColumn("one", F.lit(1)), ["one"], [F.desc("least")], "n", "so_far", "sum")
    sure = reached.where(F.col("so_far") >= top).agg(F.max("least")).first()[0]
    split = F.when((F.col("least") < F.col("most")) | F.lit(top > order.heads), F.col("day"))
    kept = cells.where(F.col("most") >= sure) if sure is not None else cells
    # one row for each of the few combinations of weight, factor and allowance
    groups = kept.groupBy(*_GROUP).agg(F.max("day").alias("until"), F.min(split).alias("a"), F.max(split).alias("b")).collect()
    tests = []
    for g in groups:
        own = reduce(lambda x, y: x & y, [F.col(c) == F.lit(g[c]) for c in _GROUP])
        whole = F.col("day").between(F.lit(g["a"]), F.lit(g["b"])) if g["a"] is not None else F.lit(False)
        tests.append(own & (F.col("day") <= F.lit(g["until"])) & (F.col("head") | whole))
    return reduce(or_, tests) if tests else None


def most_urgent(order: UrgentOrder, as_of: datetime, top: int = 100) -> DataFrame:
    """The first ``top`` rows of ``ranked_queue`` at ``as_of``, in its order and with its columns."""
    test = _wanted(order, as_of, top)
    rows = order.rows.where(test if test is not None else F.lit(False))
    rows = rows.withColumn("age_days", age_days(F.col("created_at"), as_of))
    return rows.select(
        "exception_id", "source", "reference_id", "priority", "status", "assigned_to", "age_days", "sla_days",
        "amount_at_risk", "amount_basis", "amount_at_risk_factor", age_factor(F.col("age_days"), F.col("sla_days")).alias("age_factor"),
        _score(F.col("age_days")).alias("priority_score"), "created_at",
    ).orderBy(F.desc("priority_score"), "exception_id").limit(top)
