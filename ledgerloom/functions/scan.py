"""Numbering, ranks, running values and exact quantiles without a single-task sort.

Every function but the last range-partitions the rows, sorts inside the partitions and stores the
result with ``monotonically_increasing_id`` (partition in the high bits, position in the
low 33). One aggregate per partition then gives each partition its starting value. A key
holding a third of all rows simply spans many partitions.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import materialize

_BITS = 33
_MASK = (1 << _BITS) - 1


def _block() -> Column:
    return F.shiftright(F.col("_row"), _BITS).cast("int")


def _ordered(df: DataFrame, sort: list, label: str) -> DataFrame:
    placed = df.repartitionByRange(*sort).sortWithinPartitions(*sort)
    return materialize(placed.withColumn("_row", F.monotonically_increasing_id()), label)


def _columns(sort: list) -> list[Column]:
    return [F.col(s) if isinstance(s, str) else s for s in sort]


def with_sequence(df: DataFrame, order: list, name: str) -> DataFrame:
    """Add the 1-based global position of each row under ``order`` (which must be unique)."""
    staged = _ordered(df, _columns(order), "sequence")
    # one row per partition reaches the driver, never data rows
    sizes = dict(staged.groupBy(_block().alias("b")).count().collect())
    starts, total = [], 0
    for block in range(max(sizes, default=-1) + 1):
        starts.append(total)
        total += sizes.get(block, 0)
    start = F.element_at(F.from_json(F.lit(json.dumps(starts)), "array<bigint>"), _block() + 1)
    position = start + F.col("_row").bitwiseAND(F.lit(_MASK)) + 1
    return staged.withColumn(name, position if starts else F.lit(None).cast("bigint")).drop("_row")


def with_rank(df: DataFrame, keys: list[str], order: list, name: str, total: str | None = None) -> DataFrame:
    """Add the 1-based position of each row within ``keys`` under ``order``; as ``total``, how many rows share its keys."""
    staged = _ordered(df, _columns(keys + order), "rank").withColumn("_b", _block())
    whole = Window.partitionBy(*keys)
    earlier = whole.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    blocks = (
        staged.groupBy("_b", *keys)
        .agg(F.count(F.lit(1)).alias("_n"), F.min("_row").alias("_first"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    )
    if total is not None:
        blocks = blocks.withColumn(total, F.sum("_n").over(whole))
    ranked = staged.join(blocks.drop("_n"), ["_b", *keys])
    return ranked.withColumn(name, F.col("_before") + F.col("_row") - F.col("_first") + 1).drop(
        "_b", "_row", "_first", "_before"
    )


_FOLDS = {
    "max": (F.max, F.greatest),
    "min": (F.min, F.least),
    "sum": (F.sum, lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))),
}


def running(df: DataFrame, keys: list[str], order: list, value: str, name: str, how: str) -> DataFrame:
    """Add the running max, min or sum of ``value`` within ``keys``, current row included."""
    fold, combine = _FOLDS[how]
    staged = _ordered(df, _columns(keys + order), "running").withColumn("_b", _block())
    here = Window.partitionBy("_b", *keys).orderBy("_row")
    earlier = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    blocks = (
        staged.groupBy("_b", *keys)
        .agg(fold(value).alias("_v"))
        .withColumn("_carry", fold("_v").over(earlier))
        .drop("_v")
    )
    local = staged.withColumn(
        "_local", fold(value).over(here.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    )
    merged = local.join(blocks, ["_b", *keys])
    return merged.withColumn(name, combine(F.col("_local"), F.col("_carry"))).drop(
        "_b", "_row", "_local", "_carry"
    )


def exact_quantiles(
    df: DataFrame, column: str, probabilities: list[float], bins: int = 1024, few: int = 4096
) -> tuple[int, list[float]]:
    """Exact quantiles with linear interpolation, by selection: histograms close in on the wanted ranks.

    A round counts the values in up to ``bins`` parts of every open interval, by one aggregate, and goes on with the
    parts that hold a wanted rank, from their least to their greatest value. An interval ends as one value, or
    as at most ``few`` values, which are fetched. Values are neither sorted nor shuffled.
    """
    numbers = df.select(F.col(column).cast("double").alias("v"), F.lit(1).cast("bigint").alias("n")).where("v IS NOT NULL AND NOT isnan(v)")
    endless = F.abs("v") == float("inf")
    total, below, finite, low, high = numbers.agg(
        F.count(F.lit(1)), F.count_if(endless & (F.col("v") < 0)), F.count_if(~endless), F.min(F.when(~endless, F.col("v"))), F.max(F.when(~endless, F.col("v"))),
    ).first()
    if total == 0:
        return 0, []
    wanted = wanted_ranks(total, probabilities)
    found = {r: -math.inf if r < below else math.inf for r in wanted if not below <= r < below + finite}
    # intervals: least and greatest value, values before them, values in them, ranks asked for
    found |= ranked(numbers, [(low, high, below, finite, [r for r in wanted if r not in found])], bins, few)
    return total, interpolated(total, probabilities, found)


def wanted_ranks(total: int, probabilities: list[float]) -> list[int]:
    spots = [p * (total - 1) for p in probabilities]
    return sorted({math.floor(s) for s in spots} | {math.ceil(s) for s in spots})


def interpolated(total: int, probabilities: list[float], found: dict[int, float]) -> list[float]:
    spots = [p * (total - 1) for p in probabilities]
    low_, high_ = [found[math.floor(s)] for s in spots], [found[math.ceil(s)] for s in spots]
    return [a if a == b else a + (b - a) * (s - math.floor(s)) for a, b, s in zip(low_, high_, spots, strict=True)]


def ranked(numbers: DataFrame, open_: list[tuple], bins: int = 1024, few: int = 4096) -> dict[int, float]:
    """Values at ranks inside intervals, by selection; ``numbers`` has finite values ``v`` and how often each row counts, ``n``."""
    found: dict[int, float] = {}
    while open_ := _settled(numbers, open_, found, few):
        which, place = F.lit(None).cast("int"), F.lit(None).cast("int")
        for i, (a, b, _, _, _) in enumerate(open_):
            inside = F.col("v").between(a, b)
            which = F.when(inside, F.lit(i)).otherwise(which)
            place = F.when(inside, _part(a, b, bins)).otherwise(place)
        counted = numbers.select("v", "n", which.alias("i"), place.alias("bin")).where("i IS NOT NULL").groupBy("i", "bin")
        # at most bins rows for each interval reach the driver
        rows = counted.agg(F.sum("n").alias("n"), F.min("v").alias("a"), F.max("v").alias("b")).collect()
        closer = []
        for i, (_, _, before, _, ranks) in enumerate(open_):
            for r in sorted((r for r in rows if r["i"] == i), key=lambda r: r["a"]):
                own = [k for k in ranks if before <= k < before + r["n"]]
                if own:
                    closer.append((r["a"], r["b"], before, r["n"], own))
                before += r["n"]
        open_ = closer
    return found


def _part(a: float, b: float, bins: int) -> Column:
    """The part of [a, b] that a value falls in: by sign where zero is inside, by magnitude where that varies much, else evenly."""
    v = F.col("v")
    if a <= 0 <= b:
        return F.signum(v).cast("int")
    if max(abs(a), abs(b)) / 1e6 > min(abs(a), abs(b)):
        share = (F.log(F.abs(v)) - math.log(abs(a))) / (math.log(abs(b)) - math.log(abs(a)))
    else:
        share = (v / 2 - a / 2) / (b / 2 - a / 2)
    return F.greatest(F.least(F.floor(share * bins), F.lit(bins - 1)), F.lit(0)).cast("int")


def _settled(numbers: DataFrame, intervals: list[tuple], found: dict[int, float], few: int) -> list[tuple]:
    """Note the ranks of intervals of one value or few values; the other intervals."""
    left = []
    for a, b, before, n, ranks in intervals:
        if not ranks:
            continue
        if a == b:
            found.update({r: a for r in ranks})
        elif n <= few or b / 2 - a / 2 == 0:
            # no more than few, or neighbouring numbers, whose counts are few different values
            same = numbers.where(F.col("v").between(a, b)).groupBy("v").agg(F.sum("n").alias("n")).orderBy("v").collect()
            at = before
            for r in same:
                found.update({k: r["v"] for k in ranks if at <= k < at + r["n"]})
                at += r["n"]
        else:
            left.append((a, b, before, n, ranks))
    return left
