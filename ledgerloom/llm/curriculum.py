"""Mix sources to target weights over a curriculum that changes with training time.

Every source has a weight schedule over training time, linear between knots. Its integral is the
source's weight: it shares the wanted words, at most ``most`` times the source's own, the excess
going to the others by weight until none is above. Inside a source, documents follow in the order
of a seeded hash; their running words are the source's supply. A document is taken while supply lies
below the target, and again in a second pass. Inverting the source's cumulative demand at the middle
of a copy gives the copy's training position.

Defined results: a null text has size 0 and is taken with 0 words. A null source is a source of its
own, last in order. Rows that agree in id, source and text share what their group takes. An empty
table gives no rows. Other columns pass through ``mix`` and never clash, as working columns start
with an underscore.

Running sums, ranks and the final order use range partitions, so a source with a third of all rows
spans many tasks. Capped targets come from a few one-row aggregates; nothing else reaches the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scan import running, with_sequence
from ..functions.scratch import materialize
from .common import WORD

Schedule = Sequence[tuple[float, float]]

# fixed values: relative rate at the start, middle and end of training, by weight; each has the integral 1
RISING: Schedule = ((0.0, 0.6), (0.5, 1.0), (1.0, 1.4))
LEVEL: Schedule = ((0.0, 1.0), (0.5, 1.0), (1.0, 1.0))
FALLING: Schedule = ((0.0, 1.4), (0.5, 1.0), (1.0, 0.6))


def integral(schedule: Schedule) -> float:
    return sum((b - a) * (u + v) / 2 for (a, u), (b, v) in zip(schedule, schedule[1:]))


def position(share: Column, schedule: Schedule) -> Column:
    """Training time at which the source has been asked for ``share`` (0 to 1) of its words."""
    whole, before, found = integral(schedule), 0.0, F.lit(float(schedule[-1][0]))
    asked = share * whole
    pieces = []
    for (a, u), (b, v) in zip(schedule, schedule[1:]):
        pieces.append((before, a, u, v, b - a))
        before += (b - a) * (u + v) / 2
    for start, a, u, v, width in reversed(pieces):
        rest = F.greatest(asked - start, F.lit(0.0))
        root = u + F.sqrt(F.greatest(F.lit(u * u) + 2 * rest * ((v - u) / width), F.lit(0.0)))
        step = F.when(root > 0, 2 * rest / root).otherwise(F.lit(0.0))
        found = F.when(asked < start + width * (u + v) / 2, a + step).otherwise(found)
    return F.least(F.greatest(found, F.lit(float(schedule[0][0]))), F.lit(float(schedule[-1][0])))


def _sources(rows: DataFrame, weights: Sequence[float], schedules: Sequence[Schedule], share: float, most: int) -> DataFrame:
    """A row per source: supply, target and the kind of its schedule."""
    sizes = rows.groupBy("_source").agg(F.sum("_size").alias("_supply"))
    ordered = with_sequence(sizes, [F.col("_source").asc_nulls_last()], "_rank")
    kind = ((F.col("_rank") - 1) % len(weights)).cast("int")
    weight = F.element_at(F.array(*[F.lit(float(w * integral(s))) for w, s in zip(weights, schedules)]), kind + 1)
    held = materialize(ordered.select("_source", "_supply", kind.alias("_kind"), weight.alias("_weight")), "sources")
    bound = most * F.col("_supply")
    total = (held.agg(F.sum("_supply")).first()[0] or 0) * share
    rate, capped = 0.0, -1
    while True:  # each turn caps a source at least
        full = bound <= F.lit(rate) * F.col("_weight")
        row = held.agg(
            F.count(F.when(full, 1)).alias("n"), F.sum(F.when(full, bound)).alias("words"),
            F.sum(F.when(~full, F.col("_weight"))).alias("open"),
        ).first()
        if row["n"] == capped or not row["open"]:
            break
        capped, rate = row["n"], (total - (row["words"] or 0)) / row["open"]
    target = F.when(bound <= F.lit(rate) * F.col("_weight"), bound.cast("double")).otherwise(F.lit(rate) * F.col("_weight"))
    return held.select("_source", "_supply", "_kind", target.alias("_target"))


def plan(
    docs: DataFrame,
    weights: Sequence[float] = (5, 2, 1),
    schedules: Sequence[Schedule] = (RISING, LEVEL, FALLING),
    share: float = 1.5,
    most: int = 2,
    seed: str = "",
    key: str = "doc_id",
    source: str = "source",
    text: str = "text",
) -> DataFrame:
    """A row per document: ``_id``, ``_print`` (hash of its text), source, size, supply, target, words
    taken in each pass and the positions of both copies."""
    read = docs.select(F.col(key).alias("_id"), F.col(source).alias("_source"), F.col(text).alias("_text"))
    size = F.coalesce(F.regexp_count(F.col("_text"), F.lit(WORD)), F.lit(0)).cast("bigint")
    rows = materialize(read.select("_id", "_source", F.xxhash64("_text").alias("_print"), size.alias("_size")), "sizes")
    place = F.md5(F.concat(F.lit(seed), F.coalesce(F.col("_id").cast("string"), F.lit(""))))
    units = rows.groupBy("_id", "_source", "_print", "_size").agg(F.count(F.lit(1)).alias("_copies"))
    units = units.withColumn("_words", F.col("_size") * F.col("_copies")).withColumn("_place", place)
    order = ["_place", F.col("_id").asc_nulls_last(), "_print"]
    # a source's null cannot be joined on; its name is kept beside a flag
    named = {"_name": F.coalesce(F.col("_source"), F.lit("")), "_missing": F.col("_source").isNull()}
    upto = running(units.withColumns(named), ["_missing", "_name"], order, "_words", "_upto", "sum")
    sources = _sources(rows, weights, schedules, share, most).withColumns(named).drop("_source")
    placed = upto.join(sources, ["_missing", "_name"])
    before, want = F.col("_upto") - F.col("_words"), F.floor("_target").cast("bigint")
    passes = [
        F.least(F.greatest(want - F.col("_supply") * i - before, F.lit(0)), F.col("_words")) for i in range(most)
    ]
    taken = [F.expr("0").cast("bigint") + F.floor(p / F.col("_copies")).cast("bigint") for p in passes]

    def at(i: int) -> Column:
        middle = (before + F.col("_supply") * i + passes[i] / 2) / F.greatest(F.col("_target"), F.lit(1.0))
        found = F.lit(None).cast("double")
        for kind, schedule in enumerate(schedules):
            found = F.when(F.col("_kind") == kind, position(middle, schedule)).otherwise(found)
        return F.when(passes[i] > 0, found)

    decided = placed.select(
        "_id", "_source", "_print", "_size", "_supply", "_target",
        F.array(*taken).alias("_taken"), F.array(*[at(i) for i in range(most)]).alias("_at"),
    )
    same = [rows[c].eqNullSafe(decided[c]) for c in ("_id", "_source", "_print")]
    return rows.join(decided, same[0] & same[1] & same[2]).select(
        rows["_id"], rows["_source"], rows["_print"], rows["_size"], "_supply", "_target", "_taken", "_at"
    )


def mix(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", **options) -> DataFrame:
    """The training order: a row per copy with all columns of ``docs`` and ``position``, range-sorted by it.

    Copies are whole documents; one is left out where less than half of its words are wanted.
    """
    decided = plan(docs, key=key, source=source, text=text, **options)
    copies = decided.select("_id", "_source", "_print", "_size", F.posexplode(F.arrays_zip("_taken", "_at")).alias("_pass", "_copy"))
    kept = copies.where((F.col("_copy._taken") > 0) & (2 * F.col("_copy._taken") >= F.col("_size")))
    # rows alike in id, source and text have one plan
    kept = kept.groupBy("_id", "_source", "_print", "_pass").agg(F.min("_copy._at").alias("position"))
    kept = kept.groupBy("_id", "_source", "_print").agg(F.sort_array(F.collect_list("position")).alias("_positions"))
    marked = docs.withColumn("_print", F.xxhash64(F.col(text)))
    same = marked[key].eqNullSafe(kept["_id"]) & marked[source].eqNullSafe(kept["_source"]) & (marked["_print"] == kept["_print"])
    columns = [marked[c] for c in docs.columns if c != "position"]
    out = marked.join(kept, same).select(*columns, F.explode("_positions").alias("position"))
    return out.repartitionByRange("position", F.col(key)).sortWithinPartitions("position", key)
