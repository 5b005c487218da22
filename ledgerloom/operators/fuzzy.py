"""Fuzzy edges: payment and ledger types close in amount, date and reference text.

The amount and date bands become bucket keys. A bucket with few pairs is joined directly.
In a bucket with very many, texts meet only where they share a subsequence of the length the
threshold asks for, which lists the wanted pairs and almost nothing else; texts too long
for that meet on pieces one of which must survive the allowed edits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import ReconConfig
from ..functions import bands
from ..functions.scratch import materialize
from ..functions.text import (
    can_reach,
    listable,
    pieces,
    shared_needed,
    shifted_pieces,
    similarity,
    subsequences,
)

# pairs one bucket may hold before its texts are compared through shared keys
PAIRS_PER_BUCKET = 1 << 20

# pieces of a payment's text beyond those that edits can touch; as many of its most frequent are left out
SPARE_PIECES = 4

_CELL = ["cur", "db", "ab"]


def fuzzy_edges(types: DataFrame, ledger: DataFrame, cfg: ReconConfig, pairs_per_bucket: int = PAIRS_PER_BUCKET) -> DataFrame:
    """(``pt``, ``lt``, ``kind``, ``score``, ...) of F types; ``ledger`` rows are (ref, cur, amount, day, ord, id)."""
    asking = types.where((F.col("ref") != "") & bands.matchable(F.col("amount"), F.col("day")))
    asking = (
        asking.withColumn("db", F.explode(bands.date_buckets(F.col("day"), cfg)))
        .withColumn("ab", F.explode(bands.amount_buckets(F.col("amount"), cfg)))
        .select("pt", "n_p", F.col("ref").alias("p_ref"), "cur", F.col("amount").alias("p_amount"),
                F.col("day").alias("p_day"), "db", "ab")
    )
    # stored, so that the planner knows their size and need not shuffle the ledger when they are few
    cells = materialize(asking.select(*_CELL).distinct(), "cells")
    offered = materialize(ledger_types(ledger, cfg, cells), "offered")
    crowded = (
        asking.groupBy(*_CELL).agg(F.count(F.lit(1)).alias("a"))
        .join(offered.groupBy(*_CELL).agg(F.count(F.lit(1)).alias("b")), _CELL)
        .where(F.col("a") * F.col("b") > F.lit(pairs_per_bucket))
        .select(*_CELL)
    )
    if crowded.isEmpty():
        return _scored(asking.join(offered, _CELL), cfg)
    crowded = materialize(crowded, "crowded")
    calm = asking.join(crowded, _CELL, "left_anti").join(offered, _CELL)
    meeting = _by_shared_text(
        asking.join(crowded, _CELL, "left_semi"), offered.join(crowded, _CELL, "left_semi"), cfg
    )
    return _scored(calm, cfg).unionByName(_scored(meeting, cfg))


def ledger_types(ledger: DataFrame, cfg: ReconConfig, cells: DataFrame) -> DataFrame:
    """Ledger types in the wanted buckets, with their size and their first and last row."""
    placed = (
        ledger.where(bands.matchable(F.col("amount"), F.col("day")))
        .withColumn("db", bands.date_bucket(F.col("day"), cfg))
        .withColumn("ab", bands.amount_bucket(F.col("amount"), cfg))
        .join(cells, _CELL, "left_semi")
    )
    row = F.struct("ord", "id")
    return (
        placed.groupBy("ref", "cur", "amount", "day", "db", "ab")
        .agg(F.count(F.lit(1)).alias("n_l"), F.min("id").alias("lt"),
             F.min(row).alias("l_first"), F.max(row).alias("l_last"))
        .withColumnsRenamed({"ref": "l_ref", "amount": "l_amount", "day": "l_day"})
    )


def _scored(pairs: DataFrame, cfg: ReconConfig) -> DataFrame:
    a, b = F.col("p_ref"), F.col("l_ref")
    la, lb = F.length(a), F.length(b)
    total = la + lb
    slips = total - 2 * shared_needed(la, lb, cfg.fuzzy_threshold)
    near = pairs.where(
        bands.within_amount(F.col("p_amount"), F.col("l_amount"), cfg)
        & bands.within_window(F.col("p_day"), F.col("l_day"), cfg)
        & can_reach(la, lb, cfg.fuzzy_threshold)
    )
    # an edit distance above the allowed insertions and deletions rules the pair out; past that bound it is not counted on
    near = near.where(F.call_function("levenshtein", a, b, F.greatest(slips, F.lit(0))) >= 0)
    return (
        near.withColumn("score", similarity(a, b))
        .where(F.col("score") >= F.lit(cfg.fuzzy_threshold))
        .select("pt", "lt", F.lit("F").alias("kind"), "score", "n_p", "n_l", "l_first", "l_last")
    )


def _shared_ends(asking: DataFrame, offered: DataFrame) -> DataFrame:
    """Per bucket, the letters all its texts begin with and end with: those of the first and last in order."""
    texts = asking.select(*_CELL, F.col("p_ref").alias("t")).unionByName(offered.select(*_CELL, F.col("l_ref").alias("t")))
    back = F.reverse("t")
    ends = texts.groupBy(*_CELL).agg(
        F.min("t").alias("a"), F.max("t").alias("b"), F.min(back).alias("ra"), F.max(back).alias("rb"), F.min(F.length("t")).alias("least")
    )

    def common(a: str, b: str) -> Column:
        same = lambda i: F.substring(F.col(a), F.lit(1), i) == F.substring(F.col(b), F.lit(1), i)
        # a sequence from 1 to 0 would run downwards
        return F.when(F.col("least") > 0, F.size(F.filter(F.sequence(F.lit(1), F.greatest("least", F.lit(1))), same))).otherwise(F.lit(0))

    head = ends.withColumn("head", common("a", "b")).withColumn("tail", common("ra", "rb"))
    return head.select(*_CELL, "head", F.least("tail", F.col("least") - F.col("head")).alias("tail"))


def _by_shared_text(asking: DataFrame, offered: DataFrame, cfg: ReconConfig) -> DataFrame:
    """Pairs that can reach the threshold and meet on a shared key.

    What a whole bucket begins or ends with is cut off first: it adds the same letters to every pair's
    common subsequence. Texts too long to list meet on pieces. A payment's text is cut into more pieces
    than edits can touch, and its most frequent ones are left out while enough stay for one to survive.
    """
    ends = materialize(_shared_ends(asking, offered), "ends")

    def bare(side: DataFrame, text: str, name: str, length: str) -> DataFrame:
        cut = side.join(ends, _CELL).withColumn(length, F.length(text)).withColumn("cut", F.col("head") + F.col("tail"))
        return cut.withColumn(name, F.substring(F.col(text), F.col("head") + 1, F.col(length) - F.col("cut")))

    asking, offered = bare(asking, "p_ref", "p_bare", "la"), bare(offered, "l_ref", "l_bare", "lb")
    lengths_l = offered.groupBy(*_CELL).agg(F.collect_set("lb").alias("others"))
    lengths_p = asking.groupBy(*_CELL).agg(F.collect_set("la").alias("others"))
    asking = _with_plan(asking.join(lengths_l, _CELL).withColumn("lb", F.explode("others")), cfg)
    offered = _with_plan(offered.join(lengths_p, _CELL).withColumn("la", F.explode("others")), cfg)

    def keyed(side: DataFrame, text: str, drops: str) -> DataFrame:
        return side.where("listed").withColumn("key", F.explode(subsequences(F.col(text), F.col(drops))))

    def cut(side: DataFrame, parts: Column) -> DataFrame:
        return side.where("NOT listed").withColumn("key", F.explode(parts))

    own, needed = F.col("la") - F.col("cut"), F.col("ka") + F.col("kb") + 1
    spare = F.least(F.lit(SPARE_PIECES), F.greatest(F.floor(own / 3).cast("int") - needed, F.lit(0)))
    left, right = [*_CELL, "la", "lb", "key"], ["lt", "l_ref", "l_amount", "l_day", "n_l", "l_first", "l_last"]
    listed = keyed(asking, "p_bare", "ka").join(keyed(offered, "l_bare", "kb").select(*left, *right), left)
    there = cut(offered, shifted_pieces(F.col("l_bare"), own, needed + spare, F.col("ka"), F.col("kb"))).select(*left, *right)
    often = there.groupBy(*left).agg(F.count(F.lit(1)).alias("often"))
    here = cut(asking, pieces(F.col("p_bare"), needed + spare)).withColumn("spare", spare).join(often, left, "left")
    # a text's pieces are few; its most frequent ones come first
    place = F.row_number().over(Window.partitionBy("pt", *_CELL, "la", "lb").orderBy(F.coalesce("often", F.lit(0)).desc(), "key"))
    here = here.withColumn("place", place).where((F.col("place") > F.col("spare")) & F.col("often").isNotNull())
    cuts = here.join(there, left)
    wanted = ["pt", "n_p", "p_ref", "p_amount", "p_day", *right]
    return listed.select(*wanted).unionByName(cuts.select(*wanted)).dropDuplicates(["pt", "lt"])


def _with_plan(side: DataFrame, cfg: ReconConfig) -> DataFrame:
    """Letters each text may leave out, and whether its subsequences can be listed."""
    la, lb = F.col("la"), F.col("lb")
    need = shared_needed(la, lb, cfg.fuzzy_threshold)
    return (
        side.where(can_reach(la, lb, cfg.fuzzy_threshold))
        .withColumn("ka", F.least(la - need, la - F.col("cut")))
        .withColumn("kb", F.least(lb - need, lb - F.col("cut")))
        .withColumn("listed", listable(la - F.col("cut"), F.col("ka")) & listable(lb - F.col("cut"), F.col("kb"))
                    & (la - F.col("ka") == lb - F.col("kb")))
        .drop("others")
    )
