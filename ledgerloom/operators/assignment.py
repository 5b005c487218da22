"""Who gets which ledger row, without walking the payments one by one.

Payments are served in file order and each takes the best ledger row still free. Every
ledger row therefore prefers the earliest payment, and the outcome is the only stable
assignment, whatever the order it is computed in. Copies (same reference, currency,
amount and date) form one type, so edges join types, not rows.

Edges: ``pt`` payment type (its smallest ``seq``), ``lt`` ledger type (its smallest id),
``kind`` E or F, ``score``, ``n_p`` / ``n_l`` rows in each type, ``l_first`` / ``l_last`` structs
(``ord``, ``id``) of the ledger type. E prefers ledger order, F the score and then the
*last* row in ledger order.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scan import running, with_rank, with_sequence
from ..functions.scratch import materialize

# rounds after which the logs of places and bounds are folded into one table each
LOG_LENGTH = 12

_NEVER = (1 << 62) - 1
_TYPE = ["ref", "cur", "amount", "day"]


def mark_simple(edges: DataFrame) -> DataFrame:
    """Flag the edges decided by one look: one row on one side, and nobody else's edges around it."""
    by_p = edges.groupBy("pt").agg(F.count(F.lit(1)).alias("d_p"))
    degrees = edges.join(by_p, "pt")
    by_l = degrees.groupBy("lt").agg(F.count(F.lit(1)).alias("d_l"), F.max("d_p").alias("w_l"))
    around = degrees.join(by_l, "lt")
    crowd_p = around.groupBy("pt").agg(F.max("d_l").alias("w_p"))
    return (
        around.join(crowd_p, "pt")
        .withColumn("one_row", (F.col("n_l") == 1) & (F.col("w_l") == 1))
        .withColumn("one_payment", (F.col("n_p") == 1) & (F.col("w_p") == 1))
        .drop("d_p", "d_l", "w_l", "w_p")
    )


def assign(edges: DataFrame, payments: DataFrame, ledger: DataFrame) -> DataFrame:
    """Assigned pairs (``seq``, ``id``, ``score``).

    ``payments`` holds (``seq``, ``pt``) and ``ledger`` (``ref``, ``cur``, ``amount``, ``day``, ``ord``, ``id``);
    both are only read for the edges that need rounds.
    """
    marked = materialize(mark_simple(edges), "edges")
    earliest = (
        marked.where("one_row")
        .groupBy("lt")
        .agg(F.min("pt").alias("seq"), F.first("l_first.id").alias("id"), F.min_by("score", "pt").alias("score"))
        .select("seq", "id", "score")
    )
    own_choice = marked.where("one_payment AND NOT one_row")
    first = F.min_by(F.struct(F.col("l_first.id"), "score"), F.struct(-F.col("score"), "l_first"))
    last = F.max_by(F.struct(F.col("l_last.id"), "score"), F.struct("score", "l_last"))
    best = (
        own_choice.groupBy("pt", "kind")
        .agg(F.when(F.col("kind") == "E", first).otherwise(last).alias("b"))
        .select(F.col("pt").alias("seq"), F.col("b.id").alias("id"), F.col("b.score").alias("score"))
    )
    settled = earliest.unionByName(best)
    contended = marked.where("NOT one_row AND NOT one_payment")
    if contended.isEmpty():
        return settled
    return settled.unionByName(rounds(contended, payments, ledger))


def rounds(edges: DataFrame, payments: DataFrame, ledger: DataFrame) -> DataFrame:
    """Propose and refuse, many payments at a time; a round touches only the types that lost a row.

    ``lb`` is a place in the payment's list that it cannot do better than. The k-th payment
    of a type starts at place k. ``bounds`` holds the earliest payment that ever asked for a row: the
    row goes to it or to an earlier one, so whoever comes later has lost it and moves past all rows that
    are bound to earlier payments. Payments of one type keep distinct, rising places. When nobody
    loses, the places are the result. Payments past the end of their list stay without a row.

    Places and bounds are logs: a round adds the places that changed, and reads the lists of the losing types.
    """
    lists = _preference_lists(edges, ledger)
    sizes = lists.groupBy("pt").agg(F.max("pos").alias("size"))
    queue = payments.join(edges.select("pt").distinct(), "pt", "left_semi")
    moved = with_rank(queue, ["pt"], ["seq"], "k").withColumn("lb", F.col("k")).join(sizes, "pt")
    places, bounds, number = [], [], 0
    while True:
        number += 1
        row = lists.select("pt", F.col("pos").alias("lb"), "id", "score")
        asked = moved.select("pt", "seq", "k", "lb", "size").join(row, ["pt", "lb"], "left")
        asked = materialize(asked.withColumn("round", F.lit(number)), "round")
        places.append(asked)
        bids = asked.where("id IS NOT NULL")
        now = bids.groupBy("id").agg(F.min_by(F.struct("seq", "pt"), "seq").alias("best"))
        if bounds:
            now = now.join(_bound(bounds).select("id", F.col("holder").alias("was")), "id", "left")
        else:
            now = now.withColumn("was", F.lit(None).cast(now.schema["best"].dataType))
        earlier = F.col("was").isNotNull() & (F.col("was.seq") < F.col("best.seq"))
        now = materialize(
            now.select("id", F.when(earlier, F.col("was")).otherwise(F.col("best")).alias("holder"), F.when(~earlier, F.col("was")).alias("was")),
            "bounds",
        )
        bounds.append(now.select("id", "holder"))
        refused = bids.join(now, "id").where(F.col("seq") > F.col("holder.seq")).select("pt")
        ousted = now.where("was.seq > holder.seq").select(F.col("was.pt").alias("pt"))
        hit = materialize(refused.unionByName(ousted).distinct(), "hit")
        if hit.isEmpty():
            return _standing(places).where("id IS NOT NULL").select("seq", "id", "score")
        if number % LOG_LENGTH == 0:
            places, bounds = [materialize(_standing(places), "places")], [materialize(_bound(bounds), "bound")]
        moved = _moved(_standing(places).join(hit, "pt", "left_semi"), lists.join(hit, "pt", "left_semi"), _bound(bounds))


def _union(log: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, log)


def _bound(bounds: list[DataFrame]) -> DataFrame:
    """Who asked first for a row (``id``, ``holder`` as a struct of ``seq`` and ``pt``)."""
    return _union(bounds).groupBy("id").agg(F.min_by("holder", "holder.seq").alias("holder"))


def _standing(places: list[DataFrame]) -> DataFrame:
    """The last place of every payment."""
    last = F.max_by(F.struct("k", "lb", "size", "id", "score", "round"), "round")
    return _union(places).groupBy("pt", "seq").agg(last.alias("p")).select("pt", "seq", "p.*")


def _moved(standing: DataFrame, lists: DataFrame, bound: DataFrame) -> DataFrame:
    """The payments of the losing types whose place changes, with their new ``lb``."""
    holder = bound.select("id", F.col("holder.seq").alias("h"))
    until = lists.select("pt", "pos", "id").join(holder, "id", "left")
    until = until.select("pt", "pos", F.coalesce("h", F.lit(_NEVER)).alias("h"))
    # h now rises along the list: up to which payment every row so far is gone
    risen = running(until, ["pt"], ["pos"], "h", "gone", "max")
    state = materialize(standing.join(holder, "id", "left"), "standing")
    losers = state.where("h < seq")
    events = risen.select("pt", F.col("gone").alias("at"), "pos", F.lit(0).alias("side")).unionByName(
        losers.select("pt", F.col("seq").alias("at"), F.lit(0).cast("bigint").alias("pos"), F.lit(1).alias("side"))
    )
    passed = running(events, ["pt"], ["at", "side", "pos"], "pos", "behind", "max")
    jump = passed.where("side = 1").select("pt", F.col("at").alias("seq"), (F.col("behind") + 1).alias("to"))
    pushed = state.join(jump, ["pt", "seq"], "left").withColumn(
        "spare", F.greatest(F.col("lb") + F.when(F.col("to").isNotNull(), 1).otherwise(0), F.col("to")) - F.col("k")
    )
    spread = running(pushed.select("pt", "seq", "k", "lb", "size", "spare"), ["pt"], ["seq"], "spare", "ahead", "max")
    new = F.col("ahead") + F.col("k")
    return spread.where(new != F.col("lb")).select("pt", "seq", "k", new.alias("lb"), "size")


def _preference_lists(edges: DataFrame, ledger: DataFrame) -> DataFrame:
    """Each payment type's ledger rows with their place, cut to the rows that can be reached.

    Rows of one ledger type are taken from the front by E and from the back by F, so no more
    than the number of payments around it can go on either end.
    """
    demand = edges.groupBy("lt").agg(
        F.max("n_l").alias("n_l"),
        F.sum(F.when(F.col("kind") == "E", F.col("n_p")).otherwise(0)).alias("front"),
        F.sum(F.when(F.col("kind") == "F", F.col("n_p")).otherwise(0)).alias("back"),
        F.min("l_first").alias("l_first"),
    )
    demand = materialize(demand, "demand")
    # a type of one row is that row; the ledger is read for copies alone
    usable = demand.where("n_l = 1").select("lt", "l_first.ord", "l_first.id")
    copied = demand.where("n_l > 1").drop("l_first")
    if not copied.isEmpty():
        named = copied.join(ledger.select(*_TYPE, F.col("id").alias("lt")), "lt")
        numbered = with_rank(ledger.join(named, _TYPE).drop(*_TYPE), ["lt"], ["ord", "id"], "r")
        usable = usable.unionByName(numbered.where("r <= front OR r > n_l - back").select("lt", "ord", "id"))
    rows = with_sequence(usable, ["ord", "id"], "lseq")
    pairs = edges.select("pt", "lt", "kind", "score").join(rows, "lt")
    way = F.when(F.col("kind") == "E", F.col("lseq")).otherwise(-F.col("lseq"))
    ranked = with_rank(
        pairs.select("pt", "id", "score", way.alias("way")), ["pt"], [F.desc("score"), F.asc("way")], "pos"
    )
    return materialize(ranked.select("pt", "pos", "id", "score"), "lists")
