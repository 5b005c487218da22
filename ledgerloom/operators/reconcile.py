"""Payments against the ledger: exact, duplicate, amount mismatch, fuzzy, unmatched, stale."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import ReconConfig
from ..functions import bands
from ..functions.scan import running, with_sequence
from ..functions.scratch import materialize
from ..functions.text import normalize_reference
from .assignment import assign
from .fuzzy import PAIRS_PER_BUCKET, fuzzy_edges

_TYPE = ["ref", "cur", "amount", "day"]
# stands for "no currency", which equals only itself
_NO_CURRENCY = "\x00"
# payment types of one reference that each of its ledger types is compared with directly; more of them meet in buckets
FEW_TYPES = 64


def _prepared(df: DataFrame, key: str, day: str, order: str) -> DataFrame:
    return df.select(
        F.col(key).cast("string").alias("id"),
        F.col(order).alias("ord"),
        normalize_reference(F.col("reference_id")).alias("ref"),
        F.coalesce(F.col("currency"), F.lit(_NO_CURRENCY)).alias("cur"),
        F.col("amount").cast("double").alias("amount"),
        F.to_date(day).alias("day"),
    )


def _stamp(as_of: datetime) -> Column:
    return F.lit(as_of.replace(tzinfo=None).isoformat(sep=" ")).cast("timestamp_ntz")


def _same(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    test = left[keys[0]].eqNullSafe(right[keys[0]])
    for k in keys[1:]:
        test = test & left[k].eqNullSafe(right[k])
    return test


def payment_types(queue: DataFrame) -> DataFrame:
    """Copies of a payment as one row: ``n_p`` of them, the first of which is ``pt``."""
    return queue.groupBy(*_TYPE).agg(F.count(F.lit(1)).alias("n_p"), F.min("seq").alias("pt"))


def known_types(types: DataFrame, book: DataFrame) -> DataFrame:
    """Ledger types of references that payments name, with the number ``n_t`` of payment types that do."""
    refs = types.groupBy("ref").agg(F.count(F.lit(1)).alias("n_t"))
    row = F.struct("ord", "id")
    return (
        book.join(refs, "ref").groupBy(*_TYPE)
        .agg(F.max("n_t").alias("n_t"), F.count(F.lit(1)).alias("n_l"), F.min("id").alias("lt"),
             F.min(row).alias("l_first"), F.max(row).alias("l_last"))
    )


def exact_edges(types: DataFrame, known: DataFrame, cfg: ReconConfig, few: int = FEW_TYPES) -> DataFrame:
    """Edges between payment and ledger types of one reference and currency, in both bands.

    A ledger type meets all payment types of its reference where these are at most ``few``; the others meet in buckets.
    """
    usable = bands.matchable(F.col("amount"), F.col("day"))
    asking = types.where(usable).withColumnsRenamed({"amount": "p_amount", "day": "p_day"})
    offered = known.where(usable)
    calm = asking.join(offered.where(F.col("n_t") <= few), ["ref", "cur"])
    crowded = offered.where(F.col("n_t") > few)
    placed = (
        asking.join(crowded.select("ref").distinct(), "ref", "left_semi")
        .withColumn("db", F.explode(bands.date_buckets(F.col("p_day"), cfg)))
        .withColumn("ab", F.explode(bands.amount_buckets(F.col("p_amount"), cfg)))
    )
    crowded = (
        crowded.withColumn("db", bands.date_bucket(F.col("day"), cfg))
        .withColumn("ab", bands.amount_bucket(F.col("amount"), cfg))
    )

    def close(pairs: DataFrame) -> DataFrame:
        near = pairs.where(bands.within_amount(F.col("p_amount"), F.col("amount"), cfg)
                           & bands.within_window(F.col("p_day"), F.col("day"), cfg))
        return near.select("pt", "lt", F.lit("E").alias("kind"), F.lit(1.0).alias("score"), "n_p", "n_l", "l_first", "l_last")

    if known.where(F.col("n_t") > few).isEmpty():
        return close(calm)
    return close(calm).unionByName(close(placed.join(crowded, ["ref", "cur", "db", "ab"])))


def classified(types: DataFrame, known: DataFrame, edges: DataFrame, cfg: ReconConfig) -> DataFrame:
    """Each payment type as E (has an exact edge), M (amount mismatch) or F (free for fuzzy).

    E types also have their first row ``first``, how many edges they have (``n_e``), and ledger type and size of the least.
    """
    firsts = edges.groupBy("pt").agg(
        F.min("l_first").alias("first"), F.count(F.lit(1)).alias("n_e"), F.min("lt").alias("lt"), F.min("n_l").alias("n_l")
    )
    looked = materialize(types.join(firsts, "pt", "left"), "looked")
    has_edge = looked.where("n_e IS NOT NULL").withColumn("kind", F.lit("E"))
    rest = looked.where("n_e IS NULL").select("pt", "n_p", *_TYPE)
    # few, mostly: what the ledger says of their references alone
    near_by = known.select("ref", "cur", "amount").join(rest.select("ref").distinct(), "ref", "left_semi")
    near_by = materialize(near_by, "near_by")
    refs = near_by.select("ref").distinct().withColumn("ref_known", F.lit(True))
    spans = (
        near_by.where(bands.finite(F.col("amount")))
        .withColumn("fb", bands.fine_bucket(F.col("amount"), cfg))
        .groupBy("ref", "cur", "fb")
        .agg(F.min("amount").alias("low"), F.max("amount").alias("high"))
    )
    number = F.when(bands.finite(F.col("amount")), F.col("amount"))
    rest = rest.join(refs, "ref", "left")
    rest = rest.withColumn("fb", F.explode_outer(bands.fine_buckets(number, cfg)))
    # the two ends of a narrow bucket decide whether any amount in it is within tolerance
    near = bands.within_amount(number, F.col("low"), cfg) | bands.within_amount(number, F.col("high"), cfg)
    others = (
        rest.join(spans, ["ref", "cur", "fb"], "left")
        .groupBy("pt", "n_p", *_TYPE, "ref_known")
        .agg(F.coalesce(F.bool_or(near), F.lit(False)).alias("agrees"))
    )
    kind = F.when(F.col("ref_known") & ~F.col("agrees"), "M").otherwise("F").alias("kind")
    others = materialize(others.select("pt", "n_p", *_TYPE, kind), "others")
    return has_edge.unionByName(others, allowMissingColumns=True)


def with_kinds(queue: DataFrame, kinds: DataFrame) -> DataFrame:
    """Every payment's type, as (``seq``, ``pt``, ``ref``, ``kind``, ``first``): the first of a type is its ``pt``, copies are looked up."""
    found = ["pt", "kind", "first"]
    firsts = kinds.select(F.col("pt").alias("seq"), *found, "ref")
    copied = kinds.where("n_p > 1")
    copies = queue.join(copied, _same(queue, copied, _TYPE)).where(F.col("seq") != F.col("pt"))
    return firsts.unionByName(copies.select("seq", *found, queue["ref"]))


def reference_groups(queue: DataFrame, book: DataFrame, cfg: ReconConfig) -> DataFrame:
    """One row per reference and currency that payments name: payments ``n_p`` and ledger rows ``n_l``, the first of each, ``mixed`` and ``plain``.

    Groups of a reference of several currencies are ``mixed``; the others hold all rows of their reference. A plain group
    is one payment and one ledger row, both with an id, in both bands: an exact edge without neighbours. Stored once.
    """
    asked, offered = F.struct("seq", "id", "amount", "day"), F.struct("ord", "id", "amount", "day")
    rows = queue.select("ref", "cur", asked.alias("p")).unionByName(book.select("ref", "cur", offered.alias("l")), allowMissingColumns=True)
    sides = [F.count("p").alias("n_p"), F.count("l").alias("n_l"), F.min("p").alias("p"), F.min("l").alias("l")]
    whole = rows.groupBy("ref").agg(*sides, F.min("cur").alias("cur"), F.max("cur").alias("last"))
    whole = materialize(whole.where("n_p > 0"), "groups")
    groups = whole.where("cur = last").drop("last").withColumn("mixed", F.lit(False))
    several = materialize(whole.where("cur != last").select("ref"), "mixed")
    if not several.isEmpty():
        parts = rows.join(several, "ref", "left_semi").groupBy("ref", "cur").agg(*sides).where("n_p > 0")
        groups = groups.unionByName(materialize(parts.withColumn("mixed", F.lit(True)), "mixed_groups"))
    p, l = F.col("p"), F.col("l")  # noqa: E741
    plain = (
        (F.col("n_p") == 1) & (F.col("n_l") == 1) & l["id"].isNotNull()
        & bands.matchable(p["amount"], p["day"]) & bands.matchable(l["amount"], l["day"])
        & bands.within_amount(p["amount"], l["amount"], cfg) & bands.within_window(p["day"], l["day"], cfg)
    )
    return groups.withColumn("plain", F.coalesce(plain, F.lit(False)))


def other_payments(queue: DataFrame, groups: DataFrame) -> DataFrame:
    """The payments of groups that are not plain; a lone payment is in its group's row, the others are looked up."""
    lone = groups.where("n_p = 1 AND NOT plain").select("p.seq", "p.id", "ref", "cur", "p.amount", "p.day")
    several = materialize(groups.where("n_p > 1").select("ref", "cur"), "several")
    return lone.unionByName(queue.join(several, ["ref", "cur"], "left_semi").select(*lone.columns))


def other_rows(book: DataFrame, groups: DataFrame) -> DataFrame:
    """All ledger rows of the references of ``other_payments``; a lone row is in its group's row, the others are looked up."""
    lone = groups.where("n_l = 1 AND NOT mixed AND NOT plain").select("l.ord", "l.id", "ref", "cur", "l.amount", "l.day")
    several = materialize(groups.where("n_l > 1 OR mixed").select("ref").distinct(), "several_rows")
    return lone.unionByName(book.join(several, "ref", "left_semi").select(*lone.columns))


def shared_rows(edges: DataFrame, plain: DataFrame) -> DataFrame:
    """Ledger types that more than one edge leads to."""
    ends = edges.select("lt").unionByName(plain.select(F.col("l.id").alias("lt")))
    return ends.groupBy("lt").agg(F.count(F.lit(1)).alias("d_l")).where("d_l > 1").select("lt")


def lone_pairs(kinds: DataFrame, shared: DataFrame) -> DataFrame:
    """E types whose one edge is also the only one of its ledger type, with a single row on either side: (``pt``, ``id``)."""
    single = kinds.where("n_e = 1 AND lt IS NOT NULL AND (n_l = 1 OR n_p = 1)")
    return single.join(shared, "lt", "left_anti").select("pt", F.col("first.id").alias("id"))


def mismatch_links(mismatched: DataFrame, book: DataFrame, taken: DataFrame) -> DataFrame:
    """For M payments (``seq``, ``ref``): the first row of the reference not yet taken, else its first row."""
    row = F.struct("ord", "id")
    mismatched = materialize(mismatched, "mismatched")
    asked = materialize(book.join(mismatched.select("ref").distinct(), "ref", "left_semi").select("ref", "ord", "id"), "asked")
    # of all rows taken, those asked for are few, mostly
    taken = taken.join(asked.select("id").distinct(), "id", "left_semi").select("id", F.col("seq").alias("at"))
    rows = materialize(asked.join(taken, "id", "left").select("ref", "ord", "id", "at"), "asked_rows")
    heads = rows.groupBy("ref").agg(
        F.min(row).alias("any_row"), F.min(F.when(F.col("at").isNull(), row)).alias("free_row")
    )
    later = (
        rows.where("at IS NOT NULL").join(heads, "ref")
        .where(F.col("free_row").isNull() | (row < F.col("free_row")))
        .select("ref", "at", row.alias("row"))
    )
    linked = mismatched.join(heads, "ref", "left")
    if later.isEmpty():
        return linked.select("seq", F.coalesce("free_row", "any_row")["id"].alias("link"))
    # rows taken after this payment's turn were still free then: a running minimum from the back
    events = later.unionByName(
        mismatched.select("ref", F.col("seq").alias("at"), F.lit(None).cast(later.schema["row"].dataType).alias("row"))
    )
    open_then = running(events, ["ref"], [F.desc("at")], "row", "open_row", "min")
    open_then = open_then.where("row IS NULL").select(F.col("at").alias("seq"), "open_row")
    choice = F.coalesce(F.least("free_row", "open_row"), "any_row")
    return linked.join(open_then, "seq", "left").select("seq", choice["id"].alias("link"))


def match_payments(
    payments: DataFrame,
    ledger: DataFrame,
    cfg: ReconConfig,
    as_of: datetime,
    payment_order: str = "payment_id",
    ledger_order: str = "transaction_id",
    pairs_per_bucket: int = PAIRS_PER_BUCKET,
) -> DataFrame:
    """One row per payment: ``seq``, ids, status, method, confidence and reason. Stored once.

    Plain groups are settled by one aggregate, unless a fuzzy edge or a repeated id leads to their ledger row;
    types, edges and rounds are made of the other payments.
    """
    queue = with_sequence(_prepared(payments, "payment_id", "payment_date", payment_order), ["ord", "id"], "seq")
    book = _prepared(ledger, "transaction_id", "posting_date", ledger_order)
    groups = reference_groups(queue, book, cfg)
    plain = groups.where("plain").withColumn("l", F.struct("l.ord", "l.id"))
    queue = materialize(other_payments(queue, groups), "others_queue")
    types = materialize(payment_types(queue), "types")

    near_book = materialize(other_rows(book, groups), "others_book")
    known = materialize(known_types(types, near_book), "known")
    exact = materialize(exact_edges(types, known, cfg), "exact")
    kinds = classified(types, known, exact, cfg)
    fuzzy = materialize(fuzzy_edges(kinds.where("kind = 'F'"), book, cfg, pairs_per_bucket), "fuzzy")

    edges = exact.unionByName(fuzzy)
    shared = materialize(shared_rows(edges, plain), "shared")
    named = plain.withColumn("lt", F.col("l.id"))
    clear, met = named.join(shared, "lt", "left_anti"), materialize(named.join(shared, "lt", "left_semi"), "met")
    typed = with_kinds(queue, kinds).unionByName(
        met.select("p.seq", F.col("p.seq").alias("pt"), "ref", F.lit("E").alias("kind"), F.col("l").alias("first"))
    )
    typed = materialize(typed, "typed")
    lone = materialize(lone_pairs(kinds, shared), "lone")
    disputed = edges.join(lone.select("pt"), "pt", "left_anti").unionByName(met.select(
        F.col("p.seq").alias("pt"), "lt", F.lit("E").alias("kind"), F.lit(1.0).alias("score"),
        F.lit(1).cast("bigint").alias("n_p"), F.lit(1).cast("bigint").alias("n_l"), F.col("l").alias("l_first"), F.col("l").alias("l_last"),
    ))
    rest = assign(materialize(disputed, "disputed"), typed.select("seq", "pt"), book)
    settled = lone.select(F.col("pt").alias("seq"), "id", F.lit(1.0).alias("score"))
    pairs = materialize(settled.unionByName(rest), "pairs")

    taken = pairs.select("seq", "id").unionByName(clear.select("p.seq", "l.id"))
    links = mismatch_links(typed.where("kind = 'M'").select("seq", "ref"), near_book, taken)
    queue = queue.select("seq", "id", "amount", "day").unionByName(met.select("p.seq", "p.id", "p.amount", "p.day"))
    outcome = (
        queue.withColumnRenamed("id", "payment_id").join(typed.drop("ref"), "seq")
        .join(pairs, "seq", "left").join(links, "seq", "left")
    )
    got, kind = F.col("id").isNotNull(), F.col("kind")
    overdue = bands.is_stale(F.col("day"), as_of, cfg)
    status = (
        F.when(got, "matched").when(kind.isin("E", "M"), "exception")
        .when(overdue, "exception").otherwise("unmatched_payment")
    )
    reason = F.when(~got, F.when(kind == "E", "duplicate").when(kind == "M", "amount_mismatch").when(overdue, "stale"))
    outcome = outcome.select(
        "seq", "payment_id", "amount",
        F.when(got, F.col("id")).when(kind == "E", F.col("first.id")).otherwise(F.col("link")).alias("ledger_transaction_id"),
        status.alias("match_status"),
        F.when(got, F.when(kind == "E", "exact").otherwise("fuzzy")).alias("match_method"),
        F.when(kind == "E", 1.0).when(got, F.round("score", 4)).otherwise(0.0).alias("match_confidence"),
        reason.alias("exception_reason"),
    )
    at_once = clear.select(
        "p.seq", F.col("p.id").alias("payment_id"), "p.amount", F.col("l.id").alias("ledger_transaction_id"),
        F.lit("matched").alias("match_status"), F.lit("exact").alias("match_method"), F.lit(1.0).alias("match_confidence"),
        F.lit(None).cast("string").alias("exception_reason"),
    )
    return materialize(at_once.unionByName(outcome), "matched")


def unmatched_ledger(ledger: DataFrame, matched: DataFrame, ledger_order: str = "transaction_id") -> DataFrame:
    """Ledger rows no payment took, numbered in ledger order."""
    used = matched.where("match_status = 'matched'").select(F.col("ledger_transaction_id").alias("id"))
    left = ledger.select(F.col("transaction_id").cast("string").alias("id"), F.col(ledger_order).alias("ord"))
    # stored, as a range partition reads its input twice
    left = materialize(left.join(used, "id", "left_anti"), "left_over")
    return with_sequence(left, ["ord", "id"], "seq").select("seq", "id")


def results(
    matched: DataFrame, left_over: DataFrame, batch_id: str, as_of: datetime, reconciled_by: str = "system"
) -> DataFrame:
    """Rows of ``reconciliation_results``: the payments, then the unmatched ledger rows."""
    nothing = F.lit(None).cast("string")
    tail = [_stamp(as_of).alias("reconciled_at"), F.lit(reconciled_by).alias("reconciled_by")]
    ours = matched.select(
        F.format_string(f"RECON-{_plain(batch_id)}-%06d", "seq").alias("recon_id"), F.lit(batch_id).alias("batch_id"),
        "payment_id", "ledger_transaction_id", "match_status", "match_confidence", "match_method",
        "exception_reason", *tail,
    )
    theirs = left_over.select(
        F.format_string(f"RECON-{_plain(batch_id)}-L%06d", "seq").alias("recon_id"), F.lit(batch_id).alias("batch_id"),
        nothing.alias("payment_id"), F.col("id").alias("ledger_transaction_id"),
        F.lit("unmatched_ledger").alias("match_status"), F.lit(0.0).alias("match_confidence"),
        nothing.alias("match_method"), nothing.alias("exception_reason"), *tail,
    )
    return ours.unionByName(theirs)


def _plain(text: str) -> str:
    return text.replace("%", "%%")


def run_summary(matched: DataFrame, ledger: DataFrame, batch_id: str) -> DataFrame:
    """The counters of one run in one row; the rate is a fraction of the payments."""
    status, method, reason = F.col("match_status"), F.col("match_method"), F.col("exception_reason")
    counted = matched.agg(
        F.count(F.lit(1)).alias("payments_processed"),
        F.count_if(method == "exact").alias("matched_exact"),
        F.count_if(method == "fuzzy").alias("matched_fuzzy"),
        F.count_if(status == "matched").alias("matched_total"),
        F.count_if(status == "unmatched_payment").alias("unmatched_payment"),
        F.count_if(reason == "duplicate").alias("exception_duplicate"),
        F.count_if(reason == "amount_mismatch").alias("exception_amount_mismatch"),
        F.count_if(reason == "stale").alias("exception_stale"),
        F.count_if(status == "exception").alias("exception_total"),
        F.coalesce(F.round(F.sum(F.when(status == "matched", F.col("amount"))), 2), F.lit(0.0)).alias("total_amount_reconciled"),
    )
    size = ledger.agg(F.count(F.lit(1)).alias("n")).scalar()
    rate = F.when(F.col("payments_processed") > 0, F.round(F.col("matched_total") / F.col("payments_processed"), 4))
    return counted.select(
        F.lit(batch_id).alias("batch_id"), "payments_processed", size.alias("ledger_records_processed"),
        "matched_exact", "matched_fuzzy", "matched_total", "unmatched_payment", "exception_duplicate",
        "exception_amount_mismatch", "exception_stale", "exception_total",
        (size - F.col("matched_total")).alias("unmatched_ledger"), "total_amount_reconciled",
        F.coalesce(rate, F.lit(0.0)).alias("reconciliation_rate"),
    )


def payment_status(payments: DataFrame, matched: DataFrame) -> DataFrame:
    """``payments`` with the status of this run; payments outside it keep theirs.

    Rows that share an id get the status of the last of them in matching order.
    """
    status = F.col("match_status")
    said = F.when(status == "matched", "matched").when(status == "exception", "exception").otherwise("unmatched")
    new = matched.groupBy("payment_id").agg(F.max_by(said, "seq").alias("new_status"))
    updated = payments.join(new, "payment_id", "left")
    return updated.select(
        *[F.coalesce("new_status", "status").alias("status") if c == "status" else F.col(c) for c in payments.columns]
    )


def moved_payments(payments: DataFrame, matched: DataFrame) -> DataFrame:
    """Ids of payments whose status this run changes."""
    after = payment_status(payments.withColumn("_was", F.col("status")), matched)
    return after.where(~F.col("status").eqNullSafe(F.col("_was"))).select("payment_id").distinct()


def audit_rows(matched: DataFrame, batch_id: str) -> DataFrame:
    """Events of a run, unchained: one per match or exception, in payment order."""
    recon_id = F.format_string(f"RECON-{_plain(batch_id)}-%06d", "seq")
    kind = F.when(F.col("match_status") == "matched", "match").otherwise("exception_open")
    return matched.where("match_status IN ('matched', 'exception')").select(
        F.col("seq").alias("ord"), kind.alias("event_type"),
        F.when(kind == "match", "reconciliation").otherwise("exception").alias("entity_type"),
        recon_id.alias("entity_id"), kind.alias("action"), F.lit(batch_id).alias("batch_id"),
    )
