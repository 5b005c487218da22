"""Conversation structure repair by a parallel Viterbi search with rank convergence.

A conversation is legal where the initials of its roles read ``(s?(ua)+)?``. Each row is kept (0), given the
role user or assistant (2) or deleted (3, the only way for blank and duplicate rows); empty rows of user or
assistant are inserted (2); a truncated row that stays costs 1. The cheapest edits win, and of these the
ASCII-least string of their initials D, I, K, R.

The search has four states: nothing yet, after s, after u, after a. Rows lie in a range-sorted table and are
cut into chunks of at most ``chunk`` rows, each a short string of row kinds. All chunks compute their backward
costs at once, each from a guessed cost vector at its end. In a fix-up pass, a chunk whose guess is not
parallel to what the next chunk found runs again from that vector, until its new costs differ from its old
ones by a constant only; from there on the old ones hold. A pass lets up to 2, 4, 8, ... neighbouring chunks
follow one another, so that chunks which never converge need few passes. When no chunk is due, the costs
are stitched: the sum of the chunks' constants is the cost. Tracing goes forward in the same way, from a
guessed state, and takes the first letter of D, I, K, R that lies on a cheapest way: from a state each letter
leads to one state, so the string is the ASCII-least.

Defined results: null roles and texts are one space. A role outside s, u, a (an empty one included) fits
nowhere and is reroled or deleted. Rows go by turn, nulls first, ties by role and the MD5 of the text; equal
rows are interchangeable. A null conversation id is a conversation of its own. An empty table gives no rows.
Other columns are ignored. What is one value by its meaning, the audit and the hash of a conversation, is
made by streaming over its sorted rows; all else is by chunk.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scan import with_rank
from ..functions.scratch import materialize
from .common import WORD, give_back

DELETE, CHANGE = 3, 2
# state after a role of class s, u, a (0, 1, 2) where it may stand; states: 0 nothing, 1 after s, 2 after u, 3 after a
NEXT = ({0: 1, 1: 2}, {1: 2}, {2: 3}, {1: 2})
# state after the one role that can be made or inserted there
MADE = (2, 2, 3, 2)
# costs once all rows are read: an even end, or the insertions up to it
END = (0, 4, 2, 0)
TAIL = ("", "ua", "a", "")
SPACE = " \t\n\x0b\x0c\r"
_DOUBLINGS = 10


def _relaxed(costs: list[int]) -> list[int]:
    for _ in range(3):  # more insertions in a row than two are never cheaper
        costs = [min(c, CHANGE + costs[MADE[q]]) for q, c in enumerate(costs)]
    return costs


@lru_cache(maxsize=None)
def costs_before(symbol: int, after: tuple[int, ...]) -> tuple[int, ...]:
    """Cost to go before a row, by state, from those behind it."""
    kind, fault = symbol % 4, symbol // 4
    costs = [DELETE + after[q] for q in range(4)]
    if fault < 2:
        for q in range(4):
            if kind in NEXT[q]:
                costs[q] = min(costs[q], fault + after[NEXT[q][kind]])
            costs[q] = min(costs[q], CHANGE + fault + after[MADE[q]])
    return tuple(_relaxed(costs))


@lru_cache(maxsize=None)
def step_back(symbol: int, after: str) -> tuple[str, int]:
    """The cost vector before a row, less its least entry, and that entry. Vectors are strings of four letters."""
    costs = costs_before(symbol, unpacked(after))
    least = min(costs)
    return packed(costs, least), least


def packed(costs: tuple[int, ...], less: int = 0) -> str:
    return "".join(chr(48 + c - less) for c in costs)


def unpacked(vector: str) -> tuple[int, ...]:
    return tuple(ord(c) - 48 for c in vector)


@lru_cache(maxsize=None)
def step_on(state: int, symbol: int, after: str) -> tuple[str, int]:
    """The ASCII-least edits of a row on a cheapest way: u, a for insertions, then K, D, U or A."""
    behind = unpacked(after)
    costs = costs_before(symbol, behind)
    kind, fault, out = symbol % 4, symbol // 4, ""
    while True:
        made = MADE[state]
        if DELETE + behind[state] == costs[state]:
            return out + "D", state
        if CHANGE + costs[made] == costs[state]:
            out, state = out + ("a" if made == 3 else "u"), made
        elif fault < 2 and kind in NEXT[state] and fault + behind[NEXT[state][kind]] == costs[state]:
            return out + "K", NEXT[state][kind]
        else:
            return out + ("A" if made == 3 else "U"), made


def run_back(symbols: str, given: str, old: tuple[str, str, int] | None = None, _: str = "") -> tuple[str, str, int]:
    """Costs of a chunk from the vector at its end: the vector at its start, those behind each row, the constant.

    With ``old`` (an earlier run's results) it stops where the two runs' vectors are parallel.
    """
    vectors, vector, total = [], given, 0
    behind = old[1] if old else None
    # constants of the earlier run, row by row from the end, are the same steps again and need no storing
    for i in range(len(symbols) - 1, -1, -1):
        if behind is not None and behind[4 * i : 4 * i + 4] == vector:
            made, kept, cost = old
            spent = 0
            for j in range(len(symbols) - 1, i, -1):
                spent += step_back(ord(symbols[j]) - 65, behind[4 * j : 4 * j + 4])[1]
            return made, behind[: 4 * i + 4] + "".join(reversed(vectors)), total + cost - spent
        vectors.append(vector)
        vector, least = step_back(ord(symbols[i]) - 65, vector)
        total += least
    return vector, "".join(reversed(vectors)), total


_EDIT = re.compile("[ua]*[KDUA]")


def run_on(symbols: str, given: str, old: tuple[str, str, int] | None = None, vectors: str = "", was: str = "") -> tuple[str, str, int]:
    """Edits of a chunk from the state at its start: the state at its end and the letters, row by row."""
    out, state, other = [], int(given), int(was) if old else -1
    for i, symbol in enumerate(symbols):
        if state == other:  # from here on the earlier run's edits hold
            return old[0], "".join(out) + "".join(_EDIT.findall(old[1])[i:]), 0
        after = vectors[4 * i : 4 * i + 4]
        letters, state = step_on(state, ord(symbol) - 65, after)
        out.append(letters)
        if old:
            other = step_on(other, ord(symbol) - 65, after)[1]
    return str(state), "".join(out), 0


_HELD = "key string, idx bigint, chunks bigint, symbols string, vectors string, given string, made string, kept string, cost bigint"
_NAMES = [f.split()[0] for f in _HELD.split(", ")]


def _back(symbols: str, vectors: str, given: str, old: tuple | None, was: str) -> tuple[str, str, int]:
    return run_back(symbols, given, old)


def _on(symbols: str, vectors: str, given: str, old: tuple | None, was: str) -> tuple[str, str, int]:
    return run_on(symbols, given, old, vectors, was)


def settle(chunks: DataFrame, run: Callable, guess: Callable[[int, int], str], towards: int) -> DataFrame:
    """Run all chunks from guesses, then again those whose guess is not what their neighbour hands on.

    ``towards`` is 1 where a chunk starts from what the next one made, -1 where from the one before.
    """

    def first(batches):
        for batch in batches:
            rows = batch.to_pydict()
            made = []
            for idx, n, symbols, vectors in zip(rows["idx"], rows["chunks"], rows["symbols"], rows["vectors"]):
                given = guess(idx, n)
                made.append((given, *run(symbols, vectors, given, None, "")))
            columns = list(zip(*made)) if made else [()] * 4
            kinds = (pa.string(), pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in _NAMES[:5]] + [pa.array(c, k) for c, k in zip(columns, kinds)], names=_NAMES)

    def again(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: -towards * r["idx"])
        handed = rows[0]["wanted"]
        for r in rows:
            if handed is not None and handed != r["given"]:
                r["made"], r["kept"], r["cost"] = run(r["symbols"], r["vectors"], handed, (r["made"], r["kept"], r["cost"]), r["given"])
                r["given"] = handed
            handed = r["made"]
        return pa.Table.from_pylist(rows).select(_NAMES).cast(pa.schema([(c, pa.int64() if c in ("idx", "chunks", "cost") else pa.string()) for c in _NAMES]))

    held = materialize(chunks.select(_NAMES[:5]).mapInArrow(first, _HELD), "chunks")
    alone, open_, span = held.where("chunks = 1"), held.where("chunks > 1"), 1
    while True:
        handed = open_.select("key", (F.col("idx") - towards).alias("idx"), F.col("made").alias("wanted"))
        due = open_.join(handed, ["key", "idx"], "left")
        if due.where("wanted <> given").isEmpty():
            return alone.unionByName(open_)
        groups = due.groupBy("key", F.shiftright("idx", span).alias("span"))
        open_ = materialize(groups.applyInArrow(again, _HELD), "chunks")
        span = min(span + 1, _DOUBLINGS)


def _ends_open(text: Column) -> Column:
    return ~F.right(F.rtrim(text, F.lit(SPACE)), F.lit(1)).isin(".", "!", "?")


def staged(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", chunk: int = 64) -> DataFrame:
    """Rows in order with key, conv, row, part (chunks are the rows of one key and part), turn, role, text, kind, fault."""
    said = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in (role, text)]
    rows = turns.select(
        F.coalesce(F.col(conv).cast("string"), F.lit(" ")).alias("key"), F.col(conv).cast("bigint").alias("conv"), F.col(turn).cast("bigint").alias("turn"),
        said[0].alias("role"), said[1].alias("text"), F.md5(said[1].cast("binary")).alias("mark"), F.monotonically_increasing_id().alias("salt"),
    )
    order = [F.col("key"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("mark"), F.col("salt")]
    sorted_ = rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("salt")
    held = materialize(sorted_.withColumn("row", F.monotonically_increasing_id()), "turns")
    repeated = held.groupBy("key", "role", "mark").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    blank, again = ~F.col("text").rlike(WORD), F.coalesce(F.col("row") > F.col("first"), F.lit(False))
    fault = F.when(blank, "blank").when(again, "duplicate").when(_ends_open(F.col("text")), "truncated")
    initial = F.left("role", F.lit(1))
    kind = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    return held.join(repeated, ["key", "role", "mark"], "left").select(
        "key", "conv", "row", F.floor(F.col("row") / chunk).alias("part"), "turn", "role", "text", kind.alias("kind"), fault.alias("fault")
    )


def chunked(rows: DataFrame) -> DataFrame:
    """A row per chunk: key, part, idx (from 0 within the key), chunks, first (its first row), symbols, before (the symbol before it)."""
    weight = F.when(F.col("fault") == "truncated", 1).when(F.col("fault").isNotNull(), 2).otherwise(0)
    symbol = F.char(F.lit(65) + F.col("kind") + 4 * weight)
    letters = F.transform(F.sort_array(F.collect_list(F.struct("row", symbol.alias("s")))), lambda x: x["s"])
    parts = rows.groupBy("key", "part").agg(F.min("row").alias("first"), F.array_join(letters, "").alias("symbols"))
    placed = with_rank(parts, ["key"], ["part"], "idx").withColumn("idx", F.col("idx") - 1)
    counted = placed.join(placed.groupBy("key").agg(F.count(F.lit(1)).alias("chunks")), "key")
    before = placed.select("key", (F.col("idx") + 1).alias("idx"), F.right("symbols", F.lit(1)).alias("before"))
    return materialize(counted.join(before, ["key", "idx"], "left"), "parts")


def _illegal(symbols: Column, before: Column) -> Column:
    """Neighbouring rows whose initials are not su, ua or au."""
    kinds = F.translate(F.concat(F.coalesce(before, F.lit("")), symbols), "ABCDEFGHIJKL", "suaosuaosuao")
    legal = F.length(kinds) - F.length(F.regexp_replace(kinds, "s(?=u)|u(?=a)|a(?=u)", ""))
    return F.length(kinds) - 1 - legal


def edits(parts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, cost) of every conversation, and (key, row, letters): the edits at each row; rows past the last have a null ``row``."""
    plain = parts.withColumn("vectors", F.lit(""))
    back = settle(plain, _back, lambda idx, n: packed(END), 1)
    opening = F.when(F.col("idx") == 0, F.ascii("made") - 48).otherwise(0)
    cost = back.groupBy("key").agg(F.sum(F.col("cost") + opening).alias("cost"))
    # usually a chunk is entered after a reply
    on = settle(back.withColumn("vectors", F.col("kept")), _on, lambda idx, n: "3" if idx else "0", -1)
    traced = on.join(parts.select("key", "idx", "first"), ["key", "idx"])
    letters = traced.select("key", "first", F.posexplode(F.regexp_extract_all("kept", F.lit("([ua]*[KDUA])"), F.lit(1))).alias("k", "letters"))
    tails = F.element_at(F.array(*[F.lit(t) for t in TAIL]), F.col("made").cast("int") + 1)
    ends = on.where("idx = chunks - 1").select("key", F.lit(None).cast("bigint").alias("row"), tails.alias("letters")).where("letters <> ''")
    return cost, letters.select("key", (F.col("first") + F.col("k")).alias("row"), "letters").unionByName(ends)


def repaired(rows: DataFrame, made: DataFrame) -> DataFrame:
    """(key, row, letters, lines): the lines ``role:text`` that stand at each row after repair, insertions first."""
    inserted = F.transform(
        F.filter(F.split("letters", ""), lambda x: x.isin("u", "a")), lambda x: F.when(x == "u", "user:").otherwise("assistant:")
    )
    last = F.right("letters", F.lit(1))
    role = F.when(last == "K", F.col("role")).when(last == "U", "user").when(last == "A", "assistant")
    own = F.when(role.isNotNull(), F.array(F.concat(role, F.lit(":"), "text"))).otherwise(F.array().cast("array<string>"))
    named = made.withColumnRenamed("key", "k")
    joined = named.join(rows.select("row", "role", "text"), "row", "left")
    return joined.select(F.col("k").alias("key"), "row", "letters", F.concat(inserted, own).alias("lines"))


def digests(lines: DataFrame) -> DataFrame:
    """(key, audit, repaired_sha256), streamed over each conversation's rows in order; a text is held for a row at most."""

    def run(batches):
        key, audit, sha, some = None, [], hashlib.sha256(), False
        names = ["key", "audit", "repaired_sha256"]

        def out():
            return pa.RecordBatch.from_arrays([pa.array([v], pa.string()) for v in (key, "".join(audit), sha.hexdigest())], names=names)

        for batch in batches:
            for k, letters, said in zip(*(batch.column(c).to_pylist() for c in ("key", "letters", "lines"))):
                if k != key:
                    if key is not None:
                        yield out()
                    key, audit, sha, some = k, [], hashlib.sha256(), False
                audit.append(letters.translate(_INITIALS))
                for line in said:
                    sha.update(b"\n" + line.encode() if some else line.encode())
                    some = True
        if key is not None:
            yield out()
        give_back()

    order = [F.col("key"), F.col("row").asc_nulls_last()]
    sorted_ = lines.repartition("key").sortWithinPartitions(*order).select("key", "letters", "lines")
    return sorted_.mapInArrow(run, "key string, audit string, repaired_sha256 string")


_INITIALS = str.maketrans("uaUA", "IIRR")


def summary(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", chunk: int = 64) -> DataFrame:
    """A row per conversation of ``turns``: conv, gaps, faults and illegal neighbours before, cost, audit and hash of the repair."""
    rows = staged(turns, conv, turn, role, text, chunk)
    parts = chunked(rows)
    cost, made = edits(parts)
    faults = rows.groupBy("key").agg(
        F.min("conv").alias("conv"), F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).alias("gaps"),
        *[F.count_if(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")],
    )
    illegal = parts.groupBy("key").agg(F.sum(_illegal(F.col("symbols"), F.col("before"))).cast("bigint").alias("illegal"))
    whole = faults.join(illegal, "key").join(cost, "key").join(digests(repaired(rows, made)), "key")
    return whole.select("key", "conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def damaged(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows with faults planted by crc32 of ``conv:turn`` modulo 20; nulls are one space there and in role and text."""
    blank = F.lit(" ")
    named = F.concat(F.coalesce(F.col(conv).cast("string"), blank), F.lit(":"), F.coalesce(F.col(turn).cast("string"), blank))
    rows = turns.select(
        F.col(conv).cast("bigint").alias("conv_id"), F.col(turn).cast("bigint").alias("turn"), F.coalesce(F.col(role), blank).alias("role"),
        F.coalesce(F.col(text), blank).alias("text"), (F.crc32(named.cast("binary")) % 20).alias("h"),
    ).where("h <> 0")
    said = F.when(F.col("h") == 1, "").when(F.col("h") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(F.col("h") == 4, "user").otherwise(F.col("role")).alias("role"), said.alias("text"), "h")
    copies = F.when(F.col("h") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.withColumn("copy", F.explode(copies)).drop("h", "copy")


def repair_damaged(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", chunk: int = 64) -> DataFrame:
    """Every conversation of ``turns``, damaged and repaired; one without rows after damage has zeros and an empty audit."""
    found = summary(damaged(turns, conv, turn, role, text), chunk=chunk)
    named = F.coalesce(F.col(conv).cast("string"), F.lit(" ")).alias("key")
    whole = turns.select(named, F.col(conv).cast("bigint").alias("conv_id")).distinct().join(found.drop("conv"), "key", "left")
    counts = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    none = hashlib.sha256().hexdigest()
    return whole.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(none)).alias("repaired_sha256"))
