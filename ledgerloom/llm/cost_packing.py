"""Pack documents into training sequences so that tokens fit and attention cost is even.

A piece of n tokens costs ``linear * n + quadratic * n * n``, as attention stays inside a document.
Each task encodes its documents and packs them pool by pool. Documents longer than a sequence give
full sequences first. The rest go, dearest first, to the lowest-cost sequence that has room for them;
where none has, the document is cut and fills the cheapest of those with most room (by powers of two). Sequences of a pool are
all full: as many of ``capacity`` as the tokens fill, the remainder as powers of two, which need no
padding. So nothing is padded.

Defined results: a null text is empty and has the end id alone. Repeated rows are packed each. Equal
costs go to the earlier sequence, equal lengths by place in the input. An empty table gives no rows.
Other columns are ignored. A pool holds ``pool_tokens`` tokens and one document more, which bounds a
task's memory. Without ``order`` no rows are shuffled, so a large source or group of copies has no effect.
With it, rows are range-partitioned and sorted by it: pools are cut from that order and ``sequence_id`` rises
with it from pool to pool (inside a pool documents go by length).
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import give_back, slices
from .tokens import encoder, ended

CAPACITY = 2048
POOL_TOKENS = 1 << 21


def capacities(total: int, capacity: int = CAPACITY) -> list[int]:
    """Full sequences, then the powers of two that sum up to the rest."""
    rest = total % capacity
    return [capacity] * (total // capacity) + [1 << b for b in reversed(range(rest.bit_length())) if rest >> b & 1]


def pack(lengths: list[int], capacity: int = CAPACITY, linear: float = 1.0, quadratic: float = 1 / 1024) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) that fill the sequences of ``capacities`` exactly."""
    room = capacities(sum(lengths), capacity)
    pieces, used, cost = [], [0] * len(room), [0.0] * len(room)

    def place(doc: int, start: int, n: int, s: int) -> None:
        pieces.append((doc, start, n, s, used[s]))
        used[s] += n
        cost[s] += linear * n + quadratic * n * n

    first, rest = 0, []
    for doc, length in enumerate(lengths):
        whole = length // capacity
        for k in range(whole):
            place(doc, k * capacity, capacity, first)
            first += 1
        if length % capacity:
            rest.append((length % capacity, doc, whole * capacity))
    # open sequences by exact room: a heap by cost for each room, the least cost of each, and a bit for each room in use
    open_: list[list[tuple[float, int]]] = [[] for _ in range(capacity + 1)]
    least, rooms = np.full(capacity + 1, np.inf), 0

    def cheapest(low: int, high: int) -> int:
        """The room, from ``low`` to ``high``, of the open sequence of lowest cost; the earlier sequence where costs are equal."""
        part = least[low : high + 1]
        at = int(part.argmin())
        same = np.flatnonzero(part == part[at])
        if len(same) > 1:
            return min((open_[low + i][0][1], low + i) for i in same.tolist())[1]
        return low + at

    for s in range(first, len(room)):
        heapq.heappush(open_[room[s]], (0.0, s))
        least[room[s]], rooms = 0.0, rooms | 1 << room[s]
    for length, doc, start in sorted(rest, key=lambda r: (-r[0], r[1])):
        while length:
            if rooms >> length:
                left = cheapest(length, capacity)
            else:  # cut: fill the cheapest of those with most room, by powers of two
                bit = (rooms.bit_length() - 1).bit_length() - 1
                left = cheapest(1 << bit, min((2 << bit) - 1, capacity))
            s = heapq.heappop(open_[left])[1]
            n = min(length, left)
            place(doc, start, n, s)
            for r in (left, left - n):
                if r and r == left - n:
                    heapq.heappush(open_[r], (cost[s], s))
                    rooms |= 1 << r
                if open_[r]:
                    least[r] = open_[r][0][0]
                elif r:
                    least[r], rooms = np.inf, rooms & ~(1 << r)
            start, length = start + n, length - n
    return pieces


def pieces(
    docs: DataFrame,
    tokenizer: str,
    end: int = 1,
    key: str = "doc_id",
    text: str = "text",
    capacity: int = CAPACITY,
    pool_tokens: int = POOL_TOKENS,
    with_ids: bool = False,
    order: Sequence[Column] = (),
) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and its ids if asked for."""
    schema = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"

    def packed(keys: list, ids: np.ndarray, ends: np.ndarray, base: int):
        offsets = np.concatenate([[0], ends])
        rows, n = [], 0
        for doc, start, length, s, offset in pack(np.diff(offsets).tolist(), capacity):
            at = offsets[doc] + start
            own = ids[at : at + length].tobytes()
            row = (keys[doc], start, length, zlib.crc32(own), int(offsets[doc + 1] - offsets[doc]), base + s, offset)
            rows.append((*row, own) if with_ids else row)
            n = max(n, s + 1)
        columns = [pa.array(c, type=pa.binary() if i == 7 else pa.int64()) for i, c in enumerate(zip(*rows))]
        names = [c.split()[0] for c in schema.split(", ")] + ["ids"] * with_ids
        return pa.RecordBatch.from_arrays(columns, names=names), n

    def run(batches):
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 33
        keys, ids, ends, held = [], [], [], 0
        for batch in batches:
            for piece in slices(batch, "text", 1 << 21):
                own, offsets = ended(*encoder(tokenizer).encode(piece.column("text")), end)
                keys += piece.column("key").to_pylist()
                ids.append(own)
                ends.append(offsets[1:] + held)
                held += len(own)
                if held >= pool_tokens:
                    out, n = packed(keys, np.concatenate(ids), np.concatenate(ends), base)
                    yield out
                    base += n
                    keys, ids, ends, held = [], [], [], 0
        if held:
            yield packed(keys, np.concatenate(ids), np.concatenate(ends), base)[0]
        give_back()

    names = [f"_o{i}" for i in range(len(order))]
    places = [c.alias(n) for c, n in zip(order, names)]
    read = docs.select(F.col(key).cast("bigint").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"), *places)
    if names:
        read = read.repartitionByRange(*names).sortWithinPartitions(*names).select("key", "text")
    return read.mapInArrow(run, schema + ", ids binary" * with_ids)
