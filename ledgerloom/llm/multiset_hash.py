"""Homomorphic fingerprints of a document's multiset of paragraphs.

A paragraph (a line that is not blank) is hashed to a wide vector; a document's fingerprint is the sum
of its paragraphs' vectors, lane by lane modulo a power of two. So paragraphs can come in any order,
and one can be added or taken away without the others. The vector has two parts:

- ``LANES`` lanes modulo 2**64, uniform functions of the paragraph's 128-bit hash: equality;
- ``SIGNS`` lanes modulo 2**16, each the sum of a +1 or -1 for every sentence piece of the paragraph:
  their products estimate how many pieces two documents share. ``likeness`` is that estimate as
  shared pieces over all pieces, from 0 to 1.

Fingerprints are written in hexadecimal, lanes in order, least significant byte first, after the
number of pieces (modulo 2**64).

Defined results: a null or blank text has no paragraph and a fingerprint of zeros; two such are alike
(1), one such and another text are not (0). Repeated paragraphs and rows count each time. Other
columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import bisect
import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scratch import materialize
from .common import give_back, mixed, sized, slices

LANES, SIGNS = 8, 256
_LANE_SEEDS = mixed(np.arange(1, LANES + 1, dtype=np.uint64))
_SIGN_SEEDS = mixed(np.arange(101, 101 + SIGNS // 64, dtype=np.uint64))
PIECE_WORDS = 8


def pieces(paragraph: bytes) -> list[bytes]:
    """A paragraph's sentence pieces: sentences, cut after eight words."""
    found = []
    for sentence in paragraph.replace(b". ", b".\0").split(b"\0"):
        words = sentence.split()
        found += [b" ".join(words[i : i + PIECE_WORDS]) for i in range(0, len(words), PIECE_WORDS)]
    return found


def vectors(paragraphs: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The summed vectors of each list of paragraphs: piece counts, equality lanes, sign lanes."""
    n = len(paragraphs)
    high, low, owner, marks, piece_owner = [], [], [], [], []
    for i, own in enumerate(paragraphs):
        for p in own:
            whole = xxhash.xxh3_128_intdigest(p)
            high.append(whole >> 64)
            low.append(whole & 0xFFFFFFFFFFFFFFFF)
            owner.append(i)
            found = [xxhash.xxh3_64_intdigest(x) for x in pieces(p)]
            marks += found
            piece_owner += [i] * len(found)
    high, low, marks = (np.array(x, dtype=np.uint64) for x in (high, low, marks))
    equal = np.zeros((n, LANES), dtype=np.uint64)
    signs = np.zeros((n, SIGNS), dtype=np.int64)
    if len(owner):
        starts = np.flatnonzero(np.diff(owner, prepend=-1))
        lanes = mixed(mixed(high[:, None] + _LANE_SEEDS) ^ low[:, None])
        equal[np.array(owner)[starts]] = np.add.reduceat(lanes, starts, axis=0)
    counts = np.bincount(piece_owner, minlength=n).astype(np.uint64)
    for at in range(0, len(marks), 1 << 14):  # bounded: 16 K pieces by the lanes
        part, own = marks[at : at + (1 << 14)], np.array(piece_owner[at : at + (1 << 14)])
        bits = np.unpackbits(mixed(part[:, None] ^ _SIGN_SEEDS).view(np.uint8), axis=1)
        starts = np.flatnonzero(np.diff(own, prepend=-1))
        ones = np.add.reduceat(bits, starts, axis=0, dtype=np.int64)
        sizes = np.diff(np.append(starts, len(own)))
        signs[own[starts]] += 2 * ones - sizes[:, None]
    return counts, equal, signs.astype(np.int16)


def paragraphs(text: str | None) -> list[bytes]:
    return [p for p in (text or "").encode().split(b"\n") if p.strip()]


def fingerprints(texts: list[str | None]) -> list[str]:
    counts, equal, signs = vectors([paragraphs(t) for t in texts])
    return [
        counts[i].astype("<u8").tobytes().hex() + equal[i].astype("<u8").tobytes().hex() + signs[i].astype("<i2").tobytes().hex()
        for i in range(len(texts))
    ]


def _lanes(fingerprint: str) -> tuple[np.ndarray, np.ndarray]:
    """The piece count with the equality lanes, and the sign lanes."""
    raw = bytes.fromhex(fingerprint)
    return np.frombuffer(raw[: 8 + 8 * LANES], "<u8"), np.frombuffer(raw[8 + 8 * LANES :], "<i2")


def changed(fingerprint: str, added: list[str] = (), removed: list[str] = ()) -> str:
    """The fingerprint after paragraphs are added and removed, without the rest of the document."""
    equal, signs = _lanes(fingerprint)
    for lines, way in ((added, 1), (removed, -1)):
        if lines:
            c, e, s = vectors([[p.encode() for p in lines]])
            equal = equal + np.concatenate([c, e[0]]) * np.uint64(way % (1 << 64))
            signs = signs + s[0] * np.int16(way)
    return equal.astype("<u8").tobytes().hex() + signs.astype("<i2").tobytes().hex()


def likeness(a: str, b: str) -> float:
    """Estimated share of common pieces, 0 to 1; exactly 1 for equal fingerprints."""
    if a == b:
        return 1.0
    (x, u), (y, v) = _lanes(a), _lanes(b)
    n, m = int(x[0]), int(y[0])
    if not n or not m:
        return 0.0
    shared = float(np.dot(u.astype(np.float64), v.astype(np.float64))) / SIGNS
    norm_a, norm_b = (float(np.dot(w.astype(np.float64), w)) / SIGNS for w in (u, v))
    whole = norm_a + norm_b - shared
    return min(1.0, max(0.0, shared / whole)) if whole > 0 else 0.0


def edited(own: str, following: str) -> str:
    """The last half of a text replaced by as many letters of the following one's beginning."""
    half = len(own) // 2
    return own[: len(own) - half] + following[:half]


# letters of text in a range, and the most ranges, which bounds what the driver holds; ranges are streamed
RANGE_LETTERS, MOST_RANGES = 1 << 23, 20_000


def _bounds(docs: DataFrame, key: str, text: str) -> list[tuple[bool, int, int]]:
    """Where each range of the documents' order begins: one small row per range."""
    narrow = docs.select(
        F.col(key).isNull().alias("missing"), F.coalesce(F.bitwise_not(F.col(key).cast("bigint")), F.lit(0)).alias("back"),
        F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("print"), F.coalesce(F.length(text), F.lit(0)).alias("letters"),
    )
    held = materialize(narrow, "order")
    ranges = min(MOST_RANGES, sized(held.agg(F.sum("letters")).first()[0] or 0, RANGE_LETTERS))
    first = F.min(F.struct("missing", "back", "print")).alias("first")
    found = held.drop("letters").repartitionByRange(ranges, "missing", "back", "print").groupBy(F.spark_partition_id().alias("p")).agg(first).collect()
    return sorted({tuple(r["first"]) for r in found})


def compare(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per document, with its next in descending order of id: doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next.

    The order (id descending, null last, then the text's hash) is cut into ranges. Each range is read in order; it
    also gets the first document of the range after it, and the last range that of the first.
    """
    bounds = _bounds(docs, key, text)

    def dealt(batches):
        for batch in batches:
            order = list(zip(*(batch.column(c).to_pylist() for c in ("missing", "back", "print"))))
            place = [bisect.bisect_right(bounds, o) - 1 for o in order]
            firsts = [i for i, o in enumerate(order) if bounds[place[i]] == o]
            ahead = [(place[i] or len(bounds)) - 1 for i in firsts]
            n = len(order)
            for rows, where, tail in ((batch, place, [False] * n), (batch.take(pa.array(firsts, pa.int64())), ahead, [True] * len(firsts))):
                columns = [pa.array(where, pa.int32()), pa.array(tail, pa.bool_()), *rows.columns]
                yield pa.RecordBatch.from_arrays(columns, names=["range", "tail", *rows.schema.names])

    def run(batches):
        held = None  # the document whose next is still to come
        for batch in batches:
            for piece in slices(batch, "text", 1 << 21):
                columns = [piece.column(c).to_pylist() for c in ("range", "tail", "key", "text")]
                rows = list(zip(*columns, fingerprints(columns[3])))
                pairs = []
                for row in rows:
                    if held is not None and held[0] == row[0] and not held[1]:
                        pairs.append((held, row))
                    held = row
                if pairs:
                    yield _compared(pairs)
        give_back()

    schema = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    read = docs.select(
        F.col(key).isNull().alias("missing"), F.coalesce(F.bitwise_not(F.col(key).cast("bigint")), F.lit(0)).alias("back"),
        F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("print"), F.col(key).cast("bigint").alias("key"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    moved = read.mapInArrow(dealt, "range int, tail boolean, missing boolean, back bigint, print bigint, key bigint, text string")
    return moved.repartition("range").sortWithinPartitions("range", "tail", "missing", "back", "print").mapInArrow(run, schema)


def _compared(pairs: list[tuple]) -> pa.RecordBatch:
    new = [edited(a[3], b[3]) for a, b in pairs]
    new_prints = fingerprints(new)
    columns = [
        pa.array([a[2] for a, _ in pairs], pa.int64()), [len(a[3]) for a, _ in pairs], [hashlib.sha256(t.encode()).hexdigest() for t in new],
        [a[4] for a, _ in pairs], new_prints, [likeness(a[4], p) for (a, _), p in zip(pairs, new_prints)],
        [likeness(a[4], b[4]) for a, b in pairs],
    ]
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    return pa.RecordBatch.from_arrays([pa.array(c) if isinstance(c, list) else c for c in columns], names=names)
