"""SimHash near-duplicates by covering locality-sensitive hashing: no pair within the radius is missed.

Every bit of a fingerprint gets a vector of ``radius + 1`` bits. A table belongs to each nonzero vector v and keeps
the fingerprint bits whose vector has an odd product with v. The vectors of at most ``radius`` differing bits
do not span the space, so some v is orthogonal to all of them: its table keeps none of the differing bits
and the two fingerprints meet there. Tables keep about half of the bits.

Fingerprints are made in one pass over the texts; equal ones are one row from there on. A bucket is the table's
bits and their values. Buckets of two are settled by an aggregate. Larger ones up to ``bucket`` share tasks by
a hash, which compare all members and return a spanning forest of the links. A bucket beyond that is covered
again by tables over its free bits; half of these are fixed each time, and with twelve free bits left a bucket
has at most 4,096 members, whatever the fingerprints. Components of the links follow by alternating stars.

Defined results: null and empty texts have no words and fingerprint zero, linked like any other. A text of
fewer words than a shingle is one shingle. Repeated rows and ids are documents of their own. component_id is
the smallest id of the component, null only where all ids are null. An empty table gives no rows. Other
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scratch import materialize
from .common import give_back, lowered, mixed, slices, text_bytes, words
from .components import components

BITS = 64
SHINGLE, SEED = 4, 42
BUCKET, FEW_FREE, TASK_ROWS = 2048, 12, 1 << 16


def _hashes(units: pa.Array, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of all shingles, text by text, and per text the number of shingles before it."""
    spelled = units.to_pylist()
    joined = b" ".join(spelled)
    ends = np.cumsum(np.fromiter(map(len, spelled), np.int64, len(spelled)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1]).astype(np.int64)
    sizes = np.diff(at)
    made = np.where(sizes == 0, 0, np.maximum(sizes - n + 1, 1))
    upto = np.concatenate([[0], np.cumsum(made)])
    first = np.repeat(at[:-1], made) + np.arange(upto[-1]) - np.repeat(upto[:-1], made)
    last = first + np.repeat(np.minimum(sizes, n), made) - 1
    hash_ = xxhash.xxh64_intdigest
    found = [hash_(joined[a:b], SEED) for a, b in zip(starts[first].tolist(), ends[last].tolist())]
    return np.array(found, dtype=np.uint64), upto


def _bit_counts(hashes: np.ndarray, upto: np.ndarray) -> np.ndarray:
    """How many of each text's hashes have each bit."""
    out = np.zeros((len(upto) - 1, BITS), dtype=np.int64)
    for start in range(0, len(hashes), 1 << 16):
        part = hashes[start : start + (1 << 16)]
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        edges = np.clip(upto - start, 0, len(part))
        own = np.flatnonzero(edges[1:] > edges[:-1])
        out[own] += np.add.reduceat(bits, edges[own], axis=0, dtype=np.int32)
    return out


def fingerprints_of(texts: pa.Array, n: int = SHINGLE) -> np.ndarray:
    held, offsets = text_bytes(texts)
    units, at = words(lowered(held), offsets)
    hashes, upto = _hashes(units, at, n)
    ones = 2 * _bit_counts(hashes, upto) > np.diff(upto)[:, None]
    return np.packbits(ones, axis=1, bitorder="little").view(np.uint64).ravel()


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", n: int = SHINGLE) -> DataFrame:
    """(id, print) of every row; the fingerprint's 64 bits as a signed number."""

    def run(batches):
        for batch in batches:
            for piece in slices(batch, "text", 1 << 20):
                made = fingerprints_of(piece.column("text"), n)
                yield pa.RecordBatch.from_arrays([piece.column("id"), pa.array(made.view(np.int64))], names=["id", "print"])
        give_back()

    read = docs.select(F.col(key).cast("bigint").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return materialize(read.mapInArrow(run, "id bigint, print bigint"), "prints")


def masks(radius: int, level: int = 0) -> list[int]:
    """The bits that each table keeps. Vectors are dealt evenly, none is zero; ``level`` deals them anew."""
    kinds = (1 << radius + 1) - 1
    order = np.argsort(mixed(np.arange(1, BITS + 1, dtype=np.uint64) + np.uint64(1000 * level)))
    vector = np.empty(BITS, dtype=np.int64)
    vector[order] = np.arange(BITS) % kinds + 1
    return [sum(1 << i for i in range(BITS) if bin(int(vector[i]) & v).count("1") % 2) for v in range(1, kinds + 1)]


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def _forest(prints: np.ndarray, i: np.ndarray, j: np.ndarray) -> list[tuple[int, int]]:
    """Those of the links (i, j) that join two trees."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for a, b in zip(prints[i].tolist(), prints[j].tolist()):
        x, y = root(a), root(b)
        if x != y:
            parent[x] = y
            out.append((a, b))
    return out


def _tree(prints: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A spanning forest of one bucket's links: from each member met, all unmet ones in reach at once."""
    unmet, out = prints.copy(), []
    while len(unmet):
        todo, unmet = [unmet[0]], unmet[1:]
        while todo and len(unmet):
            node = todo.pop()
            close = np.bitwise_count(unmet ^ node) <= radius
            found = unmet[close]
            out += [(int(node), int(f)) for f in found]
            todo += list(found)
            unmet = unmet[~close]
    return out


def links(prints: DataFrame, radius: int = 4, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b) whose components are those of all pairs of ``print`` within the radius."""
    open_, level, found = prints.select("print", F.lit(0).cast("bigint").alias("used")), 0, None
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius
    while True:
        tables = F.array(*[F.lit(_signed(m)) for m in masks(radius, level)])
        rows = open_.select("print", "used", F.explode(tables).alias("mask")).select("print", F.col("used").bitwiseOR(F.col("mask")).alias("used"))
        rows = rows.distinct() if level else rows  # tables may keep the same bits from here on
        rows = rows.select("used", F.col("print").bitwiseAND(F.col("used")).alias("value"), "print")
        # members are compared as signed numbers here, which only has to be the same for both
        met = rows.groupBy("used", "value").agg(F.count(F.lit(1)).alias("n"), F.min("print").alias("a"), F.max("print").alias("b"))
        met = materialize(met.where("n > 1"), "buckets")
        pairs = met.where("n = 2").select("a", "b").where(near)
        more = materialize(rows.join(met.where("n > 2").select("used", "value", "n"), ["used", "value"]), "members")
        small = (F.col("n") <= bucket) | (F.bit_count("used") >= BITS - FEW_FREE)
        fits = more.where(small)
        bins = max(1, -(-fits.count() // TASK_ROWS))

        def run(table: pa.Table) -> pa.Table:
            table = table.sort_by([("used", "ascending"), ("value", "ascending")])
            used, value = np.asarray(table.column("used")), np.asarray(table.column("value"))
            own = np.asarray(table.column("print")).view(np.uint64)
            new = np.concatenate([[True], (used[1:] != used[:-1]) | (value[1:] != value[:-1])])
            starts = np.append(np.flatnonzero(new), len(own))
            sizes = np.diff(starts)
            which, left = np.cumsum(new) - 1, []
            few, i_, j_ = 16, [], []
            for gap in range(1, min(few, int(sizes.max()))):
                i = np.flatnonzero((which[gap:] == which[:-gap]) & (sizes[which[gap:]] <= few))
                close = np.bitwise_count(own[i] ^ own[i + gap]) <= radius
                i_.append(i[close])
                j_.append(i[close] + gap)
            if i_:
                left += _forest(own, np.concatenate(i_), np.concatenate(j_))
            for k in np.flatnonzero(sizes > few).tolist():
                left += _tree(own[starts[k] : starts[k + 1]], radius)
            a, b = (np.array([e[k] for e in left], dtype=np.uint64).view(np.int64) for k in (0, 1))
            give_back()
            return pa.Table.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        placed = fits.select("used", "value", "print", F.expr(f"pmod(xxhash64(used, value, 3), {bins})").alias("bin"))
        pairs = pairs.unionByName(placed.groupBy("bin").applyInArrow(run, "a bigint, b bigint"))
        found = pairs if found is None else found.unionByName(pairs)
        open_ = more.where(~small).select("print", "used")
        if open_.isEmpty():
            return materialize(found.distinct(), "links")
        level += 1


def classes(docs: DataFrame, radius: int = 4, key: str = "doc_id", text: str = "text", n: int = SHINGLE, bucket: int = BUCKET) -> DataFrame:
    """A row per document: doc_id, fingerprint (16 hex digits), component_id."""
    each = fingerprints(docs, key, text, n)
    prints = materialize(each.groupBy("print").agg(F.min("id").alias("least")), "distinct")
    joined = components(links(prints, radius, bucket)).withColumnRenamed("node", "print")
    rooted = prints.join(joined, "print", "left").withColumn("root", F.coalesce("root", "print"))
    heads = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.select("print", "root").join(heads, "root").select("print", "component_id")
    return each.join(named, "print").select(
        F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id"
    )
