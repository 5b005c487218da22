"""Near-duplicate documents: MinHash bands propose, full sets of word n-grams decide.

Documents are reduced to sets of ``n``-word shingles (words between white space, as written; a text of
fewer words is one shingle). Equal sets are one *print* with a count, so copies are never paired. Band
and row counts follow from the target recall at the threshold. Rows shuffle on band hashes; members of
a bucket link to its smallest print, and the components of these links are the clusters in which pairs
can lie. Inside a cluster every pair is verified on the full sets: clusters are cut into blocks of
bounded size, a task verifies one pair of blocks, and returns links counted per print and a spanning
forest of its links, not the pairs. So no group is gathered whole and no pair list is written, while
every link counts.

Defined results: null and empty texts have the empty set and are copies of each other. The class id is
the smallest id of the class (null only if all are); n_links counts the other documents of similarity
at or above the threshold, copies included. Rows of one id are documents of their own. Other columns
are ignored by ``classes`` and pass through ``keep_one``. An empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scratch import materialize
from .common import give_back, mixed, slices, text_bytes, words
from .components import components

_STEPS = mixed(np.arange(11, 75, dtype=np.uint64)) | np.uint64(1)
BLOCK_SETS, BLOCK_SHINGLES = 1024, 1 << 20


def shingles(texts: pa.Array, n: int = 5) -> list[np.ndarray]:
    """The sorted set of shingle hashes of each text."""
    held, offsets = text_bytes(texts)
    units, at = words(held, offsets)
    coded = units.dictionary_encode()
    hashes = np.array([xxhash.xxh64_intdigest(w) for w in coded.dictionary.to_pylist()], dtype=np.uint64)
    token = hashes[np.asarray(coded.indices)] if len(units) else np.empty(0, np.uint64)
    whole = np.zeros(max(len(token) - n + 1, 0), dtype=np.uint64)
    for j in range(n):
        whole += token[j : j + len(whole)] * _STEPS[j]
    whole, out = mixed(whole), []
    for start, end in zip(at[:-1], at[1:]):
        if end - start >= n:
            own = np.sort(whole[start : end - n + 1])
            out.append(own[np.concatenate([[True], own[1:] != own[:-1]])])
        elif end > start:
            short = (token[start:end] * _STEPS[: end - start]).sum(dtype=np.uint64, keepdims=True)
            out.append(mixed(short + np.uint64(end - start)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def bands_for(threshold: float, recall: float, most_hashes: int = 256) -> tuple[int, int]:
    """Bands and rows: the most selective that find a pair at the threshold with the target recall."""
    best = (1, 1)
    for rows in range(1, 65):
        bands = math.ceil(math.log(1 - recall) / math.log1p(-(threshold**rows))) if threshold < 1 else 1
        if bands * rows <= most_hashes:
            best = (bands, rows)
    return best


def band_hashes(sets: list[np.ndarray], bands: int, rows: int) -> np.ndarray:
    """A hash per set and band; sets must not be empty."""
    random = np.random.default_rng(5)
    steps = random.integers(0, 1 << 32, bands * rows, dtype=np.uint32) | np.uint32(1)
    adds = random.integers(0, 1 << 32, bands * rows, dtype=np.uint32)
    out, start = np.empty((len(sets), bands * rows), dtype=np.uint32), 0
    while start < len(sets):  # some sets at a time, to stay in the processor's cache
        end, size = start, 0
        while end < len(sets) and (end == start or size + len(sets[end]) <= 1 << 15):
            size += len(sets[end])
            end += 1
        flat = np.concatenate(sets[start:end])
        flat = (flat >> np.uint64(32)).astype(np.uint32) ^ flat.astype(np.uint32)
        begins = np.concatenate([[0], np.cumsum([len(s) for s in sets[start : end - 1]])]).astype(np.int64)
        for j in range(bands * rows):
            out[start:end, j] = np.minimum.reduceat(flat * steps[j] + adds[j], begins)
        start = end
    grouped = out.reshape(len(sets), bands, rows).astype(np.uint64)
    folded = np.broadcast_to(mixed(np.arange(1, bands + 1, dtype=np.uint64)), grouped.shape[:2]).copy()
    for j in range(rows):
        folded = mixed(folded ^ grouped[:, :, j] + _STEPS[20])
    return folded.view(np.int64)


def _print(own: np.ndarray) -> bytes:
    """128 bits that name a set."""
    parts = [own.sum(dtype=np.uint64), mixed(own ^ _STEPS[30]).sum(dtype=np.uint64)]
    return np.array(parts, dtype=">u8").tobytes()


def prints(docs: DataFrame, threshold: float, recall: float, n: int, key: str, text: str) -> DataFrame:
    """A row per document: id, mark (hash of the text), print, size of the set, band hashes."""
    bands, rows = bands_for(threshold, recall)

    def run(batches):
        for batch in batches:
            for piece in slices(batch, "text", 1 << 21):
                sets = shingles(piece.column("text"), n)
                full = [i for i, s in enumerate(sets) if len(s)]
                made = [[]] * len(sets)
                for i, own in zip(full, band_hashes([sets[i] for i in full], bands, rows)) if full else ():
                    made[i] = own
                columns = [
                    piece.column("id"), piece.column("mark"), pa.array([_print(s) for s in sets], pa.binary()),
                    pa.array([len(s) for s in sets], pa.int64()), pa.array(made, pa.list_(pa.int64())),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["id", "mark", "print", "size", "bands"])
        give_back()

    read = docs.select(
        F.col(key).cast("bigint").alias("id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("mark"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    return materialize(read.mapInArrow(run, "id bigint, mark bigint, print binary, size bigint, bands array<bigint>"), "prints")


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Shared shingles of every two sets; only shingles that two sets hold are laid out, some columns at a time."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count[column] > 1
    owner, column = owner[shared], (np.cumsum(count > 1) - 1)[column[shared]]
    width = max(1, (1 << 23) // len(sets))
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((len(sets), len(sets)), dtype=np.float32)
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        a, b = np.searchsorted(column, [start, start + width])
        held = np.zeros((len(sets), min(width, int(column[b - 1]) + 1 - start)), dtype=np.float32)
        held[owner[a:b], column[a:b] - start] = 1
        out += held @ held.T
    return out


def verify(sets: list[np.ndarray], blocks: np.ndarray, copies: np.ndarray, threshold: float, across: bool) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Linked documents of each set, and a forest of the links. ``across``: only pairs of different blocks."""
    sizes = np.array([len(s) for s in sets], dtype=np.float64)
    shared = overlaps(sets).astype(np.float64)
    linked = shared >= threshold * (sizes[:, None] + sizes[None] - shared) - 1e-9
    np.fill_diagonal(linked, False)
    if across:
        linked &= blocks[:, None] != blocks[None]
    links, forest, new = linked @ copies.astype(np.float64), [], np.ones(len(sets), dtype=bool)
    for root in range(len(sets)):
        if new[root]:
            new[root], todo = False, [root]
            while todo:
                node = todo.pop()
                found = np.flatnonzero(linked[node] & new)
                new[found] = False
                forest += [(node, int(f)) for f in found]
                todo += found.tolist()
    return links, forest


def classes(
    docs: DataFrame, threshold: float = 0.8, n: int = 5, recall: float = 0.998, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """A row per document: doc_id, mark, class_id, class_mark, n_links."""
    each = prints(docs, threshold, recall, n, key, text)
    first = F.min(F.struct(F.col("id").isNull().alias("missing"), "id", "mark")).alias("first")
    sets = each.groupBy("print").agg(first, F.count(F.lit(1)).alias("copies"), F.first("size").alias("size"), F.first("bands").alias("bands"))
    sets = materialize(sets, "sets")
    rows = sets.select("print", F.explode("bands").alias("band"))
    hubs = rows.groupBy("band").agg(F.min("print").alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    near = rows.join(hubs, "band").where(F.col("print") != F.col("hub")).select("print", "hub").distinct()
    clusters = components(near)
    members = materialize(
        clusters.join(sets.drop("bands"), clusters["node"] == sets["print"]).select("root", "print", "first", "copies", "size"), "members"
    )
    sizes = members.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("total"))
    cuts = F.ceil(F.greatest(F.col("n") / BLOCK_SETS, F.col("total") / BLOCK_SHINGLES)).cast("int")
    sizes = materialize(sizes.select("root", cuts.alias("cuts"), "total"), "clusters")
    bins = max(1, (sizes.where("cuts = 1").agg(F.sum("total")).first()[0] or 0) // BLOCK_SHINGLES + 1)
    placed = members.join(sizes.select("root", "cuts"), "root").withColumn("block", F.expr("cast(pmod(xxhash64(print), cuts) as int)"))
    # small clusters share tasks; a large one has a task per pair of blocks
    small = F.expr(f"named_struct('bin', pmod(xxhash64(root, 7), {bins}), 'low', 0, 'high', 0)")
    large = F.transform(
        F.sequence(F.lit(0), F.col("cuts") - 1),
        lambda j: F.struct(F.xxhash64("root").alias("bin"), F.least("block", j).alias("low"), F.greatest("block", j).alias("high")),
    )
    read = docs.select(F.col(key).cast("bigint").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    read = read.select(F.coalesce("id", F.lit(0)).alias("k"), F.col("id").isNull().alias("missing"), F.xxhash64("text").alias("mark"), "text")
    named = placed.select(
        F.coalesce("first.id", F.lit(0)).alias("k"), F.col("first.missing").alias("missing"), F.col("first.mark").alias("mark"),
        "root", "print", "copies", "cuts", "block",
    )
    texts = read.join(named, ["k", "missing", "mark"]).dropDuplicates(["k", "missing", "mark"])
    tasks = texts.withColumn("task", F.explode(F.when(F.col("cuts") == 1, F.array(small)).otherwise(large)))
    tasks = tasks.select("task.bin", "task.low", "task.high", F.col("cuts") > 1, "root", "print", "copies", "block", "text").toDF(
        "bin", "low", "high", "cut", "root", "print", "copies", "block", "text"
    )

    def run(table: pa.Table) -> pa.Table:
        names, roots = table.column("print").to_pylist(), table.column("root").to_pylist()
        copies, blocks = np.array(table.column("copies")), np.array(table.column("block"))
        across = table.column("cut")[0].as_py() and table.column("low")[0].as_py() != table.column("high")[0].as_py()
        sets = shingles(table.column("text").combine_chunks(), n)
        groups: dict[bytes, list[int]] = {}
        for i, root in enumerate(roots):
            groups.setdefault(root, []).append(i)
        out = []
        for own in groups.values():
            links, forest = verify([sets[i] for i in own], blocks[own], copies[own], threshold, across)
            out += [(names[own[i]], None, int(count)) for i, count in enumerate(links) if count]
            out += [(names[own[a]], names[own[b]], 0) for a, b in forest]
        columns = zip(*out) if out else ([], [], [])
        kinds = (pa.binary(), pa.binary(), pa.int64())
        give_back()
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["a", "b", "links"])

    found = materialize(tasks.groupBy("bin", "low", "high").applyInArrow(run, "a binary, b binary, links bigint"), "links")
    links = found.groupBy(F.col("a").alias("print")).agg(F.sum("links").alias("links"))
    joined = components(found.where("b IS NOT NULL").select("a", "b")).withColumnRenamed("node", "print")
    whole = sets.select("print", "first", "copies").join(joined, "print", "left").join(links, "print", "left")
    whole = materialize(whole.withColumn("root", F.coalesce("root", "print")), "prints")
    heads = whole.groupBy("root").agg(F.min("first").alias("head"))
    info = whole.join(heads, "root").select(
        "print", F.col("head.id").alias("class_id"), F.col("head.mark").alias("class_mark"),
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
    )
    return each.select("id", "mark", "print").join(info, "print").select(F.col("id").alias("doc_id"), "mark", "class_id", "class_mark", "n_links")


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that stand for their class: the one of smallest id, by text hash among equals."""
    rows = classes(docs, key=key, text=text, **options)
    alone = rows.where(F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("mark") == F.col("class_mark")))
    names = [F.coalesce(F.col("doc_id"), F.lit(0)).alias("_k"), F.col("doc_id").isNull().alias("_missing"), F.col("mark").alias("_mark")]
    kept = alone.select(*names).distinct()
    marked = docs.withColumns({
        "_k": F.coalesce(F.col(key).cast("bigint"), F.lit(0)), "_missing": F.col(key).isNull(),
        "_mark": F.xxhash64(F.coalesce(F.col(text), F.lit(""))),
    })
    # rows repeated in full are one document
    same = Window.partitionBy("_k", "_missing", "_mark").orderBy("_mark")
    found = marked.join(kept, ["_k", "_missing", "_mark"], "left_semi").withColumn("_n", F.row_number().over(same))
    return found.where("_n = 1").select(docs.columns)
