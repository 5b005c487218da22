"""Approximate nearest neighbours by shifted space-filling curves.

Vectors are projected to a few dimensions by several random rotations, each with a random shift, and
ordered along a Hilbert curve in each. Every ordering is range-partitioned by Spark and cut into
windows of ``window`` consecutive vectors. A query looks into its own window and its neighbours on both
sides in every ordering; what it meets is ranked by exact Euclidean distance, and the orderings' lists merge.

How many neighbours a side is measured, so that ``recall`` holds at every size: for ``probes`` queries the
true neighbours are found among all points, and the windows between them and the query are counted.

Equal vectors are one point of the curves, kept with their ``k + 1`` smallest ids: no list of ``k``
can need more, so a vector with a third of all rows is exact and costs one point.

Defined results: vectors that are null, zero, of another length than most, or hold null or non-finite
components take no part, nor do rows without an id. Repeated rows count once. Ties go to the smaller
id. With fewer candidates than ``k`` all found are returned; an empty table gives no rows. Other
columns are ignored.

The scale of the projections is fitted on ``fit_rows`` vectors (those of smallest hash); every vector is
indexed. A task holds one window and the queries that look into it.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scan import with_rank
from ..functions.scratch import materialize

DIMENSIONS, BITS = 8, 7


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place of integer points (n x dimensions, each below 2**bits) on the Hilbert curve.

    The transposed form of the index is found by undoing a cube's excess rotations from the largest bit
    down, and Gray decoding; its bits are then interleaved.
    """
    x = cells.astype(np.int64).T.copy()
    dims = len(x)
    bit = 1 << (bits - 1)
    while bit > 1:
        low = bit - 1
        for i in range(dims):
            on = (x[i] & bit) != 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(on, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
        bit >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    turn = np.zeros(x.shape[1], dtype=np.int64)
    bit = 1 << (bits - 1)
    while bit > 1:
        turn = np.where((x[-1] & bit) != 0, turn ^ (bit - 1), turn)
        bit >>= 1
    x ^= turn
    key = np.zeros(x.shape[1], dtype=np.int64)
    for b in reversed(range(bits)):
        for i in range(dims):
            key = key << 1 | (x[i] >> b & 1)
    return key


class Curves:
    """Random rotations and shifts, scaled to a sample."""

    def __init__(self, sample: np.ndarray, orderings: int, seed: int = 0):
        random, size = np.random.default_rng(seed), sample.shape[1]
        dims = min(DIMENSIONS, size)
        self.turns = [np.linalg.qr(random.standard_normal((size, dims)))[0] for _ in range(orderings)]
        centre = sample.mean(axis=0)
        spread = max(float(np.abs((sample - centre) @ t).max()) for t in self.turns) or 1.0
        self.step = 3 * spread / (1 << BITS)  # the shift takes up to half of the range
        self.shifts = [centre @ t - spread * (1 + random.random(dims)) for t in self.turns]

    def keys(self, vectors: np.ndarray) -> Iterator[np.ndarray]:
        for turn, shift in zip(self.turns, self.shifts):
            cells = np.floor((vectors @ turn - shift) / self.step)
            yield hilbert_keys(np.clip(cells, 0, (1 << BITS) - 1), BITS)


def nearest(queries: np.ndarray, candidates: np.ndarray, ids: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query the places of its ``k`` nearest candidates and their distances, ties to the smaller id."""
    rough = (candidates**2).sum(axis=1) - 2 * queries @ candidates.T
    found = []
    for query, row in zip(queries, rough):
        near = np.arange(len(row))
        if len(row) > k:
            least = np.partition(row, k - 1)[k - 1]
            near = np.flatnonzero(row <= least + 1e-9 * (1 + abs(least) + float(query @ query)))
        exact = np.sqrt(((candidates[near] - query) ** 2).sum(axis=1))
        order = np.lexsort((ids[near], exact))[:k]
        found.append((near[order], exact[order]))
    return found


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten(), dtype=np.float64).reshape(len(column), -1)


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """Rows (id, vec as doubles) that take part."""
    rows = vectors.select(F.col(key).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("vec")).where("id IS NOT NULL")
    fine = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = rows.where(fine & F.exists("vec", lambda x: x != 0))
    lengths = rows.groupBy(F.size("vec").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return rows.where(F.size("vec") == (lengths[0]["n"] if lengths else 0))


NAME = "struct<point bigint, print bigint>"


def reach(points: DataFrame, ranked: DataFrame, asked: DataFrame, k: int, recall: float, probes: int) -> int:
    """Windows to look into on each side, so that ``recall`` of the probes' true neighbours are met in some ordering."""
    own = asked.select("name").distinct().orderBy(F.xxhash64("name"), "name").limit(probes)
    rows = own.join(points.select("name", "vec"), "name").collect()
    if not rows:
        return 1
    names, queries = [tuple(r["name"]) for r in rows], np.array([r["vec"] for r in rows])

    def near(batches):
        best = [[] for _ in names]
        for batch in batches:
            there = [(n["point"], n["print"]) for n in batch.column("name").to_pylist()]
            ids = np.array([n for n, _ in there])
            for q, (at, score) in enumerate(nearest(queries, _matrix(batch.column("vec")), ids, k + 1) if there else []):
                others = [(s, there[i]) for i, s in zip(at.tolist(), score.tolist()) if there[i] != names[q]]
                best[q] = heapq.nsmallest(k, best[q] + others)
        out = [(q, {"point": n[0], "print": n[1]}, s) for q, found in enumerate(best) for s, n in found]
        types = (pa.int32(), pa.struct([("point", pa.int64()), ("print", pa.int64())]), pa.float64())
        columns = zip(*out) if out else ([], [], [])
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["probe", "name", "score"])

    true = points.select("vec", "name").mapInArrow(near, f"probe int, name {NAME}, score double")
    place = F.row_number().over(Window.partitionBy("probe").orderBy("score", "name"))
    true = materialize(true.withColumn("n", place).where(F.col("n") <= k).select("probe", "name"), "true")
    probe = points.sparkSession.createDataFrame(list(enumerate(names)), f"probe int, name {NAME}")
    here = ranked.join(probe, "name").select("probe", "t", F.col("block").alias("own"))
    gaps = true.join(ranked, "name").join(here, ["probe", "t"]).groupBy("probe", "name").agg(F.min(F.abs(F.col("block") - F.col("own"))).alias("gap"))
    found = sorted(r["gap"] for r in gaps.select("gap").collect())  # k for each probe
    return max(1, found[math.ceil(recall * len(found)) - 1]) if found else 1


def search(
    vectors: DataFrame,
    queries: Column,
    key: str = "vec_id",
    vector: str = "embedding",
    k: int = 10,
    orderings: int = 12,
    window: int = 4096,
    fit_rows: int = 4096,
    seed: int = 0,
    recall: float = 0.95,
    probes: int = 100,
) -> DataFrame:
    """A row per query and rank: query_id, rank, vec_id, score. ``queries`` is a condition on ``id``."""
    rows = usable(vectors, key, vector).select("id", F.transform("vec", lambda x: x + F.lit(0.0)).alias("vec"))
    numbered = rows.distinct().withColumn("n", F.row_number().over(Window.partitionBy("vec").orderBy("id"))).where(F.col("n") <= k + 1)
    points = numbered.groupBy("vec").agg(F.min("id").alias("point"), F.sort_array(F.collect_list("id")).alias("ids"))
    # equal ids may stand for different vectors, so a point has a name of its own
    points = materialize(points.withColumn("name", F.struct("point", F.xxhash64("vec").alias("print"))), "points")
    asked = materialize(rows.where(queries).distinct().join(points.select("vec", "name"), "vec").select(F.col("id").alias("query_id"), "name"), "asked")
    sample = [r["vec"] for r in points.orderBy(F.xxhash64("name")).limit(fit_rows).select("vec").collect()]
    result = "query_id bigint, rank int, vec_id bigint, score double"
    if not sample:
        return vectors.sparkSession.createDataFrame([], result)
    curves = Curves(np.array(sample), orderings, seed)

    def keyed(batches):
        for batch in batches:
            for t, keys in enumerate(curves.keys(_matrix(batch.column("vec")))):
                columns = [pa.array([t] * len(keys), pa.int32()), pa.array(keys), batch.column("name")]
                yield pa.RecordBatch.from_arrays(columns, names=["t", "place", "name"])

    placed = points.select("vec", "name").mapInArrow(keyed, f"t int, place bigint, name {NAME}")
    ranked = with_rank(placed, ["t"], ["place", "name"], "rank").select("t", F.floor((F.col("rank") - 1) / window).cast("int").alias("block"), "name")
    ranked = materialize(ranked, "windows")
    members = ranked.join(points.select("name", "vec"), "name")
    looking = ranked.join(asked.select("name").distinct(), "name").join(points.select("name", "vec"), "name")
    sides = reach(points, ranked, asked, k, recall, probes)
    last = ranked.agg(F.max("block")).first()[0]
    around = F.explode(F.sequence(F.greatest(F.col("block") - sides, F.lit(0)), F.least(F.col("block") + sides, F.lit(last))))
    looking = looking.select(F.col("t").alias("query_t"), around.alias("query_block"), F.col("name").alias("query"), F.col("vec").alias("query_vec"))

    def meet(there: pa.Table, here: pa.Table) -> pa.Table:
        names, schema = here.column("query").to_pylist(), ["query", "name", "score"]
        found = []
        if len(there) and names:
            ids = np.array([n["point"] for n in there.column("name").to_pylist()])
            candidates, asking = _matrix(there.column("vec")), _matrix(here.column("query_vec"))
            for start in range(0, len(names), 512):  # bounds the matrix of distances
                for query, (at, score) in zip(names[start:], nearest(asking[start : start + 512], candidates, ids, k + 1)):
                    found += [(query, there.column("name")[i].as_py(), s) for i, s in zip(at.tolist(), score)]
        kind = pa.struct([("point", pa.int64()), ("print", pa.int64())])
        columns = zip(*found) if found else ([], [], [])
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, (kind, kind, pa.float64()))], names=schema)

    met = members.groupBy("t", "block").cogroup(looking.groupBy("query_t", "query_block")).applyInArrow(meet, f"query {NAME}, name {NAME}, score double")
    merged = met.groupBy("query", "name").agg(F.min("score").alias("score"))
    best = Window.partitionBy("query").orderBy("score", "name")
    merged = merged.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1)
    each = merged.join(points.select("name", "ids"), "name").select("query", "score", F.explode("ids").alias("vec_id"))
    lists = asked.withColumnRenamed("name", "query").join(each, "query").where("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return lists.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
