"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.scratch import materialize


def components(edges: DataFrame) -> DataFrame:
    """A row (node, root) for every node with an edge; the root is the component's smallest node.

    ``edges`` has two columns of one type. Each round writes the edges, which cuts lineage; a round
    joins edges with one row per node and is one write; only a count and a checksum, observed there, reach the driver.
    """
    u, v = edges.columns
    held, mark = _stored(_pairs(edges.select(F.col(u).alias("u"), F.col(v).alias("v"))))
    while True:
        both = held.unionByName(held.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        wide = _pairs(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")))
        least = wide.groupBy("u").agg(F.min("v").alias("m"))
        near = wide.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        before = mark
        held, mark = _stored(_pairs(near.unionByName(least.select("u", F.col("m").alias("v")))))
        if mark == before:
            break
    return held.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        held.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )


def _pairs(edges: DataFrame) -> DataFrame:
    """Each edge once, larger node first."""
    return edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _stored(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The edges written, with their count and checksum observed on the way."""
    seen = Observation()
    sums = F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("sum")
    held = materialize(edges.observe(seen, *sums), "edges")
    return held, (seen.get["n"], seen.get["sum"])
