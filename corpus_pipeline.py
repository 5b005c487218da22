"""A corpus prepared for training, stage by stage: quality, near duplicates, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame. Stages work on all rows of the stage
before; what one returns is written as Parquet and read again as the next one's ``docs``. The training
order of the mix is that of its part files by name and of the rows in each, and packing keeps it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.scratch import materialize
from ledgerloom.llm import cost_packing, curriculum, neighbour_vote, ngram_jaccard
from ledgerloom.llm.common import fold, table
from ledgerloom.llm.queries import vocabulary

LEAST_QUALITY = 0.7


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the vote of their labelled neighbours calls good."""
    usable = F.coalesce(fold(F.col("doc_id"), 4) != 2, F.lit(False))
    voters = neighbour_vote.fit(docs, table(spark, sf_dir, "labels"), usable)
    return neighbour_vote.score(docs, voters, name="_score").where(F.col("_score") >= LEAST_QUALITY).select(docs.columns)


def single(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return ngram_jaccard.keep_one(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Copies of documents in training order, by the curriculum over sources."""
    return curriculum.mix(docs).drop("position")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of training sequences; ``sequence_id`` follows the order in which ``docs`` were written."""
    place = [F.col("_metadata.file_name"), F.col("_metadata.row_index")]
    return cost_packing.pieces(docs, vocabulary("word_bpe_49k.json"), 1, order=place)


STAGES = [("quality", good), ("near duplicates", single), ("mix", mixed), ("pack", packed)]

# tokenizer and classifier are beyond SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
