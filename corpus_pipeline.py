"""A corpus pipeline of five stages over the documents table; each stage works on what the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hearthgraph.llm import exact_dedup, jaccard_join, mixing, segment, toxicity
from hearthgraph.llm.common import cut, documents
from hearthgraph.llm.queries import PIECE_MODEL, toxic_model

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: The mixture of the pipeline: nine tenths of the tokens, no document more than twice.
MIX = mixing.Mix(weights=mixing.PRODUCTION.weights, budget_permille=900, max_epochs=2)


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model does not reject. The model learns from the labelled documents of the tables."""
    scored = toxicity.score(docs, toxic_model(spark, sf_dir), keep=COLUMNS)
    return scored.where("predicted = 0").select(*COLUMNS)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each set of equal texts."""
    return exact_dedup.survivors(docs).select(*COLUMNS)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that links of five-word shingles join."""
    return jaccard_join.one_of_each(docs).select(*COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each leaf's documents up to its budget; a document comes once for each epoch that takes it."""
    return mixing.mixed(docs, MIX, mixing.levels_of_documents()).select(*COLUMNS)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The piece numbers of each document."""
    return segment.encode(docs, PIECE_MODEL)


STAGES = [
    ("toxicity", without_toxic),
    ("exact_dedup", without_copies),
    ("jaccard_join", without_near_copies),
    ("mixing", mixed),
    ("segmentation", encoded),
]

#: The first stage's model, the links and the segmentation are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs)
    return docs
