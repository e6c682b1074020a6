"""A training corpus from raw documents: five stages, each one operator of ``routelens.llm``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes every stage's rows as
Parquet below the shared folder and reads them back as the next stage's documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from routelens.llm import exact_dedup, mixing, packing, simhash_dedup, toxicity
from routelens.session import materialize, ship_package
from routelens.sources.tables import read_table


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on the ``labels`` table, rejects go."""
    ship_package(spark)
    return toxicity.keep_clean(docs, read_table(spark, sf_dir, "labels"))


def remove_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts, the one with the smallest doc_id stays."""
    ship_package(spark)
    return exact_dedup.deduplicated(docs)


def remove_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents joined up by SimHash links (3-word shingles, 3 bits), the smallest doc_id stays."""
    ship_package(spark)
    return simhash_dedup.one_per_group(docs, words=3, distance=3)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: documents are dropped or repeated, by systematic sampling."""
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences: every piece of every document with its sequence and its place there."""
    ship_package(spark)
    return packing.pack_digest(docs)


STAGES = [
    ("toxicity", remove_toxic),
    ("exact dedup", remove_copies),
    ("near dedup", remove_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Tokenisation, fingerprints and a trained classifier have no SQL; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
