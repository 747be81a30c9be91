"""The corpus pipeline: rules, exact and near duplicates, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns what it keeps of `docs`; all but the last return
the columns of `documents`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm import exact_dedup, jaccard_join, mixing, quality_rules, sentence_pieces
from brindle.llm.common import drop_table, shared_table
from brindle.llm.queries import PIECE_MODEL, TARGETS, domain_of


def pass_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go, and the lines above the limit from the others."""
    return quality_rules.clean(docs, length_column="n_chars")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts, the one with the largest id stays."""
    return exact_dedup.keep_one(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by 80 % of their five-word shingles, the one with the smallest id stays."""
    return jaccard_join.keep_one_of_each(docs, percent=80, n=5)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents by target weights, once for each epoch that they are in."""
    return mixing.mix(docs, domain_of(F.col("source")), TARGETS).select(*docs.columns)


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each chosen document in place of its text."""
    return sentence_pieces.encode(docs, PIECE_MODEL).withColumn("n_tokens", F.size("token_ids").cast("long"))


STAGES = [
    ("quality rules", pass_rules),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing sources to target weights", mix_sources),
    ("SentencePiece encoding", encode_texts),
]

#: Token ids are beyond SQL; the stages are tested against brute force instead.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each on what the one before kept; a stage's table goes once the next is written."""
    docs, spent = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs = shared_table(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
        if spent is not None:
            drop_table(spent)
        spent = docs
    return STAGES[-1][1](spark, docs, sf_dir)
