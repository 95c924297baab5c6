"""Corpus pipeline: toxic documents go, then documents without a clear language, then near copies; what is left is packed.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as Parquet in the shared
checkpoint folder and reads it again as the next stage's ``docs``. All stages but the last keep the columns of
``documents``. Rows with a null or empty text have no language and go in the second stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pairforge.llm import jaccard, language, packing, toxicity
from pairforge.llm.common import staged, table
from pairforge.llm.queries import PACK_END, PACK_TOKENS, language_profiles, toxicity_network, vocabulary
from pairforge.session import ensure_checkpoint_dir


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the network, trained on the labels outside its held-out fold, scores below 0.5."""
    return toxicity.keep_clean(docs, toxicity_network(spark, sf_dir))


def keep_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a main language."""
    return language.keep_identified(docs, language_profiles(spark, sf_dir))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each class of near copies: five-word shingles, Jaccard 0.8 and more."""
    return jaccard.keep_one(docs, k=5, part=80)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' tokens, packed into sequences."""
    return packing.pack_documents(docs, vocabulary("word_bpe_49k.json"), PACK_TOKENS, PACK_END)


STAGES = [("toxicity", drop_toxic), ("language", keep_language), ("near_copies", drop_near_copies), ("packing", pack)]

#: The network and the language model can't be written in SQL; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
