"""The corpus pipeline: five stages over documents, each written as Parquet and read again as the next one's input.

Defined results: a document without a letter, as of null or empty text, has no language and goes in the first stage. Rows
that repeat are judged alike by the stages that judge texts; the third one keeps one row of each group of near
duplicates, that with the least id, of equal ids that with the least hash of id and text, of rows equal in these any one.
A null id is larger than all others there. All stages but the last keep every column, whatever its name; the last
reads ids and texts. An empty table goes through as an empty table. No stage caps or samples rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tiersift.llm import decontaminate, language, near_copies, quality, simhash, token_codec
from tiersift.llm.common import cut, table
from tiersift.llm.queries import vocabulary


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is found stay."""
    return language.keep_known(docs)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and their language's perplexity band stay."""
    return quality.keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (5-word shingles, Jaccard 0.8 or more) stays, that with the least id.

    They are found by SimHash and its pivot distance table and verified exactly; an exact join adds those beyond its bits.
    """
    return simhash.one_of_each(docs, find=near_copies.near_copies)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by benchmark items stay."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every document that stayed."""
    return token_codec.round_trip(docs, vocabulary("byte_bpe_50k.json"))


STAGES = [
    ("language", language_id),
    ("quality", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("bpe", bpe),
]
#: SQL cannot express the trained models of the first two stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
