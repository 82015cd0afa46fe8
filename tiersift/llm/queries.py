"""The queries of the subpackage: each applies one operator, with its production parameters, to its whole table."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, dom, language, licences, quality, simhash, token_bins, token_codec, token_counts, warc
from .common import table

VOCAB_SIZE, END_ID = 50_257, 2


def vocabulary(name: str) -> str:
    """A vocabulary file's path: in TIERSIFT_VOCABULARIES if that is set, else from the installed package."""
    if folder := os.environ.get("TIERSIFT_VOCABULARIES"):
        return os.path.join(folder, name)
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_token_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = token_bins.write(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), VOCAB_SIZE, END_ID)
    return token_bins.read(manifest, with_ids=False)


def op2_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_codec.round_trip(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.captures(table(spark, sf_dir, "pages"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.languages(table(spark, sf_dir, "documents"))


def op6_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(table(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"))


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dom.main_texts(table(spark, sf_dir, "pages"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_token_bins, op2_bpe_codec, op3_warc, op4_decontaminate, op5_language, op6_licences, op7_token_counts, op8_quality, op9_main_text, op10_simhash)}
ORACLE_SQL = {"op6_licences": licences.oracle()}
