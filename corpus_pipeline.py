"""Documents to token files: language, near duplicates, contamination, mix, tokens.

Each stage works on all that the one before kept, written as Parquet and
read again.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stepcorpus.llm import language_mixture, mixing, near_dups, pfor, phrase_index
from stepcorpus.llm.queries import END_ID, TOKENIZER
from stepcorpus.session import bound_batches, materialize, ship_package
from stepcorpus.sources.tables import table

MIX_SHARE = 0.8  # of the tokens that reach the mix, each document once at most


def _prepare(spark: SparkSession) -> None:
    """All stages run in the same executors, so each bounds what its tasks hand to Python."""
    ship_package(spark)
    bound_batches(spark)


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without a language go."""
    _prepare(spark)
    return language_mixture.accepted(docs)


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares 80 % of its five-word shingles stays."""
    _prepare(spark)
    return near_dups.deduplicate(docs)


def uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts of which a twentieth or more is benchmark phrases go."""
    _prepare(spark)
    return phrase_index.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def target_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources by their target weights."""
    _prepare(spark)
    return mixing.take(docs, share=MIX_SHARE, max_epochs=1)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of what is left, as read back from them."""
    _prepare(spark)
    return pfor.token_files(docs, TOKENIZER, END_ID)


STAGES = [("language ID", known_language), ("near duplicates", one_of_near_duplicates), ("decontamination", uncontaminated),
          ("mixing", target_mix), ("token files", token_files)]

#: Language mixtures, minwise trees and the tokenizer are beyond SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), "pipeline")
    return docs
