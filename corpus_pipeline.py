"""The corpus pipeline: language, near-duplicates, repeated passages, mix, tokens.

All stages but the last return the columns of their input, clashing names and extra ones included, and take an empty table to an empty
one. Rows are judged each for itself, but for the groups that the stages are about. A text of any length is read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from glossa.llm import bpe, langid, mixing, simhash, substrings
from glossa.llm.common import cut, drop_cut
from glossa.session import ship


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the language identifier accepts. Null and empty texts go, and all texts if no row has a label; rows without an id or label are judged like others, repeated rows all alike."""
    ship(spark)
    return langid.accept(docs, langid.fit(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, that of the least id. Rows without an id stay; of equal rows of an id one stays, of different texts of an id each."""
    ship(spark)
    return simhash.deduplicate(docs)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without passages that one of a lesser id has. Documents that are one passage go; null and empty texts, and rows without an id, stay as they are."""
    ship(spark)
    return substrings.remove(docs, length_col="n_chars")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents at the positions that the sources' schedules give them. Texts without a word have no position and go; rows without a source are of a source of their own; a row that the mix takes several times comes as often."""
    ship(spark)
    return mixing.apply_mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as token ids, a row each; null texts have null ids, empty ones none."""
    ship(spark)
    return bpe.encode(docs)


STAGES = [("language ID", language), ("SimHash near-dedup", near_duplicates), ("substring dedup", passages), ("mixing sources", mix), ("byte-level BPE", tokens)]

#: SimHash, the network, chaining and BPE have no SQL; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder, each written as Parquet to the shared folder and read again; what a stage has read goes once the next is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        before, docs = docs, cut(stage(spark, docs, sf_dir))
        drop_cut(before)
    return STAGES[-1][1](spark, docs, sf_dir)
