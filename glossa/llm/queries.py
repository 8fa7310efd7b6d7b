"""The subpackage's queries over the tables of a folder, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from glossa.llm import audio, bm25, bpe, chat, langid, licenses, lm, mixing, simhash, substrings


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25.search(_table(spark, sf_dir, "benchmark"), _table(spark, sf_dir, "documents"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.matches(_table(spark, sf_dir, "documents"))


def op4_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_corpus(_table(spark, sf_dir, "documents"))


def op5_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.passages(_table(spark, sf_dir, "documents")).drop("sig")


def op6_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio.align(audio.media_of(_table(spark, sf_dir, "embeddings")), "id", "media")


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.windows(_table(spark, sf_dir, "conversations"))


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.fit(docs))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(_table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_bm25, op2_simhash, op3_licenses, op4_lm, op5_substrings, op6_audio, op7_chat, op8_langid, op9_bpe, op10_mixing)}


def oracle_sql() -> dict[str, str]:
    return {"op1_bm25": bm25.SQL, "op7_chat": chat.SQL, "op10_mixing": mixing.SQL}
