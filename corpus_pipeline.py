"""Corpus pipeline over ``documents``: language ID, near-duplicates, benchmark
decontamination, personal data, byte-level BPE.

Every stage takes (spark, docs, sf_dir) and works on all rows the stage before
kept; its result is written as Parquet to the shared checkpoint folder and read
again as the next one's docs.  Counted as part of ``stayline.llm``.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stayline.llm import bpe_codec, decontam, lang_id, near_dup, pii
from stayline.llm.catalog import TEST_KEY
from stayline.session import checkpoint_dir

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without letters, or in no learned language, go."""
    parsers = lang_id.fit(lang_id.training_rows(docs), "text", "lang", "doc_id")
    return lang_id.predict(docs.select(*COLUMNS), "text", parsers).where("accepted").select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays (five words, similarity 0.8)."""
    return near_dup.deduplicate(docs, words=5, percent=80).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with ten consecutive words of a benchmark item go."""
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontam.clean(docs, bench, span=10).select(*COLUMNS)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data become surrogates; n_chars follows the new text."""
    # the surrogates' key is the session's; without one the test key of the queries serves
    key = spark.conf.get("spark.stayline.surrogateKey", TEST_KEY)
    out = pii.replace_pii(docs.select(*COLUMNS), "text", key)
    return out.withColumn("n_chars", F.when(F.col("n_replaced") > 0, F.length("text").cast("bigint"))
                          .otherwise(F.col("n_chars"))).select(*COLUMNS)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, and whether they decode to it."""
    out = bpe_codec.encode_decode(docs.select(*COLUMNS), "text",
                                  public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    same = F.coalesce(F.col("text"), F.lit("")) == F.col("decoded")
    return out.withColumn("round_trip", same).drop("decoded")


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontamination", decontamination),
          ("personal_data", personal_data), ("byte_bpe", byte_bpe)]
#: Suffix automata, keyed surrogates and BPE merges are beyond SQL; tests/llm
#: holds every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
