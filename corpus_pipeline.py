"""A corpus pipeline of five operators: from documents to token ids.

Each stage is a function of the session, the documents its predecessor kept, and the folder of
the given tables. Stages are written as Parquet and read again, so a lost executor costs the
stage it was in at most.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from retally.llm import byte_bpe, mixing, near_dup, quality, suffix_dedup
from retally.llm.common import table, written
from retally.llm.queries import TOKENIZERS

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def keep_quality(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    model = quality.train(docs, table(spark, folder, "labels"))
    scored = quality.score(docs, model, name="quality_score")
    return scored.where(F.col(scored.columns[-1]) >= quality.THRESHOLD).select(docs.columns)


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return near_dup.one_of_each(docs)


def remove_repeated_strings(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents without the strings that start elsewhere too. A document of which nothing is left
    stays, with an empty text; ``n_chars`` follows the text, null texts stay null."""
    found = suffix_dedup.dedup(docs, whole_characters=True)
    left = F.when(F.col("text").isNotNull(), F.col(found.columns[-1]).cast("string"))
    return found.withColumn("text", left).withColumn("n_chars", F.char_length("text").cast("long")).select(docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """The mix of the sources: documents once for each time a shard draws them, shuffled."""
    return mixing.mix(docs)


def encode_bytes(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Per row of the mix: ids of the text, where each token ends in it, and a digest of what the
    ids decode to."""
    found = byte_bpe.encode(docs.select("doc_id", "source", "text"), f"{TOKENIZERS}/byte_bpe_50k.tiktoken", decoded="decoded")
    return found.select(
        "doc_id",
        "source",
        F.size("ids").cast("long").alias("n_tokens"),
        "ids",
        F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES: list[tuple[str, Stage]] = [
    ("quality", keep_quality),
    ("near_duplicates", keep_one_of_near_duplicates),
    ("repeated_strings", remove_repeated_strings),
    ("mixing", mix_sources),
    ("byte_bpe", encode_bytes),
]

#: SQL has none of the trained model, the sketches or the merges: tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    """All stages, applied to the documents."""
    docs = table(spark, folder, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, folder), f"pipeline-{name}")
    return docs
