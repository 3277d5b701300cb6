"""Registered queries of the operators, each over its whole table, and SQL where SQL has the answer."""

from __future__ import annotations

import os
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from retally.llm import ann, byte_bpe, cap_links, chat, fingerprints, mixing, near_dup, quality, repair, suffix_dedup, token_files, warc, whitening
from retally.llm.common import table

#: Folder of the public vocabularies; the driver reads them and sends them to the executors.
TOKENIZERS = os.environ.get("TOKENIZERS") or os.path.dirname(public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op1_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_dedup.digests(table(spark, folder, "documents"))


def op2_chat(spark: SparkSession, folder: str) -> DataFrame:
    return chat.digests(table(spark, folder, "conversations"))


def op3_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return byte_bpe.digests(table(spark, folder, "documents"), f"{TOKENIZERS}/byte_bpe_50k.tiktoken")


def op4_near_dup(spark: SparkSession, folder: str) -> DataFrame:
    return near_dup.classes(table(spark, folder, "documents"))


def op5_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.predictions(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op6_token_files(spark: SparkSession, folder: str) -> DataFrame:
    return token_files.digests(table(spark, folder, "documents"), f"{TOKENIZERS}/word_bpe_49k.json")


def op7_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints.digests(table(spark, folder, "documents"))


def op8_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc.round_trip(table(spark, folder, "pages"))


def op9_ann(spark: SparkSession, folder: str) -> DataFrame:
    return ann.search_embeddings(table(spark, folder, "embeddings"))


def op10_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.digests(table(spark, folder, "documents"))


def op11_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    return repair.digests(table(spark, folder, "conversations"))


def op12_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.components_of(table(spark, folder, "embeddings"))


def op13_cap_links(spark: SparkSession, folder: str) -> DataFrame:
    return cap_links.link_counts(table(spark, folder, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_chat": op2_chat,
    "op3_byte_bpe": op3_byte_bpe,
    "op4_near_dup": op4_near_dup,
    "op5_quality": op5_quality,
    "op6_token_files": op6_token_files,
    "op7_fingerprints": op7_fingerprints,
    "op8_warc": op8_warc,
    "op9_ann": op9_ann,
    "op10_mixing": op10_mixing,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_whitening": op12_whitening,
    "op13_cap_links": op13_cap_links,
}
ORACLES: dict[str, str] = {
    "op1_suffix_dedup": suffix_dedup.ORACLE,
    "op2_chat": chat.ORACLE,
    "op8_warc": warc.ORACLE,
    "op10_mixing": mixing.ORACLE,
    "op11_conversation_repair": repair.ORACLE,
    "op13_cap_links": cap_links.ORACLE,
}
