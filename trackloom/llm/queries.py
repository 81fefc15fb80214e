"""Queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import filter_audit, license_scan, merkle, tool_calls
from .byte_bpe import encode_documents
from .decontaminate import leaks
from .maxent_lm import score_texts
from .near_dedup import near_dedup
from .packing import pack
from .personal import find_personal
from .substring_dedup import substring_dedup
from .toxicity import toxicity
from .vector_dedup import near_vectors

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


#: Roles of plain chats as tools: (tool, param, type, required).
ROLE_SCHEMAS = [(role, param, kind, True) for role in ("system", "user") for param, kind in (("prompt", "string"), ("turn", "number"))]


def op2_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = tool_calls.from_conversations(table(spark, sf_dir, "conversations"))
    return tool_calls.link(calls, results, spark.createDataFrame(ROLE_SCHEMAS, tool_calls.SCHEMAS))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"))


def op5_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)
    return packed.select("pack_id", "n_segments", "n_ids", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("positions", 256).alias("positions_sha256"), "cu_seqlens", "doc_ids", "parts")


def op7_maxent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"))


def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_tool_calls": op2_tool_calls,
    "op3_decontaminate": op3_decontaminate,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_vector_dedup": op5_vector_dedup,
    "op6_packing": op6_packing,
    "op7_maxent_lm": op7_maxent_lm,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_near_dedup": op9_near_dedup,
    "op10_license_scan": op10_license_scan,
    "op11_filter_audit": op11_filter_audit,
    "op12_merkle": op12_merkle,
    "op13_personal_data": op13_personal_data,
}

#: Learned models, sketches, packing and token ids are beyond SQL; tests/llm holds them against brute force.
ORACLE_SQL: dict[str, str] = {
    "op10_license_scan": license_scan.oracle_sql(),
    "op11_filter_audit": filter_audit.oracle_sql(),
    "op12_merkle": merkle.oracle_sql(),
}
