"""The corpus pipeline: toxicity, near-duplicates, repeated passages, benchmark leaks, token ids.

Every stage takes all rows that the one before kept.  A row with a null doc_id
or a null or empty text stays; rows that repeat a doc_id share the decision on
it; columns beyond those of ``documents`` pass through, whatever their names;
an empty table gives an empty one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.llm.byte_bpe import encode_documents
from trackloom.llm.decontaminate import leaks
from trackloom.llm.near_dedup import near_dedup
from trackloom.llm.queries import VOCABULARY
from trackloom.llm.scratch import written
from trackloom.llm.substring_dedup import substring_dedup
from trackloom.llm.toxicity import toxicity


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``docs`` but for the documents in ``ids`` (doc_id); rows without doc_id stay."""
    return docs.join(written(ids.where("doc_id is not null").distinct()), "doc_id", "left_anti").select(docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents whose toxicity score reaches the operator's threshold."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return without(docs, toxicity(docs, labels).where("predicted = 1").select("doc_id"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each near-duplicate group."""
    return without(docs, near_dedup(docs).where(~F.col("kept")).select("doc_id"))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the 50-word windows of smaller doc_ids; ``n_chars``, where it is there, is counted again."""
    others = [c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]
    cut = substring_dedup(docs, keep=tuple(others), keep_text=True)
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return cut.select(docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a benchmark item."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return without(docs, leaks(docs, benchmark).select("doc_id"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Numbers of tokens and digests of ids and of decoded bytes, a row per document."""
    return encode_documents(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("substring_dedup", cut_repeats),
    ("decontamination", drop_leaks),
    ("byte_bpe", encode),
]

#: Learned scores, sketches and byte-level merges are beyond SQL; tests/llm holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's rows written and read again as the next one's."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs)
    return docs
