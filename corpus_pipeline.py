"""From raw documents to token ids: language, near-duplicates, personal data, source mix, SentencePiece.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept, and is written as Parquet and read
again before the next; all but the last return the columns of `documents`. Texts without a letter, null and empty
ones among them, go with the first stage; null ids, languages and sources stay as they are; other columns pass through
to the mix; an empty table gives no rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tomolake.llm import langid, mixing, pieces, pii, simhash
from tomolake.llm.common import shared_dir

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def identified(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is not rejected."""
    return langid.drop_rejected(docs)


def deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, of the smallest id, of each group of near copies: shingles of five words, similarity 0.8."""
    return simhash.drop_similar(docs)


def sanitised(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data, and terms that disclose it, replaced by their kinds."""
    return pii.sanitise(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents, as often as the mix of sources takes them."""
    return mixing.mixed(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids, n_tokens and the text decoded from the ids."""
    return pieces.encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model"), outputs=("ids", "n_tokens", "decoded"))


STAGES: list[tuple[str, Stage]] = [
    ("language_id", identified),
    ("near_dedup", deduplicated),
    ("pii", sanitised),
    ("mixing", mixed),
    ("sentencepiece", encoded),
]

#: SQL has neither the language models nor SimHash; the stages are tested against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}-{name}")
            docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
