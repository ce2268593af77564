"""Corpus cleaning pipeline over ``documents``; each stage's output is written as Parquet and read again by the next.

1. quality: documents that the classifier rejects go;
2. exact: of equal texts the row with the least doc_id stays;
3. near: of documents linked by word shingles the one with the least doc_id stays;
4. mix: rows repeat or go until each source's words meet its target;
5. encode: whole texts become token ids (columns doc_id, n_tokens, digests and ids).

No SQL can express stages 1, 3 and 5; tests compare each stage's kept rows with plain Python on the small table.

Defined results: a null text counts as empty (an empty document is judged by the classifier's bias, and its copies are exact copies); a
row without doc_id is judged by its own text and goes where its group has a row with one; rows that repeat doc_id and text are
exact copies, of which one stays; an empty table gives no rows; extra columns are kept up to the mix and dropped by the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wayfold.llm import exact_dedup, mixing, ngram_join, piece_codec, quality
from wayfold.llm.common import materialize


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.drop_rejected(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.drop_duplicates(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_one(docs)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.take(docs)


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return piece_codec.encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model"), with_ids=True)


STAGES = [("quality", quality_stage), ("exact", exact_stage), ("near", near_stage), ("mix", mix_stage), ("encode", encode_stage)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents`` table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
