"""Corpus pipeline: documents in, token counts and digests of the clean part out.

Each stage gets what the one before kept, as written and read again, and its decisions take effect: rows it rejects are
gone, lines it removes are out of the texts. All but the last return the columns of their input, extra ones included.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tallycard.llm import bpe, decontaminate, lines, neardup, quality
from tallycard.session import scratch_path, ship


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality rules keep."""
    ship(spark)
    return quality.drop_rejected(docs)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, without the lines that many sites share; n_chars follows the text."""
    ship(spark)
    return lines.drop_spread_lines(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts linked by a similarity of 0.8 or more on shingles of five words."""
    ship(spark)
    return neardup.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text holds no item of the benchmark table."""
    ship(spark)
    return decontaminate.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, and the digests of ids and decoded text."""
    ship(spark)
    return bpe.encode_documents(docs, bpe.vocabulary(), form="digests")


STAGES = [
    ("quality rules", quality_stage),
    ("line dedup", line_stage),
    ("minhash near-dedup", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("bpe encoding and decoding", encoding_stage),
]

#: Robust estimates, near-duplicate groups and token ids are beyond SQL; tests/llm holds brute-force versions of the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each written to the shared folder and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for n, (_, stage) in enumerate(STAGES):
        path = scratch_path(spark, f"stage{n}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
