"""From raw documents to tokens: quality, lines, near-duplicates, benchmark, encoding.

Each stage takes ``(spark, docs, sf_dir)`` and works on all that the one before it
kept. ``run`` writes a stage as Parquet into the shared folder and reads it again
for the next.
"""

from pyspark.sql import DataFrame, SparkSession

from evalweave import scratch
from evalweave.llm import bpe, decontamination, lines, quality, queries, simhash


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules, without their failing lines."""
    return quality.clean(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every line but its first occurrence removed; documents with no line left go."""
    return lines.clean(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group."""
    return simhash.deduplicate(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    return decontamination.decontaminate(docs, queries.table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)`` of what is left."""
    return bpe.digests(docs, *queries.tokenizer())


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("simhash near-dedup", near_dedup),
    ("benchmark decontamination", decontaminated),
    ("byte-level bpe", encoded),
]

# SimHash majorities and sub-word merges have no SQL form; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.store(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
