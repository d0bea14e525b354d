"""The corpus pipeline: five stages over the documents, each written as Parquet and read again.

Each stage works on all rows that its predecessor kept: quality rules drop documents, line dedup
shortens texts, near-dedup keeps one document of each group, mixing repeats and drops documents to
meet the sources' targets, and BPE adds the ids. All but the last return the columns of documents.

Defined cases, as the stages have them: null and empty texts fail the quality rules, and so do texts of few words; null
langs and sources are groups like any other; rows that repeat doc_id and text are kept or dropped together by
the first two stages and by near-dedup, but one row stays of a group without any doc_id; texts are whole, of any
length; ties are broken by doc_id and hashes, so reruns agree; extra columns go through, whatever their names; an
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from seekstone.llm import bpe, line_dedup, minhash, mixing, quality
from seekstone.llm._common import table, written

STAGES = [
    ("quality", quality.stage),
    ("line_dedup", line_dedup.stage),
    ("near_dedup", minhash.stage),
    ("mixing", mixing.stage),
    ("bpe", bpe.stage),
]

#: Near-dedup, mixing and BPE have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
