"""Keep the line windows of a growing table of documents up to date.

A file stream takes the Parquet files that came since the last run (its checkpoint knows which) and
ends when there are no more. Of their documents only new and changed ones, by the hash of their
text, are cut into windows; a batch of the stream writes one partition of each table, so that a
batch that is run again overwrites its own output and nothing else:

    <output>/windows/batch=<n>/lang=<lang>   windows of the batch's new and changed documents
    <output>/files/batch=<n>                 file_path, doc_id, file_hash and number of windows of these documents

:func:`current` reads the windows of every document's last version. The files of a batch are written
after its windows, so a reader in between, or after a crash, still sees the versions before it. A
checkpoint and its output belong together.

Rows without doc_id are counted and left out. Of several texts of one doc_id in one batch, the one
with the greatest hash counts; over batches the last. A null text has no windows; a null or empty
lang is the partition "none". Documents that are no longer delivered stay.

    python -m jobs.refresh_windows --documents DIR --output DIR --checkpoint DIR [--config jobs/refresh_windows.json]
"""

from __future__ import annotations

import argparse
import logging
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import common
from seekstone import registry
from seekstone.chunkers.registry import fallback_windows
from seekstone.config import Settings
from seekstone.functions import text as tx
from seekstone.plans.folders import new_folder

log = logging.getLogger("refresh_windows")

DOCUMENTS = "doc_id long, text string, lang string"
WINDOWS = "doc_id long, file_path string, symbol_name string, start_line int, end_line int, n_tokens int, text_hash string, batch long, lang string"
FILES = "file_path string, doc_id long, file_hash string, n_windows long, batch long"


@dataclass(frozen=True)
class Config:
    window_lines: int = 60
    overlap_lines: int = 10
    max_files_per_batch: int = 200


def _stored(spark: SparkSession, output: str, name: str, schema: str) -> DataFrame:
    """A table of the output, empty before the first batch."""
    try:
        return spark.read.schema(schema).parquet(f"{output}/{name}")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def versions(spark: SparkSession, output: str, before: int | None = None) -> DataFrame:
    """file_path, doc_id, file_hash, n_windows and batch of every document's last version (of batches below ``before``)."""
    files = spark.createDataFrame([], FILES) if before == 0 else _stored(spark, output, "files", FILES)
    if before is not None:
        files = files.where(F.col("batch") < before)
    last = files.groupBy("file_path").agg(F.max(F.struct("batch", "doc_id", "file_hash", "n_windows")).alias("v"))
    return last.select("file_path", "v.doc_id", "v.file_hash", "v.n_windows", "v.batch")


def current(spark: SparkSession, output: str) -> DataFrame:
    """The windows of every document's last version."""
    last = versions(spark, output).where("n_windows > 0").select(F.col("file_path").alias("__path"), F.col("batch").alias("__batch"))
    windows = _stored(spark, output, "windows", WINDOWS)
    return windows.join(last, (F.col("file_path") == F.col("__path")) & (F.col("batch") == F.col("__batch"))).drop("__path", "__batch", "batch")


def changed_documents(batch: DataFrame, known: DataFrame) -> DataFrame:
    """file_path, doc_id, text, lang and file_hash of the batch's documents that are new or have another text than ``known`` says."""
    text = F.coalesce("text", F.lit(""))
    rows = batch.where("doc_id is not null").select("doc_id", text.alias("text"), F.when(F.col("lang") != "", F.col("lang")).otherwise("none").alias("lang"), F.sha2(text, 256).alias("file_hash"))
    one = rows.groupBy("doc_id").agg(F.max(F.struct("file_hash", "lang", "text")).alias("v"))
    path = F.concat(F.lit("docs/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    files = one.select(path.alias("file_path"), "doc_id", "v.text", "v.lang", "v.file_hash")
    old = known.select(F.col("file_path").alias("__path"), F.col("file_hash").alias("__hash"))
    return files.join(old, F.col("file_path") == F.col("__path"), "left").where(~F.col("file_hash").eqNullSafe(F.col("__hash"))).drop("__path", "__hash")


def windows_of(files: DataFrame, config: Config) -> DataFrame:
    cut = fallback_windows(files, Settings(window_lines=config.window_lines, overlap_lines=config.overlap_lines))
    told = cut.select("file_path", "symbol_name", "start_line", "end_line", tx.token_count(F.col("code_text")).cast("int").alias("n_tokens"), F.sha2("code_text", 256).alias("text_hash"))
    return told.join(files.select("file_path", "doc_id", "lang"), "file_path")


def refresh(spark: SparkSession, documents: str, output: str, checkpoint: str, config: Config | None = None) -> dict:
    """One run: all files that came since the last one. Returns the numbers of batches, rows, documents and windows."""
    config, output = config or Config(), output.rstrip("/")
    done = {"batches": 0, "rows": 0, "without_id": 0, "documents": 0, "windows": 0}

    def take(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        files = changed_documents(batch, versions(session, output, number)).persist()  # feeds both tables
        windows = windows_of(files, config)
        windows.write.mode("overwrite").partitionBy("lang").parquet(f"{output}/windows/batch={number}")
        written = session.read.schema(WINDOWS).parquet(f"{output}/windows/batch={number}")
        counts = written.groupBy(F.col("file_path").alias("__path")).agg(F.count("*").alias("n_windows"))
        state = files.join(counts, F.col("file_path") == F.col("__path"), "left").select("file_path", "doc_id", "file_hash", F.coalesce("n_windows", F.lit(0)).cast("long").alias("n_windows"))
        state.write.mode("overwrite").parquet(f"{output}/files/batch={number}")
        rows, without = batch.agg(F.count("*"), F.count_if(F.col("doc_id").isNull())).first()
        n, m = session.read.schema("n_windows long").parquet(f"{output}/files/batch={number}").agg(F.count("*"), F.coalesce(F.sum("n_windows"), F.lit(0))).first()
        files.unpersist()
        log.info("batch %d: read %d rows (%d without doc_id), wrote %d new or changed documents with %d windows", number, rows, without, n, m)
        for name, x in zip(done, (1, rows, without, n, m)):
            done[name] += x

    # as a pattern, the path of one file will do as well as a folder's
    path = documents if any(c in documents for c in "*?[{") else f"{documents[:-1]}[{documents[-1]}]"
    stream = spark.readStream.schema(DOCUMENTS).option("maxFilesPerTrigger", config.max_files_per_batch).parquet(path)
    run = stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    run.awaitTermination()
    log.info("read %s, wrote %s: %s", documents, output, done)
    return done


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs over all documents into one new folder; what is there after the second."""
    folder = new_folder(spark, "refresh-windows")
    for _ in range(2):
        refresh(spark, f"{sf_dir}/documents.parquet", f"{folder}/out", f"{folder}/checkpoint")
    return current(spark, f"{folder}/out")


SQL = registry.windows_sql(60, 10) + f"""
SELECT replace(replace(x.file_path, 'docs/', ''), '.txt', '')::BIGINT AS doc_id, x.file_path, x.name || ':window' || (i + 1) AS symbol_name, (i * 50 + 1)::INT AS start_line,
       least(i * 50 + 60, len(ls))::INT AS end_line, {registry.tokens_sql('t')}::INT AS n_tokens, sha256(t) AS text_hash, coalesce(nullif(g.lang, ''), 'none') AS lang
FROM x JOIN (SELECT 'docs/' || doc_id || '.txt' AS file_path, lang FROM documents) g ON g.file_path = x.file_path WHERE {registry.BLANK_SQL}"""


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="refresh_windows", description="Bring the windows of a growing table of documents up to date.")
    p.add_argument("--documents", required=True, help="folder (or file, or pattern) of Parquet files with doc_id, text, lang")
    p.add_argument("--output", required=True)
    p.add_argument("--checkpoint", required=True)
    p.add_argument("--config", help="JSON file; see jobs/refresh_windows.json")
    args = p.parse_args(argv)
    config = common.read_config(Config, args.config)
    spark = common.start("refresh_windows")
    try:
        refresh(spark, args.documents, args.output, args.checkpoint, config)
    finally:
        spark.stop()
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
