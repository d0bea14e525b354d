"""The index: files and chunks in hash buckets by file, copied on write, under a manifest that is swapped whole.

``<index>/manifest.json`` names for every bucket the run that wrote it last: its rows lie in
``<index>/snapshots/<run>/{files,chunks}/bucket=<b>``. A run rewrites only buckets in which a file is new,
changed or gone, and replaces the manifest last, so a reader sees the old state or the new one, and a
run that breaks off leaves the old. What a run replaces is deleted by the next one, as readers of the last
state may still be at work. Chunk ids are hashes of path, ordinal and text: equal input, equal ids.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from seekstone.chunkers.registry import chunk_files, chunker_for
from seekstone.config import CHUNKER_VERSION, INDEX_DIR, Settings
from seekstone.functions import embed as em
from seekstone.sources.tree import read_tree

CHUNKS = "chunk_id bigint, file_path string, start_line int, end_line int, symbol_name string, qualified_name string, kind string, code_text string, language string, truncated boolean, content_hash string, embedding array<float>"
FILES = "file_path string, file_hash string"


class IndexNotFoundError(RuntimeError):
    """No index, or one that another embedding model made."""


@dataclass(frozen=True)
class IndexStats:
    """What an indexing run did."""

    files_scanned: int = 0
    files_indexed: int = 0
    files_skipped: int = 0
    files_removed: int = 0
    chunks_written: int = 0
    chunker_upgraded: bool = False


class _Files:
    """A folder through Hadoop's file systems, so that an index may lie in any of them."""

    def __init__(self, spark: SparkSession, top: str):
        self._jvm, self._conf, self.top = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), top.rstrip("/")
        self._fs = self._path("").getFileSystem(self._conf)

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.top}/{name}" if name else self.top)

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._path(name))

    def read(self, name: str) -> str:
        stream = self._fs.open(self._path(name))
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def replace(self, name: str, text: str) -> None:
        """Write a file under another name and rename it over the old one."""
        self._fs.mkdirs(self._path(""))
        out = self._fs.create(self._path(f".{name}.new"), True)
        out.write(bytearray(text.encode()))
        out.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf)
        options = self._jvm.org.apache.hadoop.fs.Options.Rename
        over = self._jvm.java.lang.reflect.Array.newInstance(options.OVERWRITE.getClass(), 1)
        over[0] = options.OVERWRITE
        context.rename(self._path(f".{name}.new"), self._path(name), over)

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(name), True)


class Index:
    """An index folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.files_ = spark, folder.rstrip("/"), _Files(spark, folder)

    @classmethod
    def of(cls, spark: SparkSession, root: str, folder: str | None = None) -> Index:
        return cls(spark, folder or f"{root.rstrip('/')}/{INDEX_DIR}")

    def manifest(self) -> dict | None:
        return json.loads(self.files_.read("manifest.json")) if self.files_.exists("manifest.json") else None

    def _table(self, name: str, schema: str, only: set[int] | None = None) -> DataFrame:
        """A table's rows, of all buckets or of some."""
        places = (self.manifest() or {}).get("buckets", {}).get(name, {})
        paths = [f"{self.folder}/snapshots/{run}/{name}/bucket={b}" for b, run in places.items() if only is None or int(b) in only]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*paths)

    def files(self, only: set[int] | None = None) -> DataFrame:
        return self._table("files", FILES, only)

    def chunks(self, only: set[int] | None = None) -> DataFrame:
        return self._table("chunks", CHUNKS, only)

    def open_for(self, embedder: em.Embedder) -> DataFrame:
        """The chunks, if this embedder made their vectors."""
        m = self.manifest()
        if not m:
            raise IndexNotFoundError(f"no index in {self.folder}; run index first")
        if m["embedding_fingerprint"] != em.fingerprint(embedder):
            raise IndexNotFoundError(f"the index has vectors of {m['embedding_model']}, not {embedder.name}; re-run with --rebuild")
        return self.chunks()

    def is_stale(self) -> bool:
        m = self.manifest()
        return bool(m) and m["chunker_version"] != CHUNKER_VERSION

    def status(self) -> dict:
        m = self.manifest()
        if not m:
            raise IndexNotFoundError(f"no index in {self.folder}")
        return {"path": self.folder, "embedding_model": m["embedding_model"], "chunker_version": m["chunker_version"], "chunks": self.chunks().count(), "files": self.files().count(), "indexed_at": m["indexed_at"]}

    def delete_snapshots(self) -> None:
        """Remove this index's own files and nothing else."""
        for name in ("manifest.json", "snapshots"):
            self.files_.delete(name)


def change_plan(current: DataFrame, previous: DataFrame) -> DataFrame:
    """file_path, file_hash (current), status (new, changed, unchanged, removed) and the columns of
    current: one full outer join of the states by path."""
    old = previous.select(F.col("file_path").alias("old_path"), F.col("file_hash").alias("old_hash"))
    joined = current.join(old, F.col("file_path") == F.col("old_path"), "full_outer")
    status = F.when(F.col("old_path").isNull(), "new").when(F.col("file_path").isNull(), "removed").when(F.col("file_hash").eqNullSafe(F.col("old_hash")), "unchanged").otherwise("changed")
    return joined.withColumn("status", status).withColumn("file_path", F.coalesce("file_path", "old_path")).drop("old_path", "old_hash")


def _counters() -> list[Column]:
    """Files scanned, indexed, skipped and removed, as aggregates over a plan."""
    of = lambda *names: F.count_if(F.col("status").isin(*names))
    return [of("new", "changed", "unchanged").alias("files_scanned"), of("new", "changed").alias("files_indexed"), of("unchanged").alias("files_skipped"), of("removed").alias("files_removed")]


def plan_counts(plan: DataFrame) -> DataFrame:
    """One row: files scanned, indexed, skipped and removed."""
    return plan.agg(*_counters())


def bucket_of(path: Column, buckets: int) -> Column:
    """The hash bucket of a file."""
    return (F.conv(F.substring(F.md5(path), 1, 8), 16, 10).cast("long") % buckets).cast("int")


def touched_buckets(plan: DataFrame, buckets: int) -> DataFrame:
    """bucket: those in which a file is new, changed or removed."""
    return plan.where("status != 'unchanged'").select(bucket_of(F.col("file_path"), buckets).alias("bucket")).distinct()


def merge_chunks(kept_from: DataFrame, plan: DataFrame, fresh: DataFrame) -> DataFrame:
    """The chunks of untouched files, with the fresh ones: purge, upsert and append in one."""
    touched = plan.where("status != 'unchanged'").select("file_path")
    return kept_from.join(touched, "file_path", "left_anti").select(*fresh.columns).unionByName(fresh)


def index_tree(
    spark: SparkSession,
    root: str,
    folder: str | None = None,
    settings: Settings | None = None,
    rebuild: bool = False,
    embedder: em.Embedder | None = None,
    factory: Callable = chunker_for,
) -> IndexStats:
    """Bring the index of a tree up to date; see :func:`index_files`."""
    index = Index.of(spark, root, folder)
    files = read_tree(spark, root, settings or Settings(), skip=(index.folder.removeprefix("file://"),))
    return index_files(spark, files, index.folder, settings, rebuild, embedder, factory)


def index_files(
    spark: SparkSession,
    files: DataFrame,
    folder: str,
    settings: Settings | None = None,
    rebuild: bool = False,
    embedder: em.Embedder | None = None,
    factory: Callable = chunker_for,
) -> IndexStats:
    """Bring an index up to date with all its files (file_path, ext, content): only new and changed files are chunked and embedded.

    An index of another embedding model is an error unless it is rebuilt; other chunk settings or an
    older chunker rebuild it.
    """
    settings = settings or Settings()
    own = embedder or em.build_embedder(settings)
    index = Index(spark, folder)
    old = index.manifest()
    if old and not rebuild and old["embedding_fingerprint"] != em.fingerprint(own):
        raise ValueError(f"the index was made with {old['embedding_model']}, not {own.name}. Re-run with --rebuild")
    upgraded = bool(old) and not rebuild and (old["chunker_version"], old["chunk_fingerprint"]) != (CHUNKER_VERSION, settings.chunk_fingerprint())
    upgraded = upgraded or bool(old) and not rebuild and old.get("n_buckets") != settings.index_buckets
    fresh_start = rebuild or upgraded or not old
    number = (old["snapshot"] if old else 0) + 1
    top = f"{index.folder}/snapshots/{number}"
    previous = spark.createDataFrame([], FILES) if fresh_start else index.files()

    files = files.withColumn("file_path", F.translate("file_path", "\\", "/")).withColumn("file_hash", F.sha2("content", 256))
    plan = change_plan(files, previous)
    content = F.when(F.col("status").isin("new", "changed"), F.col("content"))
    counted, cut = Observation("plan"), Observation("chunks")  # counters are taken while the tables are written
    plan.withColumn("content", content).observe(counted, *_counters()).write.mode("overwrite").parquet(f"{top}/plan")  # one scan of the tree feeds all
    plan = spark.read.parquet(f"{top}/plan")
    touched = {r["bucket"] for r in touched_buckets(plan, settings.index_buckets).collect()}  # at most as many as there are buckets

    chunks = chunk_files(plan.where("status in ('new', 'changed')"), settings, factory)
    chunks = chunks.withColumn("content_hash", F.sha2("code_text", 256)).withColumn("chunk_id", F.xxhash64("file_path", "ordinal", "content_hash"))
    names = [c.split(" ")[0] for c in CHUNKS.split(", ")]
    fresh = em.embed(chunks.drop("ordinal"), "embed_text", settings, embedder).select(*names)
    fresh.observe(cut, F.count("*").alias("n")).write.mode("overwrite").parquet(f"{top}/fresh")
    fresh = spark.read.schema(CHUNKS).parquet(f"{top}/fresh")
    own_bucket = bucket_of(F.col("file_path"), settings.index_buckets)
    state = plan.where("status != 'removed'").select("file_path", "file_hash")
    rows = {"chunks": fresh if fresh_start else merge_chunks(index.chunks(touched), plan, fresh), "files": state.where(own_bucket.isin(*touched) if touched else F.lit(False))}
    places = {} if fresh_start else {name: dict(old["buckets"].get(name, {})) for name in rows}
    retired = []
    for name, table in rows.items():
        kept = places.setdefault(name, {})
        retired += [f"{kept.pop(str(b))}/{name}/bucket={b}" for b in touched if str(b) in kept]
        written = Observation(name)
        dealt = table.withColumn("bucket", own_bucket).repartition("bucket")
        dealt.observe(written, F.collect_set("bucket").alias("buckets")).write.mode("overwrite").partitionBy("bucket").parquet(f"{top}/{name}")
        kept.update({str(b): number for b in written.get["buckets"]})
    if old and fresh_start:
        retired = [f"{run}/{name}/bucket={b}" for name, runs in old.get("buckets", {}).items() for b, run in runs.items()]
    stats = IndexStats(**counted.get, chunks_written=cut.get["n"], chunker_upgraded=upgraded)
    for name in ("plan", "fresh"):
        index.files_.delete(f"snapshots/{number}/{name}")
    manifest = {"embedding_model": own.name, "embedding_fingerprint": em.fingerprint(own), "chunker_version": CHUNKER_VERSION, "chunk_fingerprint": settings.chunk_fingerprint(), "max_chunk_tokens": settings.max_chunk_tokens, "snapshot": number, "n_buckets": settings.index_buckets, "buckets": places, "retired": retired, "indexed_at": time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime()), "stats": asdict(stats)}
    index.files_.replace("manifest.json", json.dumps(manifest, indent=2))
    for place in (old or {}).get("retired", []):
        index.files_.delete(f"snapshots/{place}")
    return stats
