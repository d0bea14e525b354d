"""Chunkers by suffix, and chunking as a table function."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seekstone.chunkers.base import SCHEMA, Chunk, Chunker, FallbackChunker
from seekstone.chunkers.markdown import MarkdownChunker
from seekstone.chunkers.python import PythonChunker
from seekstone.chunkers.script import ScriptChunker
from seekstone.chunkers.sections import markdown_sections
from seekstone.config import LANGUAGES, Settings
from seekstone.functions import text as tx
from seekstone.sources.tree import decoded

#: Chunks of one Arrow batch, about, and bytes of the files that it is made of.
BATCH_CHUNKS, BATCH_BYTES = 1024, 4 << 20


def chunker_for(ext: str, settings: Settings | None = None) -> Chunker:
    """The chunker of a suffix; unknown suffixes have line windows."""
    language = LANGUAGES.get(ext)
    if language == "python":
        return PythonChunker(settings)
    if language == "markdown":
        return MarkdownChunker(settings)
    if language:
        return ScriptChunker(language, settings)
    return FallbackChunker(settings)


def naive_chunker(ext: str, settings: Settings | None = None) -> Chunker:
    """Line windows for every suffix: the baseline of evaluations."""
    return FallbackChunker(settings)


def chunk_files(files: DataFrame, settings: Settings | None = None, factory: Callable[[str, Settings], Chunker] = chunker_for) -> DataFrame:
    """All chunks of files (file_path, ext, content), each with its ordinal in the file.

    Markdown is cut by :func:`markdown_sections` inside the JVM, other files by their chunkers; with a
    ``factory`` of the caller's own, that cuts all.
    """
    settings = settings or Settings()
    if factory is not chunker_for:
        return _by_chunker(files, settings, factory)
    is_markdown = F.col("ext").isin(*[e for e, name in LANGUAGES.items() if name == "markdown"])
    texts = files.where(is_markdown).select(F.translate("file_path", "\\", "/").alias("file_path"), tx.decoded(F.col("content")).alias("text"))
    others = _by_chunker(files.where(~is_markdown), settings, factory)
    return others.unionByName(markdown_sections(texts, settings).select(*others.columns))


def _by_chunker(files: DataFrame, settings: Settings, factory: Callable[[str, Settings], Chunker]) -> DataFrame:
    """The chunks that the chunker of each file's suffix makes, file by file."""
    names = [f.split(" ")[0] for f in SCHEMA.split(", ")]

    def run(batches):
        made: dict[str, Chunker] = {}
        for batch in batches:
            held: list[tuple[int, Chunk]] = []  # of several files: a batch for each would cost more than its chunks
            size = 0
            for path, ext, content in zip(*(batch.column(n).to_pylist() for n in ("file_path", "ext", "content"))):
                if ext not in made:
                    made[ext] = factory(ext, settings)
                found = list(enumerate(made[ext].chunk_file(path.replace("\\", "/"), decoded(content))))
                held += found
                size += len(content or b"")
                if len(held) >= BATCH_CHUNKS or size >= BATCH_BYTES:
                    if held:
                        yield _batch(held, names)
                    held, size = [], 0
            if held:
                yield _batch(held, names)

    return files.select("file_path", "ext", "content").mapInArrow(run, f"ordinal int, {SCHEMA}")


def _batch(found: list[tuple[int, Chunk]], names: list[str]) -> pa.RecordBatch:
    types = {"start_line": pa.int32(), "end_line": pa.int32(), "truncated": pa.bool_()}
    cols = [pa.array([c[i] for _, c in found], types.get(n, pa.string())) for i, n in enumerate(names)]
    return pa.RecordBatch.from_arrays([pa.array([n for n, _ in found], pa.int32()), *cols], names=["ordinal", *names])


def fallback_windows(files: DataFrame, settings: Settings | None = None) -> DataFrame:
    """Line-window chunks of texts (file_path, text) as Column expressions, without Python workers."""
    s = settings or Settings()
    rows = files.select("file_path", F.explode(tx.line_windows(F.col("text"), s.window_lines, s.overlap_lines)).alias("w")).where(~tx.is_blank(F.col("w.text")))
    name = F.concat(tx.basename(F.col("file_path")), F.lit(":window"), F.col("w.number").cast("string"))
    return rows.select(
        (F.col("w.number") - 1).alias("ordinal"), "file_path", "w.start_line", "w.end_line", name.alias("symbol_name"), name.alias("qualified_name"), F.lit("fallback_window").alias("kind"),
        F.col("w.text").alias("code_text"), F.concat(F.lit("# "), "file_path", F.lit("\n"), "w.text").alias("embed_text"), F.lit("text").alias("language"), F.lit(False).alias("truncated"),
    )
