"""A Spark data source over directory trees of source files.

``spark.read.format("source_tree").option("root", ...)``: file_path, ext, content. The driver
enumerates paths, pruning excluded directories and applying suffix and ignore rules before any
file is opened; tasks read the bytes, drop binary and unreadable files, and check nothing twice.
Unlike Spark's binary file source it sees empty files and names that begin with '.' or '_'.
The root must be mounted on the workers.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from pathlib import PurePosixPath

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from seekstone.config import Settings
from seekstone.functions.text import SNIFF_BYTES
from seekstone.sources.ignore import IgnoreRules

SCHEMA = "file_path string, ext string, content binary"
#: Files, and bytes, that one partition has, about.
FILES_A_PARTITION, BYTES_A_PARTITION = 500, 32 << 20


def load_ignore(root: str) -> IgnoreRules | None:
    """The rules of the root's own .gitignore; nested ones aren't consulted."""
    path = os.path.join(root, ".gitignore")
    if not os.path.exists(path):
        return None
    with open(path, encoding="utf-8", errors="replace") as f:
        return IgnoreRules(f.read())


def looks_binary(content: bytes) -> bool:
    return b"\0" in content[:SNIFF_BYTES]


def list_files(root: str, settings: Settings | None = None, also_skip: tuple[str, ...] = ()) -> Iterator[tuple[str, int]]:
    """Relative paths with '/' and sizes, in order, of the files that rules let through."""
    settings = settings or Settings()
    root = os.path.realpath(root)
    rules = load_ignore(root)
    skipped = {os.path.realpath(p) for p in also_skip}
    for folder, folders, files in os.walk(root):
        folders[:] = sorted(d for d in folders if d not in settings.excluded_dirs and os.path.join(folder, d) not in skipped)
        for name in sorted(files):
            path = os.path.relpath(os.path.join(folder, name), root).replace(os.sep, "/")
            if PurePosixPath(name).suffix in settings.excluded_extensions or (rules is not None and rules.ignores(path)):
                continue
            try:
                yield path, os.path.getsize(os.path.join(folder, name))
            except OSError:
                continue


class _Part(InputPartition):
    def __init__(self, root: str, paths: list[str]):
        self.root, self.paths = root, paths


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = os.path.realpath(options["root"])
        own = json.loads(options.get("settings", "{}"))
        self.settings = Settings(**{k: tuple(v) if isinstance(v, list) else v for k, v in own.items()})
        self.skip = tuple(json.loads(options.get("skip", "[]")))
        if not os.path.isdir(self.root):
            raise FileNotFoundError(self.root)

    def partitions(self) -> list[_Part]:
        parts, held, size = [], [], 0
        for path, n in list_files(self.root, self.settings, self.skip):
            held.append(path)
            size += n
            if len(held) == FILES_A_PARTITION or size >= BYTES_A_PARTITION:
                parts.append(_Part(self.root, held))
                held, size = [], 0
        return [*parts, _Part(self.root, held)] if held or not parts else parts

    def read(self, partition: _Part):
        rows: list[tuple] = []
        size = 0
        for path in partition.paths:
            try:
                with open(os.path.join(partition.root, path), "rb") as f:
                    content = f.read()
            except OSError:
                continue
            if looks_binary(content):
                continue
            rows.append((path, PurePosixPath(path).suffix, content))
            size += len(content)
            if size > 8 << 20:
                yield _batch(rows)
                rows, size = [], 0
        yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.string(), pa.string(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=["file_path", "ext", "content"])


class SourceTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:
        return _Reader(self.options)


def read_tree(spark: SparkSession, root: str, settings: Settings | None = None, skip: tuple[str, ...] = ()) -> DataFrame:
    """file_path, ext, content of a tree's indexable files."""
    settings = settings or Settings()
    spark.dataSource.register(SourceTree)
    own = {"excluded_dirs": settings.excluded_dirs, "excluded_extensions": settings.excluded_extensions}
    return spark.read.format("source_tree").option("root", root).option("settings", json.dumps(own)).option("skip", json.dumps(list(skip))).load()


def decoded(content: bytes) -> str:
    """Bytes as text: malformed UTF-8 replaced, every line end a line feed."""
    return content.decode("utf-8", "replace").replace("\r\n", "\n").replace("\r", "\n")
