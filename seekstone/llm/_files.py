"""Arrays in files of the shared folder, written by tasks and mapped into memory by workers."""

from __future__ import annotations

import functools
import uuid

import numpy as np
import pyarrow.fs as pafs


def filesystem(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder if "://" in folder else "file://" + folder.removeprefix("file:"))


class ArrayWriter:
    """A new file of numbers of one type; every attempt of a task gets a name of its own."""

    def __init__(self, folder: str, kind: str):
        fs, top = filesystem(folder)
        fs.create_dir(top, recursive=True)
        self.name = f"{uuid.uuid4().hex}.{kind}"
        self._out = fs.open_output_stream(f"{top}/{self.name}")
        self.size = 0

    def write(self, values: np.ndarray) -> None:
        self._out.write(np.ascontiguousarray(values).tobytes())
        self.size += len(values)

    def close(self) -> None:
        self._out.close()


@functools.lru_cache(maxsize=4096)
def _mapped(path: str, dtype: str) -> np.ndarray:
    return np.memmap(path, dtype=dtype, mode="r")


def part(folder: str, name: str, dtype: str, begin: int, n: int) -> np.ndarray:
    """n numbers of a file from number ``begin``: a view of the memory-mapped file where the shared
    folder is mounted, else just these bytes, read from the store."""
    if not n:
        return np.zeros(0, dtype)
    fs, top = filesystem(folder)
    path = f"{top}/{name}"
    if isinstance(fs, pafs.LocalFileSystem):
        return _mapped(path, dtype)[begin : begin + n]
    size = np.dtype(dtype).itemsize
    with fs.open_input_file(path) as f:
        return np.frombuffer(f.read_at(n * size, begin * size), dtype)
