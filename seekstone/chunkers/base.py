"""Chunks, and what all chunkers share."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from pathlib import PurePosixPath
from typing import NamedTuple, Protocol

from seekstone.config import Settings
from seekstone.functions.text import py_line_windows

SCHEMA = "file_path string, start_line int, end_line int, symbol_name string, qualified_name string, kind string, code_text string, embed_text string, language string, truncated boolean"


class Chunk(NamedTuple):
    file_path: str
    start_line: int
    end_line: int
    symbol_name: str
    qualified_name: str
    kind: str
    code_text: str
    embed_text: str
    language: str
    truncated: bool = False


class Chunker(Protocol):
    """Turns one file into chunks; anything with this method can be passed to indexing."""

    def chunk_file(self, file_path: str, source: str) -> list[Chunk]: ...


class Span(NamedTuple):
    """A piece of source: its text and its lines, from 1, both included."""

    text: str
    start: int
    end: int


def tokens(text: str) -> int:
    return len(text.split())


@dataclass
class FileContext:
    """What every chunk of a file has in common."""

    path: str
    language: str
    mark: str
    settings: Settings
    imports: tuple[str, ...] = ()

    def header(self, enclosing: str | None = None) -> str:
        out = [f"{self.mark} file: {self.path}"]
        if enclosing:
            out.append(f"{self.mark} class: {enclosing}")
        if self.imports:
            out += [f"{self.mark} imports:", *(f"{self.mark}   {i}" for i in self.imports)]
        return "\n".join(out) + "\n"

    def chunk(self, span: Span, symbol: str, qualified: str, kind: str, header: str, truncated: bool = False) -> Chunk:
        return Chunk(self.path, span.start, span.end, symbol, qualified, kind, span.text, header + span.text, self.language, truncated)

    def windows(self, span: Span, symbol: str, qualified: str, kind: str, header: str) -> list[Chunk]:
        """Line windows of a span that is too long, marked as truncated."""
        found = py_line_windows(span.text, span.start, self.settings.window_lines, self.settings.overlap_lines)
        return [self.chunk(Span(t, a, b), symbol, qualified, kind, header, True) for a, b, t in found]

    def sized(self, span: Span, symbol: str, qualified: str, kind: str, header: str, parts: Callable[[], list[Span]], least_parts: int) -> list[Chunk]:
        """One chunk, or for an oversize span its nested parts if there are enough, else windows."""
        if tokens(span.text) <= self.settings.max_chunk_tokens:
            return [self.chunk(span, symbol, qualified, kind, header)]
        nested = parts()
        if len(nested) >= least_parts:
            return [self.chunk(p, symbol, qualified, kind, header) for p in nested]
        return self.windows(span, symbol, qualified, kind, header)

    def module_blocks(self, spans: Iterable[Span]) -> list[Chunk]:
        """Loose statements packed into blocks of a token budget, each beginning with the tail of
        the one before. With dedupe_module_tail, a last block of nothing but that tail is left out."""
        s = self.settings
        out: list[Chunk] = []
        held: list[Span] = []
        fresh = size = 0

        def flush() -> None:
            name = f"{PurePosixPath(self.path).name}:module:{held[0].start}-{held[-1].end}"
            block = Span("\n".join(x.text for x in held), held[0].start, held[-1].end)
            out.append(self.chunk(block, name, name, "module_block", f"{self.mark} file: {self.path}\n"))

        for span in spans:
            held.append(span)
            size += tokens(span.text)
            fresh += 1
            if size < s.module_window_tokens:
                continue
            flush()
            size = fresh = 0
            keep = len(held)
            while keep and size < s.module_overlap_tokens:
                keep -= 1
                size += tokens(held[keep].text)
            held = held[keep:]
        if held and (fresh or not s.dedupe_module_tail):
            flush()
        return out


class FallbackChunker:
    """Overlapping line windows, for any text; blank windows are numbered but left out."""

    def __init__(self, settings: Settings | None = None):
        self.settings = settings or Settings()

    def chunk_file(self, file_path: str, source: str) -> list[Chunk]:
        name = PurePosixPath(file_path).name
        found = py_line_windows(source, 1, self.settings.window_lines, self.settings.overlap_lines)
        return [
            Chunk(file_path, a, b, f"{name}:window{n}", f"{name}:window{n}", "fallback_window", text, f"# {file_path}\n{text}", "text")
            for n, (a, b, text) in enumerate(found, 1)
            if text.strip()
        ]
