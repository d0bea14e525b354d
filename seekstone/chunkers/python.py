"""Python files by their syntax tree: functions, methods, class summaries, loose statements."""

from __future__ import annotations

import ast
import io
import tokenize

from seekstone.chunkers.base import Chunk, FallbackChunker, FileContext, Span
from seekstone.config import Settings

_FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)
_QUOTES = "\"' \t\n"


class _Source:
    """Slices of a file by tree positions, whose columns count UTF-8 bytes."""

    def __init__(self, text: str):
        self.lines = [line.encode() for line in text.split("\n")]

    def span(self, node: ast.AST) -> Span:
        a, b = node.lineno - 1, node.end_lineno - 1
        if a == b:
            raw = self.lines[a][node.col_offset : node.end_col_offset]
        else:
            raw = b"\n".join([self.lines[a][node.col_offset :], *self.lines[a + 1 : b], self.lines[b][: node.end_col_offset]])
        return Span(raw.decode("utf-8", "replace"), a + 1, b + 1)


def _brackets(text: str) -> str:
    """The first parenthesised part of a def or class head, '' if the head has none."""
    depth, begin = 0, None
    starts = [0]
    for line in text.split("\n"):
        starts.append(starts[-1] + len(line) + 1)
    try:
        for t in tokenize.generate_tokens(io.StringIO(text).readline):
            if t.type != tokenize.OP:
                continue
            if t.string in "([{":
                depth += 1
                if begin is None and t.string == "(" and depth == 1:
                    begin = starts[t.start[0] - 1] + t.start[1]
            elif t.string in ")]}":
                depth -= 1
                if begin is not None and depth == 0:
                    return text[begin : starts[t.end[0] - 1] + t.end[1]]
            elif t.string == ":" and depth == 0:
                return ""
    except (tokenize.TokenError, IndentationError):
        pass
    return ""


def _doc(body: list[ast.stmt], source: _Source) -> str:
    first = body[0] if body else None
    if isinstance(first, ast.Expr) and isinstance(first.value, ast.Constant) and isinstance(first.value.value, str):
        return source.span(first.value).text.strip(_QUOTES)
    return ""


class PythonChunker:
    language = "python"

    def __init__(self, settings: Settings | None = None):
        self.settings = settings or Settings()

    def chunk_file(self, file_path: str, source: str) -> list[Chunk]:
        """The chunks of one file; a file that doesn't parse gets line windows."""
        try:
            tree = ast.parse(source)
        except (SyntaxError, ValueError, RecursionError):
            return FallbackChunker(self.settings).chunk_file(file_path, source)
        src = _Source(source)
        future = lambda n: isinstance(n, ast.ImportFrom) and n.module == "__future__"
        is_import = lambda n: isinstance(n, (ast.Import, ast.ImportFrom)) and not future(n)
        imports = [src.span(n).text.strip() for n in tree.body if is_import(n)][: self.settings.header_imports]
        ctx = FileContext(file_path, self.language, "#", self.settings, tuple(imports))
        chunks: list[Chunk] = []
        loose: list[Span] = []
        for node in tree.body:
            if isinstance(node, _FUNCTIONS):
                chunks += self._function(ctx, src, node, None)
            elif isinstance(node, ast.ClassDef):
                chunks += self._class(ctx, src, node)
            elif not is_import(node):
                loose.append(src.span(node))
        return chunks + ctx.module_blocks(loose)

    def _function(self, ctx: FileContext, src: _Source, node: ast.FunctionDef | ast.AsyncFunctionDef, owner: str | None) -> list[Chunk]:
        qualified = f"{owner}.{node.name}" if owner else node.name
        kind, header, own = "method" if owner else "function", ctx.header(owner), src.span(node)

        def parts() -> list[Span]:
            return [src.span(c) for c in node.body if isinstance(c, (*_FUNCTIONS, ast.ClassDef)) and not c.decorator_list]

        chunks = ctx.sized(own, node.name, qualified, kind, header, parts, least_parts=2)
        if len(chunks) == 1 and not chunks[0].truncated and chunks[0].code_text == own.text and node.decorator_list:
            above = "".join(f"@{src.span(d).text}\n" for d in node.decorator_list)
            return [ctx.chunk(Span(above + own.text, own.start, own.end), node.name, qualified, kind, header)]
        return chunks

    def _class(self, ctx: FileContext, src: _Source, node: ast.ClassDef) -> list[Chunk]:
        chunks: list[Chunk] = []
        listed: list[str] = []
        for member in node.body:
            if not isinstance(member, _FUNCTIONS):
                continue
            doc = _doc(member.body, src)
            line = f"{member.name}{_brackets(src.span(member).text) or '()'}"
            listed.append(f"  - {line} - {doc.splitlines()[0]}" if doc else f"  - {line}")
            chunks += self._function(ctx, src, member, node.name)
        own, doc = src.span(node), _doc(node.body, src)
        summary = [f"class {node.name}{_brackets(own.text)}:"]
        if doc:
            summary.append(f'    """{doc}"""')
        if listed:
            summary += ["Methods:", *listed]
        chunks.append(ctx.chunk(Span("\n".join(summary), own.start, own.end), node.name, node.name, "class", ctx.header()))
        return chunks
