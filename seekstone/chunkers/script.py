"""JavaScript and TypeScript files by a scanner of statements: functions, methods, classes, interfaces.

The scanner knows strings, template literals, comments, regular expressions, JSX and brackets;
statements are split where brackets are closed, with the language's rules for left-out
semicolons. A file whose brackets don't match gets line windows.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from typing import NamedTuple

from seekstone.chunkers.base import Chunk, FallbackChunker, FileContext, Span
from seekstone.config import Settings


class Token(NamedTuple):
    kind: str  # name, number, string, regex, jsx, comment, punct
    begin: int
    end: int
    text: str


class ScanError(ValueError):
    """Brackets, strings or comments that don't close."""


_NAME = re.compile(r"[#@]?[^\W\d][\w$]*|[#@]?\$[\w$]*")
_NUMBER = re.compile(r"(?:0[xXbBoO][\da-fA-F_]+|(?:\d[\d_]*)?\.?\d[\d_]*(?:[eE][+-]?\d+)?)n?")
_PUNCT = re.compile(r"=>|\.\.\.|\?\.(?!\d)|[*&|?]{2}=?|<<=?|>>>?=|[=!]==?|[-+*/%&|^<>]=|\+\+|--|.", re.S)
_BEFORE_REGEX = {"return", "typeof", "case", "in", "of", "delete", "void", "throw", "new", "else", "do", "instanceof", "yield", "await", "default"}
_OPEN, _CLOSE = "([{", ")]}"
#: Words whose brackets hold a condition, and what a brace that opens a block comes after.
_CONDITIONS = {"if", "while", "for", "with"}
_BEFORE_BLOCK = {";", "{", "}", ")", "=>", "else", "do", "try", "finally"}


def _string(s: str, i: int) -> int:
    q, j = s[i], i + 1
    while j < len(s) and s[j] != q:
        if s[j] == "\n":
            raise ScanError("a string runs over its line")
        j += 2 if s[j] == "\\" else 1
    if j >= len(s):
        raise ScanError("a string doesn't close")
    return j + 1


def _template(s: str, i: int, jsx: bool) -> int:
    j = i + 1
    while j < len(s):
        if s[j] == "`":
            return j + 1
        if s[j] == "\\":
            j += 2
        elif s.startswith("${", j):
            j = scan(s, j + 1, jsx, one=True)[1]
        else:
            j += 1
    raise ScanError("a template doesn't close")


def _regex(s: str, i: int) -> int | None:
    j, inside = i + 1, False
    while j < len(s) and s[j] != "\n":
        if s[j] == "\\":
            j += 1
        elif s[j] == "[":
            inside = True
        elif s[j] == "]":
            inside = False
        elif s[j] == "/" and not inside:
            return re.compile(r"[a-z]*").match(s, j + 1).end()
        j += 1
    return None


def _jsx(s: str, i: int) -> int:
    """The end of the element that begins at i."""
    depth, j = 0, i
    while j < len(s):
        if s[j] == "{":
            j = scan(s, j, True, one=True)[1]
        elif s[j] != "<":
            if not depth:
                raise ScanError("not an element")
            j += 1
        else:
            closing, k, generic = s.startswith("</", j), j + 1, 0
            while k < len(s) and (s[k] != ">" or generic):
                generic += (s[k] == "<") - (s[k] == ">")  # type arguments of a component
                if s[k] in "\"'":
                    at = s.find(s[k], k + 1)
                    if at < 0:
                        raise ScanError("an attribute doesn't close")
                    k = at + 1
                elif s[k] == "{":
                    k = scan(s, k, True, one=True)[1]
                else:
                    k += 1
            if k >= len(s):
                break
            depth += -1 if closing else 0 if s[k - 1] == "/" else 1
            j = k + 1
            if depth <= 0:
                return j
    raise ScanError("an element doesn't close")


def scan(s: str, i: int = 0, jsx: bool = True, one: bool = False) -> tuple[list[Token], int]:
    """The tokens from i to the end, or (one) to the bracket that closes the one at i."""
    out: list[Token] = []
    stack: list[tuple[str, bool]] = []  # what closes each open bracket, and whether a statement may follow it
    last: Token | None = None
    begins = True  # a statement or a value may begin, not go on
    while i < len(s):
        ch = s[i]
        if ch.isspace() or ch == "﻿":
            i += 1
            continue
        value_ended = not begins
        kind, end = "punct", i + 1
        if s.startswith("//", i) or (s.startswith("#!", i) and i == 0):
            kind, end = "comment", s.find("\n", i)
            end = len(s) if end < 0 else end
        elif s.startswith("/*", i):
            kind, end = "comment", s.find("*/", i + 2) + 2
            if end < 2:
                raise ScanError("a comment doesn't close")
        elif ch in "\"'":
            kind, end = "string", _string(s, i)
        elif ch == "`":
            kind, end = "string", _template(s, i, jsx)
        elif ch == "/" and not value_ended and _regex(s, i):
            kind, end = "regex", _regex(s, i)
        elif ch == "<" and jsx and not value_ended and (s[i + 1 : i + 2].isalpha() or s[i + 1 : i + 2] == ">"):
            kind, end = "jsx", _jsx(s, i)
        elif m := _NAME.match(s, i):
            kind, end = "name", m.end()
        elif (ch.isdigit() or (ch == "." and s[i + 1 : i + 2].isdigit())) and (m := _NUMBER.match(s, i)):
            kind, end = "number", m.end()
        else:
            end = _PUNCT.match(s, i).end()
        t = Token(kind, i, end, s[i:end])
        closed = False
        if kind == "punct" and ch in _OPEN:
            stack.append((_CLOSE[_OPEN.index(ch)], _opens_no_value(ch, last)))
        elif kind == "punct" and ch in _CLOSE:
            found, closed = stack.pop() if stack else ("", False)
            if found != ch:
                raise ScanError("brackets don't match")
        out.append(t)
        if kind != "comment":
            last = t
            begins = closed or (kind == "punct" and ch not in _CLOSE) or (kind == "name" and t.text in _BEFORE_REGEX)
        i = end
        if one and not stack:
            return out, i
    if stack:
        raise ScanError("a bracket doesn't close")
    return out, i


def _opens_no_value(bracket: str, last: Token | None) -> bool:
    """Whether the bracket after the token ``last`` opens a condition or a block, after which a
    slash begins a regular expression."""
    if bracket == "(":
        return last is not None and last.kind == "name" and last.text in _CONDITIONS
    if bracket == "{":
        return last is None or last.text in _BEFORE_BLOCK or (last.kind == "name" and last.text not in _BEFORE_REGEX)
    return False


def _body_at(code: list[Token]) -> int | None:
    """The index of the first brace outside of brackets."""
    depth = 0
    for k, t in enumerate(code):
        if t.kind == "punct":
            if t.text == "{" and depth == 0:
                return k
            depth += (t.text in _OPEN) - (t.text in _CLOSE)
    return None


def close_of(tokens: list[Token], i: int) -> int:
    """The index of the bracket that closes the one at i."""
    depth = 0
    for j in range(i, len(tokens)):
        t = tokens[j]
        if t.kind == "punct" and t.text in _OPEN:
            depth += 1
        elif t.kind == "punct" and t.text in _CLOSE:
            depth -= 1
            if not depth:
                return j
    raise ScanError("a bracket doesn't close")


_CONTINUES = {".", "?.", ",", "(", "[", "`", "=", "+", "-", "*", "/", "%", "&", "|", "^", "<", ">", "?", ":", "=>", "in", "instanceof", "of", "as", "satisfies", "extends", "implements", "else", "catch", "finally", "from"}
_EXPECTS = {"=", "=>", ".", "?.", ",", "+", "-", "*", "/", "%", "&", "|", "^", "<", "?", ":", "!", "~", "extends", "implements", "import", "export", "default", "const", "let", "var", "new", "return", "typeof", "async", "function", "class", "else", "as", "in", "of", "instanceof", "await", "throw", "from", "interface", "type", "enum", "declare", "abstract", "namespace", "module"}
_BLOCKY = {"function", "class", "interface", "enum", "namespace", "module", "if", "for", "while", "try", "switch", "do", "with", "{"}


class Node(NamedTuple):
    """A statement, member or comment: its tokens."""

    kind: str  # comment or code
    tokens: list[Token]

    @property
    def begin(self) -> int:
        return self.tokens[0].begin

    @property
    def end(self) -> int:
        return self.tokens[-1].end


def _head(tokens: list[Token]) -> int:
    """The index of the first token after export, default, declare, abstract and async."""
    i = 0
    while i < len(tokens) - 1 and tokens[i].text in ("export", "default", "declare", "abstract", "async"):
        i += 1
    return i


def statements(source: str, tokens: list[Token]) -> list[Node]:
    """The statements and comments among tokens of one bracket level, in order."""
    out: list[Node] = []
    i = 0
    while i < len(tokens):
        if tokens[i].kind == "comment":
            out.append(Node("comment", [tokens[i]]))
            i += 1
            continue
        begin, prev = i, None
        while i < len(tokens):
            t = tokens[i]
            if t.kind == "comment":
                i += 1
                continue
            if prev is not None and t.begin > prev.end and "\n" in source[prev.end : t.begin]:
                goes_on = t.text in _CONTINUES or t.text[:1] in "=&|?*" or (prev.text in _EXPECTS and prev.kind in ("punct", "name"))
                if t.text in ("/", "<") and t.kind == "punct":
                    goes_on = True
                if not goes_on and not prev.text.endswith(("&&", "||", "??")):
                    break
            if t.kind == "punct" and t.text in _OPEN:
                j = close_of(tokens, i)
                body_ends = t.text == "{" and _ends_with_body(tokens[begin : i + 1])
                i, prev = j + 1, tokens[j]
                if body_ends:
                    k = i
                    while k < len(tokens) and tokens[k].kind == "comment":
                        k += 1
                    more = k < len(tokens) and (tokens[k].text in ("else", "catch", "finally") or (tokens[k].text == "while" and tokens[begin].text == "do"))
                    if not more:
                        break
                continue
            i, prev = i + 1, t
            if t.text == ";" and t.kind == "punct" and not (tokens[begin].text == "if" and i < len(tokens) and tokens[i].text == "else"):
                break
        end = i
        while end > begin + 1 and tokens[end - 1].kind == "comment":
            end -= 1
        out.append(Node("code", tokens[begin:end]))
        i = end
    return out


def _ends_with_body(tokens: list[Token]) -> bool:
    """Whether the brace that is the last of these tokens opens a body that ends its statement."""
    code = [t for t in tokens if t.kind != "comment"]
    at = _head(code)
    head = code[at]
    if head.text not in _BLOCKY or (head.kind == "punct" and len(code) > 1):
        return False
    if head.text in ("interface", "enum", "namespace", "module") and code[at + 1].kind not in ("name", "string"):
        return False  # an ordinary name, as in an assignment to module.exports
    if head.text in ("function", "class", "interface", "enum", "namespace", "module"):
        depth = 0
        for t in code[:-1]:  # not a brace within parameters or a heritage clause
            depth += (t.text in _OPEN) - (t.text in _CLOSE) if t.kind == "punct" else 0
        before = code[-2]
        return depth == 0 and not (head.text == "function" and before.text in (":", "=", "|", "&"))
    return True


def _function_value(tokens: list[Token]) -> bool:
    """Whether the tokens of a value are one function expression or arrow function."""
    code = [t for t in tokens if t.kind != "comment"]
    if code and code[0].text == "async" and len(code) > 1:
        code = code[1:]
    if not code:
        return False
    if code[0].text == "function":
        at = _body_at(code)
        return len(code) > 1 and code[1].text != "*" and at is not None and close_of(code, at) == len(code) - 1
    depth = 0
    for i, t in enumerate(code):
        if t.kind == "punct":
            if t.text == "=>" and depth == 0:
                first = code[0]
                return (first.kind == "name" and i == 1) or first.text in ("(", "<")
            if depth == 0 and t.text in ("=", "?", ",") and code[0].text != "<":
                return False
            depth += (t.text in _OPEN) - (t.text in _CLOSE)
    return False


def _split(tokens: list[Token], mark: str) -> list[list[Token]]:
    """Tokens split at a mark outside of brackets."""
    out, depth = [[]], 0
    for t in tokens:
        if t.kind == "punct":
            if t.text == mark and depth == 0:
                out.append([])
                continue
            depth += (t.text in _OPEN) - (t.text in _CLOSE)
        out[-1].append(t)
    return out


class ScriptChunker:
    """Chunks of .js, .jsx and .mjs (javascript), .ts (typescript) and .tsx (tsx)."""

    def __init__(self, language: str = "javascript", settings: Settings | None = None):
        if language not in ("javascript", "typescript", "tsx"):
            raise ValueError(f"not a language of this chunker: {language}")
        self.language, self.settings = language, settings or Settings()

    def chunk_file(self, file_path: str, source: str) -> list[Chunk]:
        try:
            return _File(file_path, source, self.language, self.settings).chunks()
        except (ScanError, RecursionError):
            return FallbackChunker(self.settings).chunk_file(file_path, source)


class _File:
    def __init__(self, path: str, source: str, language: str, settings: Settings):
        self.source = source
        self.starts = [0, *(m.end() for m in re.finditer("\n", source))]
        self.nodes = statements(source, scan(source, 0, language != "typescript")[0])
        imports = [self.text(n).strip() for n in self.nodes if self._is_import(n)][: settings.header_imports]
        self.ctx = FileContext(path, language, "//", settings, tuple(imports))

    @staticmethod
    def _is_import(node: Node) -> bool:
        code = node.tokens
        return node.kind == "code" and code[0].text == "import" and not (len(code) > 1 and code[1].text in ("(", "."))

    def text(self, node: Node) -> str:
        return self.source[node.begin : node.end]

    def line(self, at: int) -> int:
        return bisect_right(self.starts, at)

    def span(self, begin: int, end: int, comment: str = "") -> Span:
        text = self.source[begin:end]
        return Span(f"{comment}\n{text}" if comment else text, self.line(begin), self.line(end - 1))

    def comment_above(self, nodes: list[Node], n: int) -> str:
        """The comment just before node n that ends on the line above it."""
        if n and nodes[n - 1].kind == "comment" and self.line(nodes[n - 1].end - 1) == self.line(nodes[n].begin) - 1:
            return self.text(nodes[n - 1])
        return ""

    def chunks(self) -> list[Chunk]:
        out: list[Chunk] = []
        loose: list[Span] = []
        for n, node in enumerate(self.nodes):
            if node.kind == "comment" or self._is_import(node):
                continue
            found = self.declared(node, self.comment_above(self.nodes, n))
            if found is None:
                loose.append(self.span(node.begin, node.end))
            else:
                out += found
        return out + self.ctx.module_blocks(loose)

    def declared(self, node: Node, comment: str) -> list[Chunk] | None:
        """The chunks of a statement that declares something, None for loose ones."""
        code = [t for t in node.tokens if t.kind != "comment"]
        exported = code[0].text == "export"
        i = 1 if exported else 0
        i += 1 if exported and i < len(code) and code[i].text == "default" else 0
        rest = code[i:]
        if not rest:
            return None
        at = 1 if rest[0].text == "async" and len(rest) > 1 and rest[1].text == "function" else 0
        word, after = rest[at].text, rest[at + 1 :]
        named = bool(after) and after[0].kind == "name" and after[0].text not in ("extends", "implements")
        if word == "function" and named:
            return self.function(rest, after[0].text, None, comment)
        if word == "class" and named:
            return self.class_(rest, after[0].text, comment)
        if word == "interface" and named and self.ctx.language != "javascript":
            return [self.interface(rest, after[0].text, comment)]
        if word in ("const", "let", "var") and (len(after) < 1 or after[0].text != "enum"):
            return self.declarators(rest, comment)
        return None if exported else self.assignment(rest, comment)

    def function(self, code: list[Token], name: str, owner: str | None, comment: str) -> list[Chunk]:
        begin, end = code[0].begin, code[-1].end
        qualified = f"{owner}.{name}" if owner else name

        def parts() -> list[Span]:
            brace = _body_at(code)
            if brace is None:
                return []
            inner = statements(self.source, [t for t in code[brace + 1 : close_of(code, brace)]])
            kinds = [n for n in inner if n.kind == "code" and (n.tokens[0].text in ("function", "class") or [t.text for t in n.tokens[:2]] == ["async", "function"])]
            return [self.span(n.begin, n.end) for n in kinds]

        return self.ctx.sized(self.span(begin, end, comment), name, qualified, "method" if owner else "function", self.ctx.header(owner), parts, least_parts=1)

    def class_(self, code: list[Token], name: str, comment: str) -> list[Chunk]:
        brace = _body_at(code)
        out: list[Chunk] = []
        listed: list[str] = []
        members = self.members(code[brace + 1 : close_of(code, brace)])
        for n, member in enumerate(members):
            if member.kind != "method":
                continue
            named, params = self.signature(member.tokens)
            listed.append(f"  //   {named}{params}")
            out += self.function(member.tokens, named, name, self.comment_above(members, n))
        heritage = ""
        if self.ctx.settings.class_heritage and brace > 2:
            heritage = " " + self.source[code[2].begin : code[brace - 1].end]
        summary = [f"class {name}{heritage} {{"]
        if listed:
            summary += ["  // methods:", *listed]
        text = "\n".join([*([comment] if comment else []), *summary, "}"])
        own = self.span(code[0].begin, code[-1].end)
        out.append(self.ctx.chunk(Span(text, own.start, own.end), name, name, "class", self.ctx.header()))
        return out

    def members(self, tokens: list[Token]) -> list[Node]:
        """A class body's methods, other members and comments. A method ends with its body; others
        end at ';' or where a line ends between complete parts."""
        # comments that stand alone are not in ``tokens`` of a declaration, so they are found anew
        lo, hi = (tokens[0].begin, tokens[-1].end) if tokens else (0, 0)
        tokens = scan(self.source[lo:hi], 0, self.ctx.language != "typescript")[0] if tokens else []
        tokens = [Token(t.kind, t.begin + lo, t.end + lo, t.text) for t in tokens]
        gap = self.comments_before(lo)
        out: list[Node] = [Node("comment", [t]) for t in gap]
        i = 0
        while i < len(tokens):
            if tokens[i].kind == "comment" or tokens[i].text == ";":
                if tokens[i].kind == "comment":
                    out.append(Node("comment", [tokens[i]]))
                i += 1
                continue
            begin, params, assigned, prev = i, False, False, None
            kind = "other"
            while i < len(tokens):
                t = tokens[i]
                if t.kind == "comment":
                    i += 1
                    continue
                if prev is not None and "\n" in self.source[prev.end : t.begin] and t.text not in ("(", "{", "=", ".", ":", "?", "=>") and prev.text not in ("=", "=>", ",", ":", "static", "async", "get", "set", "+", "&&", "||", "?", "public", "private", "protected", "readonly", "override", "|", "&", ".") and not prev.text.startswith("@") and not (prev.text == ")" and not assigned and tokens[begin].text.startswith("@")):
                    break
                if t.text == ";":
                    i += 1
                    break
                if t.kind == "punct" and t.text in _OPEN:
                    j = close_of(tokens, i)
                    if t.text == "{" and prev is not None and prev.text == "static" and i == begin + 1:
                        i = j + 1  # a static block
                        break
                    body = t.text == "{" and params and not assigned and prev.text not in (":", "|", "&")
                    params = params or (t.text == "(" and not (i > begin and tokens[i - 1].text.startswith("@")))
                    i, prev = j + 1, tokens[j]
                    if body:
                        kind = "method"
                        break
                    continue
                assigned = assigned or t.text == "="
                i, prev = i + 1, t
            code = [t for t in tokens[begin:i] if t.kind != "comment"]
            out.append(Node(kind, code))
        return out

    def comments_before(self, at: int) -> list[Token]:
        """The comments between the brace that opens a body and its first token."""
        brace = self.source.rfind("{", 0, at)
        while brace >= 0:
            try:
                found = scan(self.source[brace + 1 : at], 0, False)[0]
            except ScanError:
                found = [Token("punct", 0, 0, "")]
            if all(t.kind == "comment" for t in found):
                return [Token(t.kind, t.begin + brace + 1, t.end + brace + 1, t.text) for t in found]
            brace = self.source.rfind("{", 0, brace)
        return []

    def signature(self, code: list[Token]) -> tuple[str, str]:
        """A method's name and its parameters, brackets included."""
        i = 0
        while code[i].text.startswith("@"):
            i += 1
            while code[i].text == ".":
                i += 2
            if code[i].text == "(":
                i = close_of(code, i) + 1
        while code[i].text in ("static", "async", "get", "set", "public", "private", "protected", "readonly", "override", "abstract", "*") and code[i + 1].text not in ("(", "<", "="):
            i += 1
        name = self.source[code[i].begin : code[close_of(code, i)].end] if code[i].text == "[" else code[i].text
        p = next(k for k in range(i + (1 if code[i].text != "[" else close_of(code, i) - i + 1), len(code)) if code[k].text == "(")
        return name, self.source[code[p].begin : code[close_of(code, p)].end]

    def interface(self, code: list[Token], name: str, comment: str) -> Chunk:
        brace = _body_at(code)
        members: list[list[Token]] = [[]]
        depth, prev = 0, None
        for t in code[brace + 1 : close_of(code, brace)]:
            new_line = prev is not None and "\n" in self.source[prev.end : t.begin]
            if depth == 0 and (t.text in (";", ",") or (new_line and t.text not in ("|", "&", ":", "?") and prev.text not in ("|", "&", ":", "=>"))):
                members.append([])
                if t.text in (";", ","):
                    prev = t
                    continue
            depth += (t.text in _OPEN) - (t.text in _CLOSE) if t.kind == "punct" else 0
            members[-1].append(t)
            prev = t
        listed = [f"  {self.source[m[0].begin : m[-1].end].strip()}" for m in members if m]
        text = "\n".join([*([comment] if comment else []), f"interface {name} {{", *listed, "}"])
        own = self.span(code[0].begin, code[-1].end)
        return self.ctx.chunk(Span(text, own.start, own.end), name, name, "class", self.ctx.header())

    def declarators(self, code: list[Token], comment: str) -> list[Chunk] | None:
        """Functions among the declared values; None if there are none."""
        body = code[1:-1] if code[-1].text == ";" else code[1:]
        parts = _split(body, ",")
        out: list[Chunk] = []
        for part in parts:
            sides = _split(part, "=")
            if len(sides) < 2:
                continue
            value = part[len(sides[0]) + 1 :]
            if part and _function_value(value):
                name = part[0].text
                out += self.function(code if len(parts) == 1 else value, name, None, comment)
        return out or None

    def assignment(self, code: list[Token], comment: str) -> list[Chunk] | None:
        """A function assigned to a property, named by the property; None for anything else."""
        body = code[:-1] if code[-1].text == ";" else code
        sides = _split(body, "=")
        if len(sides) != 2 and not (len(sides) > 2 and _function_value(body[len(sides[0]) + 1 :])):
            return None
        left, value = sides[0], body[len(sides[0]) + 1 :]
        if len(left) < 3 or left[-1].kind != "name" or left[-2].text not in (".", "?.") or not _function_value(value):
            return None
        return self.function(code, left[-1].text, None, comment)
