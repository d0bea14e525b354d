"""Text as Column expressions, with the plain-Python forms that workers use."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space, as Python splits at it (Java's \s, with or without (?U), is another set).
SPACE = r"[\s\x0b\x1c-\x1f\x85   -     　]"
_RARE = "".join(map(chr, [*range(0x1C, 0x20), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
NOT_SPACE = SPACE.replace("[", "[^", 1)
#: Line ends as Python's splitlines sees them.
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"


def decoded(content: Column) -> Column:
    """Bytes as text: malformed parts of UTF-8 replaced, each by one U+FFFD, every line end a line feed."""
    return F.regexp_replace(F.make_valid_utf8(content.cast("string")), r"\r\n?", "\n")


#: Bytes of a file that are looked at for a NUL, which texts don't have.
SNIFF_BYTES = 8192


def looks_binary(content: Column) -> Column:
    return F.contains(F.substring(content, 1, SNIFF_BYTES), F.lit(bytearray(1)))


def token_count(text: Column) -> Column:
    """Number of white-space separated tokens."""
    plain = F.translate(text, _RARE, " " * len(_RARE))  # then a class of ASCII characters will do
    return F.regexp_count(plain, F.lit(r"[^ \t\n\x0b\f\r]+"))


def lines(text: Column) -> Column:
    """The lines of a text; a last line end adds none."""

    def trimmed(parts: Column) -> Column:
        return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)

    return F.get(F.transform(F.array(F.split(text, LINE_END, -1)), trimmed), F.lit(0))


def line_windows(text: Column, window: int, overlap: int, base: int = 1) -> Column:
    """Overlapping windows: array of (number, start_line, end_line, text), the number from 1.

    The number of windows follows from the number of lines: 1 + ceil(max(n - window, 0) / step).
    """
    step = max(window - overlap, 1)

    def cut(ls: Column) -> Column:
        n = F.size(ls)
        count = F.when(n <= 0, 0).otherwise(1 + F.ceil(F.greatest(n - window, F.lit(0)) / step)).cast("int")

        def one(i: Column) -> Column:
            first = i * step
            return F.struct(
                (i + 1).cast("int").alias("number"),
                (first + base).cast("int").alias("start_line"),
                (F.least(first + window, n) + base - 1).cast("int").alias("end_line"),
                F.array_join(F.slice(ls, first + 1, F.lit(window)), "\n").alias("text"),
            )

        empty = F.array().cast("array<struct<number:int,start_line:int,end_line:int,text:string>>")
        return F.when(count == 0, empty).otherwise(F.transform(F.sequence(F.lit(0), count - 1), one))

    # the lines are bound to a lambda's variable, else each window would split the text again
    return F.get(F.transform(F.array(lines(text)), cut), F.lit(0))


def is_blank(text: Column) -> Column:
    return ~text.rlike(NOT_SPACE)


def suffix(path: Column) -> Column:
    """The last suffix of the file name, as pathlib has it: '' for .bashrc, '.ts' for a.d.ts."""
    return F.regexp_extract(path, r"[^/]+?(\.[^./]+)$", 1)


def basename(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def language_of(ext: Column, languages: dict[str, str]) -> Column:
    """The chunker language of a suffix (case-sensitive), else text."""
    out = F.lit("text")
    for e, name in languages.items():
        out = F.when(ext == e, name).otherwise(out)
    return out


def context_header(path: Column, mark: str, enclosing: Column, imports: Column) -> Column:
    """Comment lines before an embedded chunk: the file, the class if any, the imports if any."""
    listed = F.when(F.size(imports) > 0, F.concat(F.lit(f"{mark} imports:\n"), F.array_join(F.transform(imports, lambda i: F.concat(F.lit(f"{mark}   "), i)), "\n")))
    held = F.when(enclosing.isNotNull() & (enclosing != ""), F.concat(F.lit(f"{mark} class: "), enclosing))
    return F.concat(F.concat_ws("\n", F.concat(F.lit(f"{mark} file: "), path), held, listed), F.lit("\n"))


def py_line_windows(text: str, base: int, window: int, overlap: int) -> list[tuple[int, int, str]]:
    """line_windows for one text in a worker: (start_line, end_line, text)."""
    ls = text.splitlines()
    step = max(window - overlap, 1)
    count = 0 if not ls else 1 + math.ceil(max(len(ls) - window, 0) / step)
    return [(base + i * step, base + min(i * step + window, len(ls)) - 1, "\n".join(ls[i * step : i * step + window])) for i in range(count)]
