"""Ignore files in the gitignore syntax: rules compiled to regular expressions, the last match wins."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def _segment(part: str) -> str:
    """A pattern without slashes as a regular expression."""
    out, i = "", 0
    while i < len(part):
        ch = part[i]
        if ch == "*":
            out += "[^/]*"
        elif ch == "?":
            out += "[^/]"
        elif ch == "[":
            end = part.find("]", i + 2 if part[i + 1 : i + 2] in ("!", "^") else i + 1)
            end = part.find("]", end + 1) if end == i + 1 else end
            if end < 0:
                out += r"\["
            else:
                body = part[i + 1 : end]
                negated = body[:1] in ("!", "^")
                body = (body[1:] if negated else body).replace("\\", r"\\").replace("[", r"\[")
                out += f"[{'^/' if negated else ''}{body}]"
                i = end
        elif ch == "\\" and i + 1 < len(part):
            i += 1
            out += re.escape(part[i])
        else:
            out += re.escape(ch)
        i += 1
    return out


def compile_rule(line: str) -> tuple[bool, re.Pattern] | None:
    """(ignores, pattern over the path and what lies below it), or None for blanks and comments."""
    line = line.rstrip("\r\n")
    while line.endswith(" ") and not line.endswith("\\ "):
        line = line[:-1]
    if not line or line.startswith("#"):
        return None
    ignores = not line.startswith("!")
    line = line if ignores else line[1:]
    only_dir = line.endswith("/")
    line = line.rstrip("/") if only_dir else line
    anchored = "/" in line
    parts = [p for p in line.lstrip("/").split("/")]
    if not line.strip("/"):
        return None
    pattern = "" if anchored else "(?:.*/)?"
    for n, part in enumerate(parts):
        last = n == len(parts) - 1
        if part == "**":
            pattern += ".+" if last else "(?:[^/]+/)*"
        else:
            pattern += _segment(part) + ("" if last else "/")
    return ignores, re.compile(pattern + ("/.+" if only_dir else "(?:/.*)?") + r"\Z", re.S)


class IgnoreRules:
    """The rules of one ignore file."""

    def __init__(self, text: str = ""):
        self.rules = [r for r in map(compile_rule, text.splitlines()) if r]

    def column(self, path: Column) -> Column:
        """Whether a path is ignored, as a Column expression: one branch a rule, the last one first."""
        out = F.lit(False)
        for ignores, pattern in self.rules:  # a later rule's branch lies around the earlier ones'
            java = "(?s)^" + pattern.pattern.removesuffix(r"\Z").replace("&&", r"\&\&") + r"\z"
            out = F.when(path.rlike(java), F.lit(ignores)).otherwise(out)
        return out

    def ignores(self, path: str) -> bool:
        """Whether a path (relative, with '/') is ignored."""
        for ignores, pattern in reversed(self.rules):
            if pattern.match(path):
                return ignores
        return False
