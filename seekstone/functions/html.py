"""Headings in HTML by a scan of tags, as Column expressions: texts are split at '<', and only the pieces that
are heading tags are followed. A '<' inside a tag ends it, so an attribute value with one isn't a heading."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from seekstone.functions import text as tx

OPEN, CLOSE = 1, 2
_PIECE = "struct<at:int,level:int,kind:int>"
_SPAN = "struct<level:int,first:int,last:int>"


def _level(name: Column) -> Column:
    """1 to 6 of a tag name that begins with h and such a digit, else null."""
    digit = F.position(F.substring(name, 2, 1), F.lit("123456"))
    return F.when((F.lower(F.substring(name, 1, 1)) == "h") & (F.length(name) > 1) & (digit > 0), digit)


def _piece(part: Column, at: Column) -> Column:
    """A piece after '<': where it is, the heading's level, and whether it opens or closes it (0: neither)."""
    closing = F.startswith(part, F.lit("/"))
    name = F.when(closing, F.substring(part, 2, 1 << 30)).otherwise(part)
    after, ends = F.substring(name, 3, 1 << 30), F.contains(part, F.lit(">"))
    opens = ~closing & ends & ~F.substring(after, 1, 1).rlike("[A-Za-z0-9_]")
    closes = closing & ends & ~F.substring_index(after, ">", 1).rlike(tx.NOT_SPACE)
    kind = F.when(_level(name).isNull() | (at == 0), 0).when(opens, OPEN).when(closes, CLOSE).otherwise(0)
    return F.struct(at.alias("at"), _level(name).alias("level"), kind.alias("kind")).cast(_PIECE)


def strip_tags(text: Column) -> Column:
    """The text without tags: from the first '<' before each '>' on, if something lies between."""
    pieces = F.split(text, ">", -1)

    def cut(piece: Column, at: Column) -> Column:
        begin = F.locate("<", piece)
        whole = F.when((begin > 0) & (begin < F.length(piece)), F.substring(piece, F.lit(1), begin - 1)).otherwise(F.concat(piece, F.lit(">")))
        return F.struct(at.alias("at"), whole.alias("whole"), piece.alias("piece"))

    parts = F.transform(pieces, cut)
    last = F.element_at(pieces, -1)
    return F.concat(F.array_join(F.transform(F.slice(parts, F.lit(1), F.size(pieces) - 1), lambda p: p["whole"]), ""), last)


def headings(html: Column) -> Column:
    """array of (level, title) of a page's headings, in order. A heading reaches to the first closing tag of its
    level; one that is never closed is none."""

    def scan(parts: Column) -> Column:
        tags = F.filter(F.transform(parts, _piece), lambda p: p["kind"] > 0)

        def follow(tags: Column) -> Column:
            ends = F.transform(F.sequence(F.lit(1), F.lit(6)), lambda n: F.array_max(F.transform(F.filter(tags, lambda t: (t["kind"] == CLOSE) & (t["level"] == n)), lambda t: t["at"])))
            begin = F.struct(F.lit(0).alias("level"), F.lit(0).alias("first"), F.array().cast(f"array<{_SPAN}>").alias("out"))

            def step(s: Column, t: Column) -> Column:
                begins = (s["level"] == 0) & (t["kind"] == OPEN) & (F.get(ends, t["level"] - 1) > t["at"])
                closes = (s["level"] > 0) & (t["kind"] == CLOSE) & (t["level"] == s["level"])
                opened = F.struct(t["level"].alias("level"), t["at"].alias("first"), s["out"].alias("out"))
                span = F.struct(s["level"].alias("level"), s["first"].alias("first"), t["at"].alias("last"))
                closed = F.struct(F.lit(0).alias("level"), F.lit(0).alias("first"), F.concat(s["out"], F.array(span)).alias("out"))
                return F.when(begins, opened).when(closes, closed).otherwise(s)

            return F.aggregate(tags, begin, step, lambda s: s["out"])

        def told(span: Column) -> Column:
            within = F.array_join(F.slice(parts, span["first"] + 1, span["last"] - span["first"]), "<")
            content = F.substring(within, F.locate(">", within) + 1, F.lit(1 << 30))
            return F.struct(span["level"].alias("level"), F.trim(strip_tags(content)).alias("title"))

        return F.transform(F.get(F.transform(F.array(tags), follow), F.lit(0)), told)

    return F.get(F.transform(F.array(F.split(F.coalesce(html, F.lit("")), "<", -1)), scan), F.lit(0))


def block_title(block: Column) -> Column:
    """The title of a block that is one HTML heading from its first character to its last (blanks around it aside), else null."""
    edge = F.regexp_replace(block, f"^{tx.SPACE}+|{tx.SPACE}+$", "")

    def whole(t: Column) -> Column:
        parts = F.split(t, "<", -1)
        first, last = _piece(F.get(parts, F.lit(1)), F.lit(1)), _piece(F.element_at(parts, -1), F.lit(1))
        is_one = F.startswith(t, F.lit("<")) & (F.size(parts) > 2) & (F.substring(t, -1, 1) == ">") & (first["kind"] == OPEN) & (last["kind"] == CLOSE) & (first["level"] == last["level"]) & (F.size(F.split(F.element_at(parts, -1), ">", -1)) == 2)
        within = F.array_join(F.slice(parts, F.lit(2), F.size(parts) - 2), "<")
        title = F.regexp_replace(strip_tags(F.substring(within, F.locate(">", within) + 1, F.lit(1 << 30))), f"^{tx.SPACE}+|{tx.SPACE}+$", "")
        return F.when(is_one & (title != ""), title)

    return F.get(F.transform(F.array(edge), whole), F.lit(0))
