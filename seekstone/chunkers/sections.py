"""Blocks and Markdown sections as DataFrame operations: no Python worker, one shuffle of texts by file.

Lines are told apart in the row (fences by a fold over the few lines that can open or close one), then
exploded; running sums number sections and blocks, and one aggregate a level gathers them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seekstone.config import Settings
from seekstone.functions import html
from seekstone.functions import text as tx

_ATX = r"(?s)^ {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*\z"
_MARK = r"(?s)^ {0,3}(`{3,}|~{3,})(.*)\z"
_SPAN = "struct<first:int,last:int>"


def _stripped(text: Column) -> Column:
    return F.regexp_replace(text, f"^{tx.SPACE}+|{tx.SPACE}+$", "")


def fences(lines: Column) -> Column:
    """array of (first, last) line, from 0, of fenced code; a fence that isn't closed reaches to the end.

    Backticks or tildes, three at least, open one (backticks only without others behind them); as many of the same
    kind, alone on their line, close it.
    """

    def told(line: Column, at: Column) -> Column:
        return F.struct(at.alias("at"), F.regexp_extract(line, _MARK, 1).alias("mark"), F.regexp_extract(line, _MARK, 2).alias("rest"))

    marks = F.filter(F.transform(F.filter(F.transform(lines, lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda p: p["x"].rlike("^ {0,3}[`~]{3}")), lambda p: told(p["x"], p["i"])), lambda m: m["mark"] != "")
    begin = F.struct(F.lit("").alias("mark"), F.lit(0).alias("at"), F.array().cast(f"array<{_SPAN}>").alias("out"))

    def step(s: Column, m: Column) -> Column:
        kind = F.substring(m["mark"], 1, 1)
        opens = (s["mark"] == "") & ~((kind == "`") & F.contains(m["rest"], F.lit("`")))
        closes = (s["mark"] != "") & (kind == F.substring(s["mark"], 1, 1)) & (F.length(m["mark"]) >= F.length(s["mark"])) & tx.is_blank(m["rest"])
        opened = F.struct(m["mark"].alias("mark"), m["at"].alias("at"), s["out"].alias("out"))
        span = F.array(F.struct(s["at"].alias("first"), m["at"].alias("last")).cast(_SPAN))
        closed = F.struct(F.lit("").alias("mark"), F.lit(0).alias("at"), F.concat(s["out"], span).alias("out"))
        return F.when(opens, opened).when(closes, closed).otherwise(s)

    def finish(s: Column) -> Column:
        return F.when(s["mark"] == "", s["out"]).otherwise(F.concat(s["out"], F.array(F.struct(s["at"].alias("first"), (F.size(lines) - 1).alias("last")).cast(_SPAN))))

    return F.aggregate(marks, begin, step, finish)


def _numbered(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys, i, line, heading, fenced, opens and ends (a fence) of every line."""

    def told(lines: Column) -> Column:
        def flags(spans: Column) -> Column:
            def one(line: Column, i: Column) -> Column:
                fenced = F.exists(spans, lambda s: (s["first"] <= i) & (i <= s["last"]))
                return F.struct(
                    i.alias("i"), line.alias("line"), fenced.alias("fenced"), F.exists(spans, lambda s: s["first"] == i).alias("opens"),
                    F.exists(spans, lambda s: (s["last"] == i) & (s["first"] < i)).alias("ends"), (~fenced & line.rlike(_ATX)).alias("heading"),
                )

            return F.transform(lines, one)

        return F.get(F.transform(F.array(fences(lines)), flags), F.lit(0))

    lines = F.get(F.transform(F.array(F.col("__lines")), told), F.lit(0))
    return rows.select(*keys, F.inline(lines))


def _gathered(lines: DataFrame, keys: list[str]) -> DataFrame:
    """keys, section, block, first, last (lines from 0) and text of every block: content between blank lines,
    headings and the ends of fences."""
    order = Window.partitionBy(*keys).orderBy("i")
    rows = lines.withColumn("section", F.sum(F.col("heading").cast("int")).over(order)).withColumn("content", ~F.col("heading") & (F.col("fenced") | ~tx.is_blank(F.col("line"))))
    broken = ~F.coalesce(F.lag("content").over(order), F.lit(False)) | F.coalesce(F.lag("ends").over(order), F.lit(False))
    starts = F.col("content") & (F.col("opens") | (~F.col("fenced") & broken))
    rows = rows.withColumn("block", F.sum(starts.cast("int")).over(order)).where("content")
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "line"))), lambda x: x["line"]), "\n")
    return rows.groupBy(*keys, "section", "block").agg(F.min("i").alias("first"), F.max("i").alias("last"), text.alias("text"))


def blocks(rows: DataFrame, keys: list[str], column: str) -> DataFrame:
    """keys, ordinal, start_line, end_line, text and title (of a block that is one HTML heading) of texts' blocks,
    which blank lines part, whatever they hold."""
    dealt = rows.repartition(*keys)
    lines = dealt.select(*keys, F.posexplode(F.split(F.coalesce(column, F.lit("")), "\n", -1)).alias("i", "line"))
    never = F.lit(False)
    found = _gathered(lines.select("*", *[never.alias(c) for c in ("fenced", "opens", "ends", "heading")]), keys)
    return found.select(*keys, (F.col("block") - 1).cast("int").alias("ordinal"), (F.col("first") + 1).cast("int").alias("start_line"), (F.col("last") + 1).cast("int").alias("end_line"), "text", html.block_title(F.col("text")).alias("title"))


def _ancestors(heads: DataFrame, keys: list[str]) -> DataFrame:
    """Add path: the titles of a heading's ancestors and its own. At every higher level that is the last heading that no
    heading of a still higher level followed."""
    before = Window.partitionBy(*keys).orderBy("section").rowsBetween(Window.unboundedPreceding, -1)
    parts = []
    for n in range(1, 6):
        own = F.max(F.when(F.col("level") == n, F.struct("section", "title"))).over(before)
        above = F.max(F.when(F.col("level") < n, F.col("section"))).over(before)
        parts.append(F.when((F.col("level") > n) & (own["section"] > F.coalesce(above, F.lit(-1))), F.array(own["title"])).otherwise(F.array().cast("array<string>")))
    return heads.withColumn("path", F.concat(*parts, F.array("title")))


def markdown_sections(files: DataFrame, settings: Settings | None = None) -> DataFrame:
    """The chunks of Markdown texts (file_path, text): a chunk a section without its subsections.

    Text before the first heading is ``intro``. Within a section a block that is one HTML heading begins a chunk
    of its own. Blank spans give none; spans of too many tokens line windows. A null text has no chunks.
    """
    s, keys = settings or Settings(), ["file_path"]
    texts = files.select("file_path", F.split(F.coalesce("text", F.lit("")), "\n", -1).alias("__lines")).repartition(*keys)
    lines = _numbered(texts, keys)
    order = Window.partitionBy(*keys).orderBy("i")
    marked = lines.where("heading").withColumn("section", F.row_number().over(order).cast("long"))
    heads = marked.select("file_path", "section", F.col("i").alias("at"), F.length(F.regexp_extract("line", _ATX, 1)).alias("level"), _stripped(F.regexp_extract("line", _ATX, 2)).alias("title"))
    heads = _ancestors(heads, keys).select("file_path", "section", "at", "title", "path")
    parted = _gathered(lines, keys).withColumn("html", html.block_title(F.col("text")))
    within = Window.partitionBy("file_path", "section").orderBy("block")
    parted = parted.withColumn("piece", F.count("html").over(within))
    pieces = parted.groupBy("file_path", "section", "piece").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.max("html").alias("html"))
    # a heading is a piece of its own, to which the blocks before the section's first HTML heading are added
    own = heads.select("file_path", "section", F.lit(0).cast("long").alias("piece"), F.col("at").alias("first"), F.col("at").alias("last"), F.lit(None).cast("string").alias("html"))
    pieces = pieces.unionByName(own).groupBy("file_path", "section", "piece").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.max("html").alias("html"))
    told = pieces.join(heads.drop("at"), ["file_path", "section"], "left").join(texts, "file_path")
    crumbs = F.concat(F.coalesce("path", F.array().cast("array<string>")), F.when(F.col("html").isNotNull(), F.array("html")).otherwise(F.array().cast("array<string>")))
    text = F.array_join(F.slice("__lines", F.col("first") + 1, F.col("last") - F.col("first") + 1), "\n")
    name = F.when(F.col("html").isNotNull(), F.col("html")).otherwise(F.col("title"))
    rows = told.select("file_path", "first", F.array_join(crumbs, " > ").alias("crumb"), F.when(name != "", name).otherwise("intro").alias("symbol_name"), text.alias("text")).where(~tx.is_blank(F.col("text")))

    def cut(text: Column) -> Column:
        whole = F.struct(F.lit(1).alias("number"), (F.col("first") + 1).cast("int").alias("start_line"), (F.col("first") + F.size(F.split(text, "\n", -1))).cast("int").alias("end_line"), text.alias("text"))
        big = tx.token_count(text) > s.max_chunk_tokens
        return F.struct(big.alias("big"), F.when(big, tx.line_windows(text, s.window_lines, s.overlap_lines, F.col("first") + 1)).otherwise(F.array(whole)).alias("spans"))

    rows = rows.withColumn("__c", F.get(F.transform(F.array("text"), cut), F.lit(0)))
    rows = rows.select("file_path", "crumb", "symbol_name", F.col("__c.big").alias("truncated"), F.explode("__c.spans").alias("w"))
    header = F.concat(F.lit("# file: "), "file_path", F.lit("\n"), F.when(F.col("crumb") != "", F.concat(F.lit("# section: "), "crumb", F.lit("\n"))).otherwise(""))
    ordinal = F.row_number().over(Window.partitionBy("file_path").orderBy("w.start_line", "w.number")) - 1
    return rows.select(
        ordinal.alias("ordinal"), "file_path", "w.start_line", "w.end_line", "symbol_name", F.when(F.col("crumb") != "", F.col("crumb")).otherwise(tx.basename(F.col("file_path"))).alias("qualified_name"),
        F.lit("doc_section").alias("kind"), F.col("w.text").alias("code_text"), F.concat(header, "w.text").alias("embed_text"), F.lit("markdown").alias("language"), "truncated",
    )
