"""Line dedup by overlapping three-line windows, in DataFrame operations only.

Lines are split at \\n and compared without the blanks at their ends; windows run over the lines
that have a word, three at a time. Every window that occurs before - in a document of smaller
doc_id (null last, then by the text's hash), or earlier in the same one - marks the lines it
covers; the marked positions of a document are merged and those lines removed. Lines without a
word never count, and stay unless they lie between two removed lines of one window's span.

Windows are a 64-bit and a 32-bit hash of their lines. Only hashes are shuffled; repeated ones are
counted with partial aggregation, and the first occurrences of those that repeat ``HOT`` times or
more are broadcast to all others (of n windows, n / HOT at most are so frequent), so a passage in a
third of all documents meets in no single task.

Defined cases: a null text stays null; texts of fewer than three such lines stay as they are; a
document left without lines has an empty text; rows with equal doc_id and text count once as
an occurrence and get equal results; n_chars, where present, is the new text's length if the text
changed. An empty table gives an empty result. Extra columns stay as they are. Texts are whole, of any number
of lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import frequent, let, pack, table, unpack, written

WINDOW = 3
#: Windows that occur so often are not dealt by their hash, but for those that so many others outnumber.
HOT, MOST_HOT = 5_000, 50_000
_BLANKS = " \t\n\v\f\r"


def _lines() -> Column:
    """Of the column text: position, and hash, of each line that has a word."""
    bare = F.transform(F.split("text", "\n", -1), lambda line, i: F.struct(i.alias("at"), F.btrim(line, F.lit(_BLANKS)).alias("line")))
    full = F.filter(bare, lambda x: x["line"] != "")
    return F.transform(full, lambda x: F.struct(x["at"].alias("at"), F.xxhash64(x["line"]).alias("h"), F.crc32(x["line"]).alias("c")))


def _windows(lines: Column) -> Column:
    """begin, end, and the two hashes of every window of an array of lines."""

    def window(i: Column) -> Column:
        x = [F.get(lines, i + k) for k in range(WINDOW)]
        return F.struct(x[0]["at"].alias("begin"), x[-1]["at"].alias("end"), F.xxhash64(*[y["h"] for y in x]).alias("h"), F.hash(*[y["c"] for y in x]).alias("c"))

    found = F.transform(F.sequence(F.lit(0), F.greatest(F.size(lines) - WINDOW, F.lit(0))), window)
    return F.slice(found, F.lit(1), F.greatest(F.size(lines) - WINDOW + 1, F.lit(0)))  # none of fewer lines


def occurrences(packed: DataFrame) -> DataFrame:
    """doc_id, text_key, first and last covered line, and the two hashes of every window."""
    rows = packed.where("text is not null").select("doc_id", F.xxhash64("text").alias("text_key"), let(_lines(), _windows).alias("windows"))
    found = rows.select("doc_id", "text_key", F.explode("windows").alias("w"))
    return found.select("doc_id", "text_key", "w.begin", "w.end", "w.h", "w.c")


def removed(packed: DataFrame) -> DataFrame:
    """doc_id, text_key and gone: the positions of the lines to remove, merged."""
    seen = written(occurrences(packed), "line-windows")
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key", "begin")
    first = seen.groupBy("h", "c").agg(F.min(place).alias("first"), F.max(place).alias("last"), F.count("*").alias("n")).where("first != last")
    first = written(first.select(F.col("h").alias("__h"), F.col("c").alias("__c"), "first", "n"), "line-repeated")
    same = (F.col("h") == F.col("__h")) & (F.col("c") == F.col("__c"))
    few = F.broadcast(frequent(first, "n", "__h", "__c", most=MOST_HOT, least=HOT))
    keys = few.select("__h", "__c")
    rest = first.join(keys.toDF("__i", "__d"), (F.col("__h") == F.col("__i")) & (F.col("__c") == F.col("__d")), "left_anti")
    again = seen.join(few, same).unionByName(seen.join(keys, same, "left_anti").join(rest, same))
    again = again.where(place != F.col("first"))
    spans = again.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("begin", "end")).alias("spans"))
    gone = F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["begin"], s["end"]))))
    return spans.select("doc_id", "text_key", gone.alias("gone"))


def dedup(docs: DataFrame) -> DataFrame:
    """All columns of docs; text, and n_chars where present, without the repeated windows' lines."""
    packed, names = pack(docs, "doc_id long", "text string")
    gone = removed(packed.select("doc_id", "text")).select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"), "gone")
    keyed = packed.withColumn("__h", F.xxhash64("text"))
    joined = keyed.join(gone, (F.col("__h") == F.col("__key")) & F.col("doc_id").eqNullSafe(F.col("__id")), "left")

    def left(x: Column) -> Column:
        stay = F.array_except(F.sequence(F.lit(0), F.size(x["lines"]) - 1), x["gone"])
        return let(F.struct(x["lines"].alias("lines"), stay.alias("stay")), lambda y: F.array_join(F.transform(y["stay"], lambda i: F.get(y["lines"], i)), "\n"))

    text = F.when(F.col("gone").isNull(), F.col("text")).otherwise(let(F.struct(F.split("text", "\n", -1).alias("lines"), "gone"), left))
    out = joined.withColumn("__new", text)
    changed = {"text": F.col("__new")}
    if "n_chars" in names:
        old = F.col(f"__row.__c{names.index('n_chars')}")
        kind = out.schema["__row"].dataType[names.index("n_chars")].dataType
        changed["n_chars"] = F.when(F.col("gone").isNull(), old).otherwise(F.length("__new").cast(kind))
    return unpack(out, names, **changed)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines (left), n_chars (of the text left) and text_sha256 of every document."""
    out = dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.size(F.split("text", "\n", -1)).cast("long").alias("n_lines"), F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: :func:`dedup`."""
    return dedup(docs)


_SQL = r"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, text, unnest(range(0, len(lines))) AS ln, unnest(lines) AS raw FROM d),
b AS (SELECT doc_id, text, ln, trim(raw, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS line FROM l),
w AS (
  SELECT doc_id, text, ln AS b, lead(ln, 2) OVER o AS e,
         line || chr(10) || lead(line, 1) OVER o || chr(10) || lead(line, 2) OVER o AS g
  FROM b WHERE line <> '' WINDOW o AS (PARTITION BY doc_id ORDER BY ln)
),
r AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id, b) AS n FROM w WHERE g IS NOT NULL),
gone AS (SELECT DISTINCT doc_id, unnest(range(b, e + 1)) AS ln FROM r WHERE n > 1),
hit AS (SELECT DISTINCT doc_id FROM gone),
t AS (
  SELECT d.doc_id, CASE WHEN any_value(hit.doc_id) IS NULL THEN any_value(d.text)
         ELSE coalesce(string_agg(l.raw, chr(10) ORDER BY l.ln) FILTER (WHERE gone.ln IS NULL), '') END AS text
  FROM d LEFT JOIN l USING (doc_id) LEFT JOIN gone ON gone.doc_id = d.doc_id AND gone.ln = l.ln LEFT JOIN hit ON hit.doc_id = d.doc_id
  GROUP BY d.doc_id
)
SELECT doc_id, len(string_split(text, chr(10))) AS n_lines, length(text) AS n_chars, sha256(text) AS text_sha256 FROM t
"""

QUERIES = {"op3_line_dedup": op3_line_dedup}
ORACLE = {"op3_line_dedup": _SQL}
