"""Quality rules whose thresholds follow each language and source.

Every text is measured; the measures go into mergeable quantile sketches (DDSketch: counts on a
logarithmic grid with 1 % relative error; merging adds counts, so any order of merging gives the
same sketch). A language-and-source group of fewer than ``MIN_GROUP`` texts uses the merged
sketch of its language, a language of fewer the merged sketch of all. A text is kept if each
measure lies within the group's quartiles widened by ``FENCE`` quartile distances, and by
``SLACK`` of that measure at least.

Defined cases: a null text has no words; a text without words feeds no sketch and fails; null
lang and null source are groups like any other; repeated rows get equal verdicts; an empty table
gives an empty result. Values on a threshold are kept. Texts are whole, of any length. Extra columns
never matter.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import ROW, bound_batches, pack, pick, table, unpack, written
from ._hashing import word_hashes

GAMMA = 1.02
ZERO_BIN = -1_000_000
MIN_GROUP = 50
LONG_TEXT = 1 << 20
FENCE = 3.0
#: Measure, by number: numerator, denominator, least width beyond the quartiles.
MEASURES = (
    ("word_chars", "n_words", 2.0),
    ("n_symbols", "n_words", 0.1),
    ("n_dup_lines", "n_lines", 0.5),
    ("n_repeat_words", "n_words", 0.3),
    ("n_upper", "word_chars", 0.15),
)
#: Groups up to this number are broadcast; beyond it the join is a shuffled one.
BROADCAST_GROUPS = 50_000
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper")


def _repeated(words: np.ndarray) -> int:
    """Words in three-word windows that are found twice or more, of words as numbers."""
    if len(words) < 3:
        return 0
    ids = np.unique(words, return_inverse=True)[1]
    kinds = int(ids.max()) + 1
    pairs = np.unique(ids[:-1] * kinds + ids[1:], return_inverse=True)[1]
    _, back, often = np.unique(pairs[:-1] * kinds + ids[2:], return_inverse=True, return_counts=True)
    again, covered = often[back] > 1, np.zeros(len(words), bool)
    for k in range(3):
        covered[k : len(words) - 2 + k] |= again
    return int(covered.sum())


def measure_text(text: str | None) -> tuple[int, ...]:
    """The counts of one text, in the order of ``_COUNTS``. Words of texts over ``LONG_TEXT`` bytes
    are compared by 64-bit hashes, in arrays."""
    raw = (text or "").encode()
    if len(raw) > LONG_TEXT:
        hashes = word_hashes([raw])[0]
        words, n = [], len(hashes)
    else:
        words = raw.split()  # bytes: at space and \t \n \v \f \r only
        n = len(words)
    if not n:
        return (0, 0, len(raw) - len(raw.translate(None, b"#*$%&|<>")), 0, 0, 0, 0)
    blank = len(raw) - len(raw.translate(None, b" \t\n\v\f\r"))
    lines = [line for line in raw.split(b"\n") if line.strip()]
    windows = list(zip(words, words[1:], words[2:]))
    repeated = 0
    if len(set(windows)) < len(windows):
        first: dict[tuple, int] = {}
        covered = bytearray(n)
        for i, w in enumerate(windows):
            j = first.setdefault(w, i)
            if j < i:
                covered[j : j + 3] = covered[i : i + 3] = b"\1\1\1"
        repeated = covered.count(1)
    if not words:
        repeated = _repeated(hashes)
    return (
        n,
        len(text) - blank,
        len(raw) - len(raw.translate(None, b"#*$%&|<>")),
        len(lines) - len(set(lines)),
        repeated,
        len(lines),
        len(raw) - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")),
    )


def measure(df: DataFrame, column: str = "text") -> DataFrame:
    """The frame's columns except ``column``, with the counts of ``_COUNTS`` (long)."""
    keep = [f for f in df.schema.fields if f.name != column]

    def run(batches):
        for batch in batches:
            cols = [batch.column(batch.schema.get_field_index(f.name)) for f in keep]
            told = [measure_text(t.as_py()) for t in batch.column(batch.schema.get_field_index(column))]
            counts = [pa.array((t[i] for t in told), pa.int64()) for i in range(len(_COUNTS))]
            yield pa.RecordBatch.from_arrays([*cols, *counts], names=[*[f.name for f in keep], *_COUNTS])

    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in keep)
    return df.mapInArrow(run, kept + ", ".join(f"{c} long" for c in _COUNTS))


def _values() -> list[Column]:
    return [F.when(F.col(d) > 0, F.col(n) / F.col(d)) for n, d, _ in MEASURES]


def sketch(measured: DataFrame) -> DataFrame:
    """Counts by lang, source, measure and bin of the logarithmic grid."""
    entries = F.array(*[F.struct(F.lit(i).alias("measure"), v.alias("value")) for i, v in enumerate(_values())])
    rows = measured.where("n_words > 0").select("lang", "source", F.explode(entries).alias("e")).where("e.value is not null")
    at = F.when(F.col("e.value") == 0, ZERO_BIN).otherwise(F.ceil(F.ln("e.value") / math.log(GAMMA))).cast("long")
    return rows.groupBy("lang", "source", "e.measure", at.alias("bin")).agg(F.count("*").alias("n"))


def merge(bins: DataFrame, *keys: str) -> DataFrame:
    """The sketches of coarser groups: counts of equal bins added."""
    return bins.groupBy(*keys, "measure", "bin").agg(F.sum("n").alias("n"))


def quartiles(bins: DataFrame, *keys: str) -> DataFrame:
    """Number of values and the estimated quartiles of each group's sketches."""
    part = Window.partitionBy(*keys, "measure")
    up_to = F.sum("n").over(part.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))
    value = F.when(F.col("bin") == ZERO_BIN, 0.0).otherwise(2 * F.pow(F.lit(GAMMA), F.col("bin")) / (GAMMA + 1))
    told = bins.select(*keys, "measure", value.alias("value"), up_to.alias("up_to"), F.sum("n").over(part).alias("total"))
    found = [F.min(F.when(F.col("up_to") > q * (F.col("total") - 1), F.col("value"))).alias(name) for q, name in ((0.25, "q1"), (0.75, "q3"))]
    return told.groupBy(*keys, "measure").agg(F.first("total").alias("total"), *found)


def thresholds(bins: DataFrame) -> DataFrame:
    """lang, source, fences: an array by measure of the least and greatest value kept."""
    own = quartiles(bins, "lang", "source").alias("g")
    by_lang = quartiles(merge(bins, "lang"), "lang").alias("l")
    whole = quartiles(merge(bins)).alias("w")
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    joined = own.join(by_lang, same("g.lang", "l.lang") & (F.col("g.measure") == F.col("l.measure"))).join(whole, F.col("g.measure") == F.col("w.measure"))
    pick_of = lambda c: F.when(F.col("g.total") >= MIN_GROUP, F.col(f"g.{c}")).when(F.col("l.total") >= MIN_GROUP, F.col(f"l.{c}")).otherwise(F.col(f"w.{c}"))
    slack = F.element_at(F.array(*[F.lit(s) for _, _, s in MEASURES]), F.col("g.measure") + 1)
    q = joined.select("g.lang", "g.source", "g.measure", pick_of("q1").alias("q1"), pick_of("q3").alias("q3"), slack.alias("slack"))
    wide = F.greatest(FENCE * (F.col("q3") - F.col("q1")), F.col("slack"))
    fence = F.struct("measure", (F.col("q1") - wide).alias("least"), (F.col("q3") + wide).alias("most"))
    return q.groupBy("lang", "source").agg(F.map_from_entries(F.collect_list(F.struct("measure", fence))).alias("fences"))


def judge(measured: DataFrame, fences: DataFrame, groups: int) -> DataFrame:
    """Add base_failed and kept. A group's fences come by a join, broadcast only if few."""
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    right = fences.select(F.col("lang").alias("__lang"), F.col("source").alias("__source"), "fences")
    right = F.broadcast(right) if groups <= BROADCAST_GROUPS else right
    on = F.col("lang").eqNullSafe(F.col("__lang")) & F.col("source").eqNullSafe(F.col("__source"))
    fine = F.lit(True)
    for i, v in enumerate(_values()):
        fence = F.col("fences")[i]
        fine = fine & (v.isNull() | fence.isNull() | v.between(fence["least"], fence["most"]))
    joined = measured.join(right, on, "left")
    return joined.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & fine).drop("__lang", "__source", "fences")


def fences_of(measured: DataFrame) -> tuple[DataFrame, int]:
    """Thresholds of a measured frame, written; and the number of groups."""
    bins = written(sketch(measured), "quality-sketch")
    fences = written(thresholds(bins), "quality-fences")
    return fences, fences.count()


def verdicts(docs: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed and kept of every document."""
    bound_batches(docs.sparkSession)
    measured = written(measure(pick(docs, "doc_id long", "text string", "lang string", "source string")), "quality-counts")
    out = judge(measured, *fences_of(measured))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_upper")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the rows of the documents that are kept, unchanged. The texts are
    measured twice, once for the sketches and once beside their rows, so none is shuffled."""
    bound_batches(spark)
    fences = fences_of(measure(pick(docs, "text string", "lang string", "source string")))
    packed, names = pack(docs, "text string", "lang string", "source string")
    return unpack(judge(measure(packed.select(ROW, "text", "lang", "source")), *fences).where("kept"), names)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts(table(spark, sf_dir, "documents"))


_SQL = r"""
WITH w AS (
  SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), win AS (
  SELECT rid, i, words[i] || ' ' || words[i+1] || ' ' || words[i+2] AS g
  FROM (SELECT rid, words, unnest(range(1, len(words) - 1)) AS i FROM w WHERE len(words) >= 3)
), cov AS (
  SELECT rid, count(DISTINCT i + d) AS n_repeat_words
  FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM win), (VALUES (0), (1), (2)) t(d)
  WHERE c >= 2 GROUP BY rid
), m AS (
  SELECT w.rid, doc_id, lang, source, len(words) AS n_words,
         CASE WHEN len(words) = 0 THEN 0 ELSE length(array_to_string(words, '')) END AS word_chars,
         length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         len(lines) - len(list_distinct(lines)) AS n_dup_lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words, len(lines) AS n_lines,
         length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS n_upper
  FROM w LEFT JOIN cov ON w.rid = cov.rid
), v AS (
  SELECT rid, lang, source, unnest([
    {m: 0, x: word_chars / n_words, s: 2.0::DOUBLE}, {m: 1, x: n_symbols / n_words, s: 0.1::DOUBLE},
    {m: 2, x: n_dup_lines / n_lines, s: 0.5::DOUBLE}, {m: 3, x: n_repeat_words / n_words, s: 0.3::DOUBLE},
    {m: 4, x: n_upper / word_chars, s: 0.15::DOUBLE}], recursive := true)
  FROM m WHERE n_words > 0
), b AS (
  SELECT lang, source, m, s, CASE WHEN x = 0 THEN -1000000 ELSE ceil(ln(x) / ln(1.02))::BIGINT END AS bin, count(*) AS n
  FROM v GROUP BY ALL
), lv AS (
  SELECT 2 AS lv, lang, source, m, bin, n FROM b
  UNION ALL SELECT 1, lang, NULL, m, bin, sum(n) FROM b GROUP BY lang, m, bin
  UNION ALL SELECT 0, NULL, NULL, m, bin, sum(n) FROM b GROUP BY m, bin
), c AS (
  SELECT lv, lang, source, m, CASE WHEN bin = -1000000 THEN 0.0 ELSE 2 * pow(1.02::DOUBLE, bin) / 2.02 END AS x,
         sum(n) OVER (PARTITION BY lv, lang, source, m ORDER BY bin) AS up_to,
         sum(n) OVER (PARTITION BY lv, lang, source, m) AS total
  FROM lv
), q AS (
  SELECT lv, lang, source, m, any_value(total) AS total,
         min(CASE WHEN up_to > 0.25 * (total - 1) THEN x END) AS q1, min(CASE WHEN up_to > 0.75 * (total - 1) THEN x END) AS q3
  FROM c GROUP BY lv, lang, source, m
), f AS (
  SELECT g.lang, g.source, g.m,
         CASE WHEN g.total >= 50 THEN g.q1 WHEN l.total >= 50 THEN l.q1 ELSE a.q1 END AS q1,
         CASE WHEN g.total >= 50 THEN g.q3 WHEN l.total >= 50 THEN l.q3 ELSE a.q3 END AS q3
  FROM q g JOIN q l ON l.lv = 1 AND l.m = g.m AND l.lang IS NOT DISTINCT FROM g.lang
  JOIN q a ON a.lv = 0 AND a.m = g.m WHERE g.lv = 2
), bad AS (
  SELECT DISTINCT rid FROM v JOIN f ON f.lang IS NOT DISTINCT FROM v.lang AND f.source IS NOT DISTINCT FROM v.source AND f.m = v.m
  WHERE x < q1 - greatest(3.0 * (q3 - q1), s) OR x > q3 + greatest(3.0 * (q3 - q1), s)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND bad.rid IS NULL AS kept, n_lines, n_upper
FROM m LEFT JOIN bad ON m.rid = bad.rid
"""

QUERIES = {"op4_quality": op4_quality}
ORACLE = {"op4_quality": _SQL}
