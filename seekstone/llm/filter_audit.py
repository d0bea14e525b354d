"""How five filters of documents interact: what each removes in every order of application.

A relational pipeline in Spark SQL functions. Equal texts are brought together first (by two 64-bit
hashes, combined before the shuffle), so each distinct text is exploded once: into words, aggregated
by (text, word), then by text for the total and the distinct words. Both aggregates keep the
partitioning by text, so words are never shuffled. The documents are joined with their texts'
flags and, by an outer join, with the labels; one aggregate a part then has 32 conditional counts
(one for each set of failed filters) of all documents, of good and of toxic ones. All 120 orders
follow from those counts.

Filters fail a text so: A fewer than 200 words; B 100 * distinct words < 50 * words; C 100 * [A-Z]
> 3 * code points; D any of ``#$%&*|``; E equal to the text of a smaller doc_id.

Defined cases: a null text is empty (fails A, and E after a smaller doc_id with an empty or null
text); a row without doc_id neither fails E nor makes others fail it, and has no labels; rows that
repeat a doc_id are documents of their own, equal texts under one doc_id don't fail E; a null lang is
the part '', as an empty one is; several labels of one doc_id count as set if any is; labels of absent
documents don't count; an empty table gives an empty result. Extra columns never matter.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import pick, table

FILTERS = "ABCDE"
SETS = 1 << len(FILTERS)
MIN_WORDS, MIN_DISTINCT, MAX_CAPITALS = 200, 50, 3
SYMBOLS = "[#$%&*|]"
SPACES = r"[\x20\x09-\x0D]+"
KEY = ("k1", "k2")


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text, part and the two hashes of the text."""
    rows = pick(docs, "doc_id long", "text string", "lang string")
    text = F.coalesce("text", F.lit(""))
    keys = [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text).alias("k2")]
    return rows.select("doc_id", text.alias("text"), F.coalesce("lang", F.lit("")).alias("part"), *keys)


def text_flags(docs: DataFrame) -> DataFrame:
    """k1, k2, n_words, n_distinct, the failures a, b, c, d and the least doc_id of every distinct text."""
    texts = _keyed(docs).groupBy(*KEY).agg(F.first("text").alias("text"), F.min("doc_id").alias("least"))
    capitals = F.length(F.regexp_replace("text", "[^A-Z]+", ""))
    own = texts.select(*KEY, "least", (100 * capitals > MAX_CAPITALS * F.length("text")).alias("c"), F.col("text").rlike(SYMBOLS).alias("d"), "text")
    # an empty text keeps its row: its one part is '', which counts as no word
    words = own.select(*KEY, "least", "c", "d", F.explode(F.split("text", SPACES)).alias("word"))
    kinds = words.groupBy(*KEY, "word").agg(F.count("*").alias("n"), F.first("least").alias("least"), F.first("c").alias("c"), F.first("d").alias("d"))
    real = F.when(F.col("word") != "", F.col("n")).otherwise(0)
    told = kinds.groupBy(*KEY).agg(F.sum(real).alias("n_words"), F.count_if(F.col("word") != "").alias("n_distinct"), *[F.first(c).alias(c) for c in ("least", "c", "d")])
    a = F.col("n_words") < MIN_WORDS
    b = 100 * F.col("n_distinct") < MIN_DISTINCT * F.col("n_words")
    return told.select(*KEY, "n_words", "n_distinct", a.alias("a"), b.alias("b"), "c", "d", "least")


def failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, part, mask (bit i: it fails filter i), good and toxic of every document."""
    flags = text_flags(docs)
    marks = pick(labels, "doc_id long", "quality int", "toxic int").groupBy(F.col("doc_id").alias("__id"))
    marks = marks.agg(F.bool_or(F.col("quality") == 1).alias("good"), F.bool_or(F.col("toxic") == 1).alias("toxic"))
    rows = _keyed(docs).select("doc_id", "part", *KEY).join(flags, list(KEY)).join(marks, F.col("doc_id") == F.col("__id"), "left_outer")
    failed = [F.col("a"), F.col("b"), F.col("c"), F.col("d"), F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False))]
    mask = sum((F.when(x, 1 << i).otherwise(0) for i, x in enumerate(failed)), F.lit(0))
    return rows.select("doc_id", "part", mask.alias("mask"), *[F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")])


def _steps() -> list[tuple[str, int, int, int]]:
    """Order, step from 1, the step's filter as a bit, and the filters before it as bits."""
    out = []
    for order in permutations(FILTERS):
        before = 0
        for k, f in enumerate(order, 1):
            bit = 1 << FILTERS.index(f)
            out.append(("".join(order), k, bit, before))
            before |= bit
    return out


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step and the counts of every step of all 120 orders."""
    is_ = [F.col("mask") == m for m in range(SETS)]
    counted = failures(docs, labels).groupBy("part").agg(
        *[F.count_if(x).alias(f"n{m}") for m, x in enumerate(is_)],
        *[F.count_if(x & F.col("good")).alias(f"g{m}") for m, x in enumerate(is_)],
        *[F.count_if(x & F.col("toxic")).alias(f"t{m}") for m, x in enumerate(is_)],
    )
    sets = F.array(*[F.struct(F.lit(m).alias("mask"), F.col(f"n{m}").alias("n"), F.col(f"g{m}").alias("good"), F.col(f"t{m}").alias("toxic")) for m in range(SETS)])
    rows = counted.select("part", F.inline(sets))
    steps = rows.sparkSession.createDataFrame(_steps(), "filter_order string, step int, bit int, before int")
    every = rows.crossJoin(F.broadcast(steps))  # 32 rows a part with 600 fixed steps
    fails = F.col("mask").bitwiseAND(F.col("bit")) != 0
    gone = F.col("mask").bitwiseAND(F.col("before")) != 0
    here = fails & ~gone
    total = lambda when, what: F.sum(F.when(when, what).otherwise(0))
    orders = len(list(permutations(FILTERS)))
    return every.groupBy("part", "filter_order", "step").agg(
        total(~fails & ~gone, F.col("n")).alias("kept"),
        total(here, F.col("n")).alias("removed"),
        total(fails & gone, F.col("n")).alias("redundant"),
        total(F.col("mask") == F.col("bit"), F.col("n")).alias("unique_fails"),
        total(here, F.col("good")).alias("good_lost"),
        total(here, F.col("toxic")).alias("toxic_lost"),
        # of the filters that fail a document, each is the first one in an equal share of the orders
        total(fails, (F.col("n") * orders / F.bit_count("mask")).cast("long")).alias("shapley"),
    )


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS part FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws, min(doc_id) OVER (PARTITION BY text) AS least FROM d),
f AS (
  SELECT doc_id, part, [len(ws) < 200, 100 * len(list_distinct(ws)) < 50 * len(ws),
         100 * len(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * len(text), regexp_matches(text, '[#$%&*|]'), coalesce(doc_id > least, false)] AS fails FROM w
), l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT f.*, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic FROM f LEFT JOIN l ON l.doc_id = f.doc_id),
p AS (SELECT '' AS o UNION ALL SELECT o || x FROM p, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x) WHERE len(o) < 5 AND NOT contains(o, x)),
s AS (SELECT o AS filter_order, unnest(range(1, 6))::INT AS step FROM p WHERE len(o) = 5),
g AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM m GROUP BY part, fails),
e AS (
  SELECT part, filter_order, step, n, good, toxic, fails[ord(filter_order[step]) - 64] AS own,
         len(list_filter(range(1, step), lambda i: fails[ord(filter_order[i]) - 64])) > 0 AS gone,
         len(list_filter(fails, lambda x: x)) AS n_fails, substr(filter_order, step, 1) AS f
  FROM g, s
), r AS (
  SELECT part, filter_order, step, any_value(f) AS f, coalesce(sum(n) FILTER (NOT own AND NOT gone), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (own AND NOT gone), 0)::BIGINT AS removed,
         coalesce(sum(n) FILTER (own AND gone), 0)::BIGINT AS redundant, coalesce(sum(n) FILTER (own AND n_fails = 1), 0)::BIGINT AS unique_fails,
         coalesce(sum(good) FILTER (own AND NOT gone), 0)::BIGINT AS good_lost, coalesce(sum(toxic) FILTER (own AND NOT gone), 0)::BIGINT AS toxic_lost
  FROM e GROUP BY part, filter_order, step
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       sum(removed) OVER (PARTITION BY part, f)::BIGINT AS shapley FROM r
"""

QUERIES = {"op12_filter_audit": op12_filter_audit}
ORACLE = {"op12_filter_audit": _SQL}
