"""Retrieval quality: matching hits with labelled spans, precision and recall at k, MRR, summaries."""

from __future__ import annotations

import math
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

QUERY_SCHEMA = "id string, repo string, query string, relevant array<struct<file:string,symbol:string,start_line:int,end_line:int>>"
IOU_LIMIT = 0.5
METRIC_COLUMNS = "query_id, k, precision, recall, mrr"


def load_queries(spark: SparkSession, path: str) -> DataFrame:
    """Labelled queries from JSON lines; blank lines are skipped, a missing list is an error."""
    rows = spark.read.schema(QUERY_SCHEMA + ", _bad string").option("columnNameOfCorruptRecord", "_bad").json(path)
    checked = F.when(F.col("relevant").isNull(), F.raise_error(F.concat(F.lit("no relevant spans in query "), F.coalesce("id", "_bad")))).otherwise(F.col("relevant"))
    return rows.withColumn("relevant", checked).drop("_bad")


def load_repo_roots(path: str) -> dict[str, str]:
    """Repository names and their roots ('.' by default) from a YAML manifest."""
    import yaml

    with open(path, encoding="utf-8") as f:
        entries = yaml.safe_load(f) or {}
    listed = entries.get("repos", entries) if isinstance(entries, dict) else entries
    if isinstance(listed, dict):
        listed = [{"name": n, **(v or {})} for n, v in listed.items()]
    return {e["name"]: e.get("root", ".") for e in listed}


def line_iou(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Overlap of two inclusive line ranges over their hull; 0 if disjoint."""
    both = F.greatest(F.least(a1, b1) - F.greatest(a0, b0) + 1, F.lit(0))
    return both / (F.greatest(a1, b1) - F.least(a0, b0) + 1)


def span_key(file: Column, symbol: Column) -> Column:
    return F.concat_ws("::", file, symbol)


def overlapping(a: DataFrame, b: DataFrame, on: list[str], least_iou: float) -> DataFrame:
    """The rows of ``a`` and ``b`` (columns ``on``, start_line, end_line, and others, in the structs a and b) with equal
    ``on`` whose line ranges overlap by ``least_iou`` of their hull at least, with iou.

    Ranges are dealt to bins as wide as the next power of two of their length, so each lies in two at most; as such
    an overlap bounds how much longer one range is, the shorter ones go to the bins of a few more widths. A
    pair meets in one bin only, that of its first common line, at the width of its longer range: the work is in proportion to the pairs
    near each other, not to all pairs of a file. Ranges without lines, or with a null, meet nothing.
    """
    if not 0 < least_iou <= 1:
        raise ValueError("the least overlap lies in (0, 1]")
    more = math.ceil(-math.log2(least_iou))

    def dealt(rows: DataFrame, side: str) -> DataFrame:
        cols = [F.col(f"{side}.{c}").alias(f"__on{i}_{side}") for i, c in enumerate(on)]
        rows = rows.where("end_line >= start_line").select(F.struct(*rows.columns).alias(side))
        first, last = F.col(f"{side}.start_line"), F.col(f"{side}.end_line")
        own = F.ceil(F.log2(last - first + 1)).cast("int")
        levels = rows.select(side, *cols, own.alias("__own"), F.explode(F.sequence(own, own + more)).alias("__level"))
        width = F.pow(F.lit(2), F.col("__level")).cast("long")
        bins = F.sequence(F.floor(first / width), F.floor(last / width))
        return levels.select(side, *[c for c in levels.columns if c.startswith("__on")], F.col("__level").alias(f"__level_{side}"), (F.col("__own") == F.col("__level")).alias(f"__widest_{side}"), width.alias(f"__width_{side}"), F.explode(bins).alias(f"__bin_{side}"))

    x, y = dealt(a, "a"), dealt(b, "b")
    keys = [f"__on{i}" for i in range(len(on))] + ["__level", "__bin"]
    start = F.greatest("a.start_line", "b.start_line")
    iou = line_iou(F.col("a.start_line"), F.col("a.end_line"), F.col("b.start_line"), F.col("b.end_line"))
    met = [F.col(f"{k}_a") == F.col(f"{k}_b") for k in keys] + [F.col("__widest_a") | F.col("__widest_b"), F.floor(start / F.col("__width_a")) == F.col("__bin_a"), iou >= least_iou]
    return x.join(y, reduce(and_, met)).select("a", "b", iou.alias("iou"))


def match_hits(hits: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, rank, matched: the key of the first labelled span that a hit meets, or a miss.

    hits: query_id, rank, chunk_id, file_path, qualified_name, start_line, end_line. A span is met in
    the same file by its symbol (an equi-join) or by an overlap of half the hull (a join by bins of lines); the first
    in list order wins by an aggregate.
    """
    spans = queries.select(F.col("id").alias("query_id"), F.posexplode("relevant").alias("pos", "r")).select("query_id", F.col("r.file").alias("file_path"), "pos", "r.symbol", "r.start_line", "r.end_line")
    key = span_key(F.col("b.file_path"), F.col("b.symbol"))
    told = ("query_id", "rank", "file_path")
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("query_id", "file_path")]
    named = hits.select(*told, "qualified_name").alias("a").join(spans.alias("b"), reduce(and_, [*same, F.col("a.qualified_name") == F.col("b.symbol")]))
    lined = overlapping(hits.select(*told, "start_line", "end_line"), spans, ["query_id", "file_path"], IOU_LIMIT)
    met = named.select("a.query_id", "a.rank", "b.pos", key.alias("key")).unionByName(lined.select("a.query_id", "a.rank", "b.pos", key.alias("key")))
    first = met.groupBy(F.col("query_id").alias("__q"), F.col("rank").alias("__r")).agg(F.min_by("key", "pos").alias("key"))
    own = hits.groupBy("query_id", "rank").agg(F.first("chunk_id").cast("string").alias("chunk_id"))
    matched = F.coalesce("key", F.concat(F.lit("__miss__"), "chunk_id"))
    return own.join(first, (F.col("query_id") == F.col("__q")) & (F.col("rank") == F.col("__r")), "left").select("query_id", "rank", matched.alias("matched"))


def metrics(matched: DataFrame, relevant: DataFrame, ks: list[int], asked: DataFrame | None = None) -> DataFrame:
    """query_id, k, precision, recall, mrr of every query at every k.

    matched: query_id, rank, matched, up to the largest k; relevant: query_id, key (distinct);
    asked: query_id of all queries (without it, those that have relevant keys). Precision divides
    by the hits there are, and counts repeated matches; recall counts distinct ones. Queries without
    hits or without relevant keys have zeros.
    """
    keys = relevant.select(F.col("query_id").alias("q"), "key").distinct()
    found = matched.join(keys, (F.col("query_id") == F.col("q")) & (F.col("matched") == F.col("key")), "left")
    sizes = keys.groupBy("q").agg(F.count("*").alias("n_relevant"))
    if asked is not None:
        sizes = asked.select(F.col("query_id").alias("q")).distinct().join(sizes, "q", "left")
    return _measured(found.select("query_id", "rank", "key"), sizes, ks)


def metrics_by_class(hits: DataFrame, asked: DataFrame, rows: DataFrame, ks: list[int]) -> DataFrame:
    """As :func:`metrics`, where all rows of a query's own class are relevant to it.

    hits: query_id, rank, matched, class (of the row found); asked: query_id, class; rows: key, class. The
    relevant rows are counted by class and a hit compared by its own, so pairs of queries and relevant rows, whose number
    grows with the square of the rows, are never made. Queries whose class is null or has no rows are left out.
    """
    sizes = rows.select("class", "key").distinct().groupBy("class").agg(F.count("*").alias("n_relevant"))
    own = asked.select(F.col("query_id").alias("q"), F.col("class").alias("wanted")).distinct()
    found = hits.join(own, F.col("query_id") == F.col("q")).select("query_id", "rank", F.when(F.col("class") == F.col("wanted"), F.col("matched")).alias("key"))
    return _measured(found, own.join(sizes, F.col("wanted") == F.col("class")).select("q", "n_relevant"), ks)


def _measured(found: DataFrame, sizes: DataFrame, ks: list[int]) -> DataFrame:
    """The metrics of hits (query_id, rank, key: null if it is a miss) and numbers of relevant keys (q, n_relevant)."""
    cuts = F.explode(F.array(*[F.lit(int(k)) for k in ks])).alias("k")
    within = F.col("rank") <= F.col("k")
    told = found.select("*", cuts).groupBy("query_id", "k").agg(
        F.count_if(within).alias("n"),
        F.count_if(within & F.col("key").isNotNull()).alias("hits"),
        F.count_distinct(F.when(within, F.col("key"))).alias("kinds"),
        F.min(F.when(F.col("key").isNotNull(), F.col("rank"))).alias("first"),
    )
    every = sizes.select("q", "n_relevant", cuts).withColumnRenamed("k", "kk")
    all_ = every.join(told, (F.col("q") == F.col("query_id")) & (F.col("kk") == F.col("k")), "left")
    return all_.select(
        F.col("q").alias("query_id"),
        F.col("kk").alias("k"),
        F.coalesce(F.try_divide("hits", "n"), F.lit(0.0)).alias("precision"),
        F.coalesce(F.col("kinds") / F.col("n_relevant"), F.lit(0.0)).alias("recall"),
        F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("mrr"),
    )


def summarize(told: DataFrame, groups: DataFrame) -> DataFrame:
    """repo (null: overall), k, n_queries and the macro averages; groups: query_id, repo."""
    rows = told.join(groups, "query_id")
    means = [F.coalesce(F.avg(c), F.lit(0.0)).alias(c) for c in ("precision", "recall", "mrr")]
    return rows.groupingSets([["k"], ["repo", "k"]], "repo", "k").agg(F.count("*").alias("n_queries"), *means)


def summary_dict(summary: DataFrame, ks: list[int]) -> dict:
    """The summary as nested dictionaries: overall, and by repo in order of names."""
    rows = summary.collect()  # one row a repository and k

    def part(repo: str | None) -> dict:
        own = {r["k"]: r for r in rows if r["repo"] == repo}
        first = next(iter(own.values()), None)
        return {
            "n_queries": first["n_queries"] if first else 0,
            "precision_at_k": {k: own[k]["precision"] if k in own else 0.0 for k in ks},
            "recall_at_k": {k: own[k]["recall"] if k in own else 0.0 for k in ks},
            "mrr": first["mrr"] if first else 0.0,
        }

    return {"overall": part(None), "per_repo": {r: part(r) for r in sorted({x["repo"] for x in rows if x["repo"] is not None})}}


def markdown_lines(summary: DataFrame, ks: list[int]) -> DataFrame:
    """ord, line: a Markdown table with P@k, R@k and MRR, overall first, then repositories by name."""
    cells = [F.max(F.when(F.col("k") == k, F.format_string("%.3f", c))) for c in ("precision", "recall") for k in ks]
    name = F.when(F.col("repo").isNull(), F.lit("**overall**")).otherwise(F.col("repo"))
    rows = summary.groupBy("repo").agg(F.concat_ws(" | ", F.first(name), F.first(F.col("n_queries")).cast("string"), *cells, F.format_string("%.3f", F.max("mrr"))).alias("body"))
    order = F.row_number().over(Window.orderBy(F.col("repo").asc_nulls_first())) + 1  # one row a repository
    table = rows.select(order.cast("int").alias("ord"), F.concat(F.lit("| "), "body", F.lit(" |")).alias("line"))
    heads = ["Scope", "n", *[f"P@{k}" for k in ks], *[f"R@{k}" for k in ks], "MRR"]
    top = [(0, "| " + " | ".join(heads) + " |"), (1, "|" + "---|" * len(heads))]
    return summary.sparkSession.createDataFrame(top, "ord int, line string").unionByName(table)


def markdown_table(summary: DataFrame, ks: list[int]) -> str:
    return "\n".join(r["line"] for r in markdown_lines(summary, ks).orderBy("ord").collect())  # one row a repository
