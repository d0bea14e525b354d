"""Evaluation end to end: index the repositories, retrieve once at the largest k, match and measure."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seekstone.chunkers.registry import chunker_for, naive_chunker
from seekstone.config import INDEX_DIR, Settings
from seekstone.functions import embed as em
from seekstone.operators import evaluate as ev
from seekstone.operators.search import top_k
from seekstone.plans.store import Index, index_tree

BASELINES = {None: chunker_for, "naive": naive_chunker}


def run_eval(
    spark: SparkSession,
    repos_dir: str,
    queries: DataFrame,
    roots: dict[str, str],
    ks: list[int],
    repo: str | None = None,
    baseline: str | None = None,
    settings: Settings | None = None,
    embedder: em.Embedder | None = None,
) -> DataFrame:
    """The summary (repo, k, n_queries, precision, recall, mrr; repo null: overall).

    MRR is cut at the largest k, as retrieval is. Each repository has one index a configuration.
    """
    if baseline not in BASELINES:
        raise ValueError(f"unknown baseline {baseline!r}")
    if not ks or min(ks) < 1:
        raise ValueError("ks are positive")
    settings = settings or Settings()
    own = embedder or em.build_embedder(settings)
    if repo is not None:
        queries = queries.where(F.col("repo") == repo)
    chunks = None
    for name in sorted(r["repo"] for r in queries.select("repo").distinct().collect()):  # one row a repository
        root = os.path.join(repos_dir, name, roots.get(name, "."))
        if not os.path.isdir(root):
            raise FileNotFoundError(f"no repository at {root}")
        folder = os.path.join(repos_dir, name, INDEX_DIR, f"{em.fingerprint(own)}_{baseline or 'ast'}")
        index_tree(spark, root, folder, settings, embedder=embedder, factory=BASELINES[baseline])
        part = Index(spark, folder).open_for(own).withColumn("repo", F.lit(name))
        chunks = part if chunks is None else chunks.unionByName(part)
    if chunks is None:
        return spark.createDataFrame([(None, k, 0, 0.0, 0.0, 0.0) for k in ks], "repo string, k int, n_queries long, precision double, recall double, mrr double")
    numbered = queries.withColumn("query_id", F.xxhash64("id"))
    asked = em.embed(numbered.select("query_id", "repo", F.col("query").alias("text")), "text", settings, embedder)
    extra = ("repo", "file_path", "qualified_name", "start_line", "end_line")
    hits = top_k(chunks.withColumnRenamed("chunk_id", "id"), asked, max(ks), extra, same="repo").withColumnRenamed("id", "chunk_id")
    matched = ev.match_hits(hits, numbered.drop("id").withColumnRenamed("query_id", "id"))
    keys = numbered.select("query_id", F.explode("relevant").alias("r")).select("query_id", ev.span_key(F.col("r.file"), F.col("r.symbol")).alias("key"))
    return ev.summarize(ev.metrics(matched, keys, ks, numbered), numbered.select("query_id", "repo"))
