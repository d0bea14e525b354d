"""Command line: index, query, eval, status."""

from __future__ import annotations

import argparse
import json
import sys
from dataclasses import replace

import seekstone
from seekstone.config import Settings
from seekstone.functions import embed as em
from seekstone.operators import evaluate as ev
from seekstone.operators.search import search, to_json, to_text
from seekstone.plans.evaluation import run_eval
from seekstone.plans.store import Index, IndexNotFoundError, index_tree


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="seekstone", description="Semantic search over source trees, on Spark.")
    top.add_argument("--version", action="version", version=seekstone.__version__)
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, about: str, *, path: bool = True) -> argparse.ArgumentParser:
        p = commands.add_parser(name, help=about)
        p.add_argument("--embedding-model", default=Settings().embedding_model)
        p.add_argument("--index-path")
        if path:
            p.add_argument("--path", default=".")
        return p

    p = command("index", "bring a tree's index up to date", path=False)
    p.add_argument("path")
    p.add_argument("--rebuild", action="store_true")
    p = command("query", "ask a question")
    p.add_argument("question")
    p.add_argument("--k", type=int, default=Settings().default_k)
    p.add_argument("--language")
    p.add_argument("--exact-filter", action="store_true", help="filter by language before ranking")
    p.add_argument("--json", action="store_true")
    p = command("eval", "measure retrieval on labelled queries", path=False)
    p.add_argument("--queries", required=True)
    p.add_argument("--manifest", required=True)
    p.add_argument("--repos-dir", default="eval_repos")
    p.add_argument("--repo")
    p.add_argument("--k", default="1,3,5,10")
    p.add_argument("--baseline", choices=["naive"])
    p.add_argument("--output")
    command("status", "describe an index")
    return top


def main(argv: list[str] | None = None, spark=None) -> int:
    args = _parser().parse_args(argv)
    settings = replace(Settings(), embedding_model=args.embedding_model)
    if spark is None:
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.appName("seekstone").getOrCreate()
    try:
        return {"index": _index, "query": _query, "eval": _eval, "status": _status}[args.command](args, settings, spark)
    except (IndexNotFoundError, FileNotFoundError, ValueError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1


def _index(args, settings: Settings, spark) -> int:
    import os

    if not os.path.isdir(args.path):
        raise FileNotFoundError(f"no directory {args.path}")
    stats = index_tree(spark, args.path, args.index_path, settings, args.rebuild)
    for name, value in vars(stats).items():
        print(f"{name.replace('_', ' ')}: {value}")
    return 0


def _warn(index: Index) -> None:
    if index.is_stale():
        print("warning: the index has chunks of an older chunker; run index again", file=sys.stderr)


def _query(args, settings: Settings, spark) -> int:
    index, embedder = Index.of(spark, args.path, args.index_path), em.build_embedder(settings)
    hits = search(index.open_for(embedder), em.encode_one(embedder, args.question), args.k, args.language, args.exact_filter)
    if not args.json:
        _warn(index)
    print(to_json(hits) if args.json else to_text(hits))
    return 0


def _eval(args, settings: Settings, spark) -> int:
    ks = [int(k) for k in args.k.split(",")]
    summary = run_eval(spark, args.repos_dir, ev.load_queries(spark, args.queries), ev.load_repo_roots(args.manifest), ks, args.repo, args.baseline, settings)
    print(ev.markdown_table(summary, ks))
    if args.output:
        with open(args.output, "w", encoding="utf-8") as f:
            json.dump(ev.summary_dict(summary, ks), f, indent=2)
    return 0


def _status(args, settings: Settings, spark) -> int:
    index = Index.of(spark, args.path, args.index_path)
    for name, value in index.status().items():
        print(f"{name.replace('_', ' ')}: {value}")
    _warn(index)
    return 0


if __name__ == "__main__":
    sys.exit(main())
