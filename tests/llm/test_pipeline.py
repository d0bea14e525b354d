import ast
import os

import corpus_pipeline as pipeline
import pytest

from seekstone import llm
from seekstone.llm import line_dedup, minhash

from . import test_line_dedup, test_minhash, test_quality
from .common import awkward, empty, words

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    shared = "\n".join(words(500 + i, 12) for i in range(5))
    rows = [(i, words(i, 90 + i % 50), "en", f"s{i % 3}") for i in range(120)]
    rows += [(200 + i, words(i, 90 + i % 50) + " end", "en", f"s{i % 3}") for i in range(20)]
    rows += [(300 + i, f"{words(900 + i, 60)}\n{shared}\n{words(950 + i, 60)}", "de", "s1") for i in range(10)]
    rows += [(400, "too short", "en", "s1"), (401, "a b c " * 60, "en", "s1"), (402, None, None, None)]
    top = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").coalesce(2).write.parquet(f"{top}/documents.parquet")
    return top


def test_stages_by_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = {r["doc_id"]: r["text"] for r in docs.collect()}
    steps = dict(pipeline.STAGES)
    kept = {r["doc_id"]: r["text"] for r in steps["quality"](spark, docs, sf_dir).collect()}
    assert set(kept) == {i for i, t in rows.items() if test_quality.brute(t)[0] >= 50 and 2 * test_quality.brute(t)[4] <= test_quality.brute(t)[0]}
    cut = line_dedup.dedup(spark.createDataFrame([(i, t) for i, t in kept.items()], "doc_id long, text string"))
    cut = {r["doc_id"]: r["text"] for r in cut.collect()}
    assert cut == test_line_dedup.brute(list(kept.items())) and sum(map(len, cut.values())) < sum(map(len, kept.values()))
    near = minhash.stage(spark, spark.createDataFrame(list(cut.items()), "doc_id long, text string"), sf_dir)
    want = {i for i, (_, c) in test_minhash.brute(list(cut.items()), 5, 80).items() if c == i}
    assert {r["doc_id"] for r in near.collect()} == want and len(want) < len(cut)


def test_run(spark, sf_dir):
    out = pipeline.run(spark, sf_dir).collect()
    assert out and all(len(r["ids"]) == 4 * r["n_tokens"] for r in out)
    assert {r["doc_id"] for r in out} <= set(range(120)) | set(range(300, 310)) and [n for n, _ in pipeline.STAGES] == ["quality", "line_dedup", "near_dedup", "mixing", "bpe"]


@pytest.mark.parametrize("name,stage", pipeline.STAGES)
def test_awkward(spark, name, stage):
    for df in (awkward(spark), empty(spark)):
        out = stage(spark, df, "")
        assert out.columns[: len(df.columns)] == df.columns
        out.collect()


def test_queries_are_registered():
    names = llm.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 13)) and set(llm.oracle_sql()) <= set(names)


def test_nothing_else_imports_llm():
    for folder, _, files in os.walk(os.path.join(ROOT, "seekstone")):
        for f in files:
            if f.endswith(".py") and os.path.basename(folder) != "llm":
                with open(os.path.join(folder, f)) as h:
                    tree = ast.parse(h.read())
                for node in ast.walk(tree):
                    names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
                    assert not any("llm" in n for n in names), f
