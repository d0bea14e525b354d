import json
import os

import numpy as np
import pytest

from seekstone.cli import main
from seekstone.config import Settings
from seekstone.functions import embed as em
from seekstone.operators.search import search
from seekstone.plans.store import Index, IndexNotFoundError, index_tree


@pytest.fixture
def repo(tmp_path):
    (tmp_path / "pkg").mkdir()
    (tmp_path / "pkg/__init__.py").write_text("")
    (tmp_path / "pkg/cache.py").write_text('class Cache:\n    """Keeps values until they expire."""\n\n    def evict(self):\n        return 2\n')
    (tmp_path / "web.js").write_text("// routes\nexport function route(path) { return path; }\n")
    (tmp_path / "README.md").write_text("# Title\nhello\n")
    return tmp_path


def stats(s):
    return s.files_scanned, s.files_indexed, s.files_skipped, s.files_removed


def test_lifecycle(spark, repo):
    root = str(repo)
    assert stats(index_tree(spark, root)) == (4, 4, 0, 0)
    index = Index.of(spark, root)
    first = {r["chunk_id"] for r in index.chunks().collect()}
    assert stats(index_tree(spark, root)) == (4, 0, 4, 0) and {r["chunk_id"] for r in index.chunks().collect()} == first
    with open(repo / "web.js", "a") as f:
        f.write("export const more = () => 1;\n")
    os.remove(repo / "README.md")
    assert stats(index_tree(spark, root)) == (3, 1, 2, 1)
    assert {r["qualified_name"] for r in index.chunks().collect()} == {"Cache", "Cache.evict", "route", "more"} and index.files().count() == 3
    own = em.build_embedder()
    hits = search(index.open_for(own), em.encode_one(own, "evict from the cache"), 1).collect()
    assert hits[0]["file_path"] == "pkg/cache.py" and hits[0]["rank"] == 1
    # a run that breaks off leaves the old state
    with pytest.raises(Exception):
        index_tree(spark, root, rebuild=True, factory=lambda ext, settings: 1 / 0)
    assert index.chunks().count() == 4
    # another model is refused, other chunk settings rebuild
    with pytest.raises(ValueError, match="--rebuild"):
        index_tree(spark, root, settings=Settings(embedding_model="hashing-64"))
    with pytest.raises(IndexNotFoundError):
        index.open_for(em.HashingEmbedder(64))
    assert index_tree(spark, root, settings=Settings(window_lines=30)).chunker_upgraded
    assert stats(index_tree(spark, root, settings=Settings(embedding_model="hashing-64"), rebuild=True)) == (3, 3, 0, 0)
    index.delete_snapshots()
    assert index.manifest() is None


def test_language_filter(spark):
    rows = [(i, [1.0, i / 100], "python" if i < 10 else "markdown") for i in range(20)]
    v = spark.createDataFrame(rows, "chunk_id long, embedding array<float>, language string")
    q = [1.0, 0.0]
    assert [r["chunk_id"] for r in search(v, [0.0, 1.0], 2).collect()] == [19, 18]
    assert search(v, [0.0, 1.0], 2, "python").count() == 0 and search(v, [0.0, 1.0], 2, "python", exact_filter=True).count() == 2
    assert [r["chunk_id"] for r in search(v, q, 3).collect()] == [0, 1, 2] and search(v, q, 0).count() == 0 and search(v.limit(0), q, 3).count() == 0


def test_embedder():
    own = em.HashingEmbedder(64)
    v = own.encode(["readFile from disk", "", "read_file from disk"])
    assert v.shape == (3, 64) and v.dtype == np.float32 and abs(np.linalg.norm(v[0]) - 1) < 1e-6 and not v[1].any()
    assert np.allclose(v[0], v[2]) and own.encode([]).shape == (0, 64) and len(em.fingerprint(own)) == 16


def test_command_line(spark, repo, capsys):
    root = str(repo)
    assert main(["index", root], spark) == 0 and "files indexed: 4" in capsys.readouterr().out
    assert main(["query", "route", "--path", root, "--k", "1", "--json"], spark) == 0
    assert json.loads(capsys.readouterr().out)[0]["symbol"] == "route"
    assert main(["query", "route", "--path", root, "--k", "1"], spark) == 0 and "web.js:2-2 (route, score=" in capsys.readouterr().out
    assert main(["status", "--path", root], spark) == 0 and "chunks:" in capsys.readouterr().out
    assert main(["query", "x", "--path", root + "/none"], spark) == 1 and main(["index", root + "/none"], spark) == 1
    top = repo.parent
    (top / "q.jsonl").write_text(json.dumps({"id": "1", "repo": repo.name, "query": "evict cache", "relevant": [{"file": "pkg/cache.py", "symbol": "Cache.evict", "start_line": 4, "end_line": 5}]}) + "\n\n")
    (top / "m.yaml").write_text(f"repos:\n  - name: {repo.name}\n")
    args = ["eval", "--queries", str(top / "q.jsonl"), "--manifest", str(top / "m.yaml"), "--repos-dir", str(top), "--k", "1,3", "--output", str(top / "o.json")]
    assert main(args, spark) == 0
    told = json.loads((top / "o.json").read_text())
    assert told["overall"]["n_queries"] == 1 and told["overall"]["recall_at_k"]["3"] == 1.0 and "| **overall** |" in capsys.readouterr().out
    assert main([*args, "--baseline", "naive"], spark) == 0
    assert main([*args, "--repo", "unknown"], spark) == 0 and "| **overall** | 0 |" in capsys.readouterr().out


def parts(root):
    """Modification times of the index's bucket files, by their path in the index."""
    top = os.path.join(root, ".seekstone", "snapshots")
    return {os.path.relpath(os.path.join(d, f), top): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(top) for f in fs if f.endswith(".parquet") and "bucket=" in d}


def test_one_changed_file_rewrites_one_bucket(spark, tmp_path):
    for i in range(1000):
        (tmp_path / f"f{i}.txt").write_text(f"text of file {i}\n")
    root = str(tmp_path)
    assert stats(index_tree(spark, root)) == (1000, 1000, 0, 0)
    index = Index.of(spark, root)
    before, first = parts(root), index.manifest()
    chunks = {tuple(r)[:2] for r in index.chunks().select("chunk_id", "file_path").collect()}
    (tmp_path / "f17.txt").write_text("another text\n")
    told = index_tree(spark, root)
    assert stats(told) == (1000, 1, 999, 0) and told.chunks_written == 1
    after, second = parts(root), index.manifest()
    fresh = set(after) - set(before)
    assert {p.split("/")[0] for p in fresh} == {"2"} and len({p.split("/")[2] for p in fresh}) == 1 and all(after[p] == t for p, t in before.items())
    moved = [b for b in first["buckets"]["chunks"] if second["buckets"]["chunks"][b] != 1]
    assert len(moved) == 1 and len(second["retired"]) == 2
    now = {tuple(r)[:2] for r in index.chunks().select("chunk_id", "file_path").collect()}
    assert len(now) == 1000 and len(now - chunks) == 1 and index.files().count() == 1000
    # nothing to do: nothing written, and what the last run replaced is deleted
    assert stats(index_tree(spark, root)) == (1000, 0, 1000, 0)
    assert set(parts(root)) == set(after) - {p for p in before if p.split("/")[2] == f"bucket={moved[0]}"} and index.chunks().count() == 1000


def test_a_bucket_that_empties(spark, tmp_path):
    (tmp_path / "only.txt").write_text("x\n")
    root = str(tmp_path)
    index_tree(spark, root)
    os.remove(tmp_path / "only.txt")
    told = index_tree(spark, root)
    assert (told.files_scanned, told.files_indexed, told.files_skipped, told.files_removed, told.chunks_written) == (0, 0, 0, 1, 0)
    index = Index.of(spark, root)
    assert index.chunks().count() == 0 and index.files().count() == 0 and index.manifest()["buckets"] == {"chunks": {}, "files": {}}
    (tmp_path / "only.txt").write_text("y\n")
    told = index_tree(spark, root)
    assert (told.files_scanned, told.files_indexed, told.chunks_written) == (1, 1, 1) and index.files().count() == 1
