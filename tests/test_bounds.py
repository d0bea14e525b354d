"""What grows with the input, and how: scores in tiles, relevance by class, words hashed once, chunks in batches of many files."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from jobs import answer_questions as aq
from seekstone.functions import embed as em
from seekstone.operators import evaluate as ev
from seekstone.operators import search as s


@pytest.mark.parametrize("labels", [False, True])
def test_scores_are_held_by_tiles(labels):
    """4,000 queries by 9,000 vectors in three batches, many equal: all scores of one batch would have 96 MB."""
    rng = np.random.default_rng(3)
    v = rng.normal(size=(9000, 4))
    v[1000:1500] = v[7]
    v[8000] = np.nan
    ids, kind = rng.permutation(9000), pa.array([None if i % 50 == 0 else i % 3 for i in range(9000)], pa.int32())
    q = v[np.r_[0:2000, 0:2000]]
    tracemalloc.start()
    best, told = s._Best(q, 5, kind.take(pa.array(np.r_[0:2000, 0:2000])) if labels else None), []
    for a in range(0, 9000, 3000):
        who, at, score = best.take(ids[a : a + 3000], v[a : a + 3000], kind[a : a + 3000] if labels else None)
        told.append((who, ids[a + at], score))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 90e6
    who, own, score = (np.concatenate(x) for x in zip(*told))
    for n in (0, 7, 50, 1200, 1999, 2007):
        mine = sorted(zip(-score[who == n], own[who == n]))[:5]
        fine = [i for i in range(9000) if i != 8000 and (not labels or (kind[i].is_valid and kind[i] == kind[n % 2000]))]
        want = sorted(zip(-np.round(v[fine] @ q[n], s.PLACES), ids[fine]))[:5]
        assert [i for _, i in mine] == [i for _, i in want]


def test_relevance_by_class(spark):
    """The metrics of pairs without the pairs, with rows and queries of no class."""
    rows = spark.range(40).select(F.col("id").cast("string").alias("key"), F.when(F.col("id") % 7 != 0, F.col("id") % 3).alias("class"))
    asked = spark.createDataFrame([(1, 0), (2, 1), (3, None), (4, 9), (5, 2)], "query_id long, class long")
    hits = spark.createDataFrame([(q, r, str((q * 5 + r * 3) % 40)) for q in (1, 2, 3, 4) for r in range(1, 6)], "query_id long, rank int, matched string")
    pairs = asked.join(rows, "class").select("query_id", "key")
    told = hits.join(rows, F.col("matched") == F.col("key")).drop("key")
    want = sorted(tuple(r) for r in ev.metrics(hits, pairs, [1, 3, 5]).collect())
    assert sorted(tuple(r) for r in ev.metrics_by_class(told, asked, rows, [1, 3, 5]).collect()) == want and len(want) == 9


def test_vectors_of_words_hashed_once(spark):
    """Vectors in Arrow batches are those of Spark functions; words and long texts of every kind."""
    texts = [(1, "fooBar HTTPServer x9 a_b"), (2, None), (3, ""), (4, "éireeau viré ÉÀ 🙂 naïve ÀB"), (5, "word " * 5000), (6, "x" * 3000), (7, "a 1 é a 1 é"), (8, "$$")]
    rows = spark.createDataFrame(texts, "id long, text string")
    want = {r["id"]: r["embedding"] for r in em.hash_embed(rows, ["id"], "text", 48).collect()}
    got = {r["id"]: r["embedding"] for r in em.hash_rows(rows, "text", 48).collect()}
    assert got == want


def test_a_word_is_hashed_once(monkeypatch):
    calls = []
    plain = em._md5_32
    monkeypatch.setattr(em, "_md5_32", lambda f: calls.append(f) or plain(f))
    em.HashingEmbedder(32).encode(["cache of entries"] * 500)
    assert sum(f.startswith("w:") for f in calls) == 3


def test_chunks_of_many_files_in_one_batch(spark, monkeypatch):
    from seekstone.chunkers import registry

    seen = []
    monkeypatch.setattr(registry, "_batch", lambda held, names: seen.append(len(held)))

    class Files:
        def select(self, *names):
            return self

        def mapInArrow(self, run, schema):
            rows = {"file_path": [f"f{i}" for i in range(50)], "ext": [".txt"] * 50, "content": [b"a\nb"] * 50}
            return list(run([pa.RecordBatch.from_pydict(rows)]))

    registry._by_chunker(Files(), registry.Settings(), registry.chunker_for)
    assert seen == [50]


def test_questions_of_one_text_share_answers(spark, tmp_path, monkeypatch):
    """Each text is ranked once; negative ids and documents that are there twice are ranked apart."""
    asked = []
    plain = aq.top_k
    monkeypatch.setattr(aq, "top_k", lambda v, q, *more: asked.append(q.count()) or plain(v, q, *more))
    spark.createDataFrame([(-3, "a cache"), (2, "entries of a cache"), (2, "entries of a cache")], "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    spark.createDataFrame([(i, 0, "user", "which cache") for i in range(6)], "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "c"))
    aq.answer(spark, str(tmp_path / "d"), str(tmp_path / "c"), str(tmp_path / "o"), aq.Config(k=3, dimension=32))
    got = sorted(tuple(r) for r in spark.read.parquet(str(tmp_path / "o")).select("conv_id", "rank", "doc_id", "symbol_name").collect())
    assert asked == [1] and len(got) == 18
    assert [sorted(x[2:] for x in got if x[0] == i) for i in range(6)] == [[(-3, "-3.txt:window1"), (2, "2.txt:window1"), (2, "2.txt:window1")]] * 6
