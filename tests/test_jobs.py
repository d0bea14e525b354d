"""The jobs over growing copies of tables, run again, broken off and run anew."""

import json
import os
import random
import shutil

import duckdb
import pytest

import jobs
from jobs import answer_questions as aq
from jobs import common
from jobs import refresh_windows as rw
from seekstone.functions.text import py_line_windows
from seekstone.operators import search

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def deliver(spark, folder, rows):
    spark.createDataFrame([(*r, "s", 0) for r in rows], DOCS).coalesce(1).write.mode("append").parquet(str(folder))


def expected(docs, window=60, overlap=10):
    out = set()
    for i, (text, lang) in docs.items():
        for n, (a, b, t) in enumerate(py_line_windows(text or "", 1, window, overlap), 1):
            if t.strip():
                out.add((i, f"{i}.txt:window{n}", a, b, len(t.split()), lang or "none"))
    return out


def found(df):
    rows = [(r["doc_id"], r["symbol_name"], r["start_line"], r["end_line"], r["n_tokens"], r["lang"]) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def text(seed, n):
    return "\n".join(f"line {seed} {i}" for i in range(n))


def test_refresh_takes_only_what_is_new(spark, tmp_path):
    source, out, mark = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "mark")
    docs = {1: (text(1, 130), "en"), 2: (text(2, 5), "de"), 3: (None, "en"), 4: ("", None), 5: (text(5, 61), "")}
    deliver(spark, source, [(i, *v) for i, v in docs.items()] + [(None, "lost", "en")])
    run = lambda: rw.refresh(spark, str(source), out, mark)
    assert run() == {"batches": 1, "rows": 6, "without_id": 1, "documents": 5, "windows": 6}
    assert found(rw.current(spark, out)) == expected(docs)
    assert run()["batches"] == 0 and found(rw.current(spark, out)) == expected(docs)
    # a changed, a shortened to nothing, an unchanged and a new document
    docs |= {1: (text(9, 20), "en"), 5: (None, "en"), 6: (text(6, 70), "fr")}
    deliver(spark, source, [(i, *docs[i]) for i in (1, 2, 5, 6)])
    assert run() == {"batches": 1, "rows": 4, "without_id": 0, "documents": 3, "windows": 3}
    assert found(rw.current(spark, out)) == expected(docs)
    # back to an older text
    docs[1] = (text(1, 130), "en")
    deliver(spark, source, [(1, *docs[1])])
    assert run()["documents"] == 1 and found(rw.current(spark, out)) == expected(docs)


def test_refresh_after_a_crash(spark, tmp_path):
    """A batch that wrote its windows but not its files nor its commit is run again with the same result."""
    source, out, mark = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "mark")
    first, docs = {1: (text(1, 10), "en"), 2: (text(2, 10), "en")}, {1: (text(3, 80), "en"), 2: (text(2, 10), "en"), 7: (text(7, 3), "de")}
    deliver(spark, source, [(i, *v) for i, v in first.items()])
    rw.refresh(spark, str(source), out, mark)
    deliver(spark, source, [(i, *v) for i, v in docs.items()])
    rw.refresh(spark, str(source), out, mark)
    shutil.rmtree(f"{out}/files/batch=1")
    for name in os.listdir(f"{mark}/commits"):
        if name.strip(".").startswith("1"):
            os.remove(f"{mark}/commits/{name}")
    assert found(rw.current(spark, out)) == expected(first)  # readers see the versions before
    assert rw.refresh(spark, str(source), out, mark)["documents"] == 2
    assert found(rw.current(spark, out)) == expected(docs)


def test_refresh_repeats_and_batches(spark, tmp_path):
    """Two texts of a document in one batch: the greater hash counts, whatever the order; many small batches give the same."""
    source = tmp_path / "in"
    for i in range(4):
        deliver(spark, source, [(i, text(i, 65), "en"), (9, "a", "en"), (9, "b", "en")])
    got = []
    for n in (1, 100):
        out = str(tmp_path / f"out{n}")
        done = rw.refresh(spark, str(source), out, str(tmp_path / f"mark{n}"), rw.Config(window_lines=20, overlap_lines=5, max_files_per_batch=n))
        assert done["batches"] == (4 if n == 1 else 1) and done["documents"] == 5
        got.append(found(rw.current(spark, out)))
    assert got[0] == got[1] == expected({i: (text(i, 65), "en") for i in range(4)} | {9: ("a", "en")}, 20, 5)


def conversations(spark, path, rows):
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.mode("overwrite").parquet(str(path))


def test_answers_and_shards(spark, tmp_path):
    docs, talk, out = tmp_path / "docs", tmp_path / "talk", str(tmp_path / "out")
    deliver(spark, docs, [(1, "where are cache entries evicted", "en"), (2, "parse the route table of requests", "en"), (3, None, "en"), (None, "cache", "en"), (4, "parse the route table of requests", "en")])
    conversations(spark, talk, [(0, 0, "user", "how are entries of the cache evicted"), (0, 1, "assistant", "cache"), (1, 0, "user", "route of requests"), (1, 2, "user", "..."), (2, 0, "user", None), (None, 0, "user", "cache")])
    config = aq.Config(k=2, dimension=64, shards=2)
    run = lambda **more: aq.answer(spark, str(docs), str(talk), out, config, **more)
    told = lambda: sorted(tuple(r) for r in spark.read.schema(aq.ANSWERS).parquet(out).select("conv_id", "turn", "rank", "doc_id", "shard").collect())
    assert run() == {"answers": 4, "questions": 2, "shards": 2}
    before = told()
    assert before[0] == (0, 0, 1, 1, 0) and before[2:] == [(1, 0, 1, 2, 1), (1, 0, 2, 4, 1)]  # equal passages: the smaller document first
    assert run() == {"answers": 4, "questions": 2, "shards": 2} and told() == before
    # one shard anew: the other stays as it is
    conversations(spark, talk, [(0, 0, "user", "route"), (1, 0, "user", "evicted")])
    assert run(shards=[1])["shards"] == 1
    after = told()
    assert after[:2] == before[:2] and after[2] == (1, 0, 1, 1, 1)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(jobs.queries()))
def test_equals_duckdb(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    settings = spark.conf.getAll
    own, other = jobs.queries()[name](spark, SF).toPandas(), con.execute(jobs.oracle_sql()[name]).fetchdf()
    cols = sorted(own.columns)
    assert cols == sorted(other.columns) and len(own) > 0
    rows = lambda f: sorted(map(str, f[cols].astype(object).values.tolist()))
    assert rows(own) == rows(other)
    assert settings == spark.conf.getAll


def test_configuration_files(tmp_path):
    here = os.path.dirname(jobs.__file__)
    assert common.read_config(rw.Config, f"{here}/refresh_windows.json") == rw.Config()
    assert common.read_config(aq.Config, f"{here}/answer_questions.json") == aq.Config()
    bad = tmp_path / "c.json"
    bad.write_text(json.dumps({"windows": 3}))
    with pytest.raises(ValueError, match="windows"):
        common.read_config(rw.Config, str(bad))


def test_command_lines(spark, tmp_path, monkeypatch):
    """Both command lines run with plain paths, and leave the session of others alone."""
    docs, talk = tmp_path / "docs", tmp_path / "talk"
    deliver(spark, docs, [(1, "a cache of entries", "en")])
    conversations(spark, talk, [(1, 0, "user", "which cache")])

    class Lent:
        def __getattr__(self, name):
            return (lambda: None) if name == "stop" else getattr(spark, name)

    monkeypatch.setattr(common, "start", lambda name: Lent())
    assert rw.main(["--documents", str(docs), "--output", str(tmp_path / "w"), "--checkpoint", str(tmp_path / "m"), "--config", os.path.dirname(jobs.__file__) + "/refresh_windows.json"]) == 0
    assert aq.main(["--documents", str(docs), "--conversations", str(talk), "--output", str(tmp_path / "a"), "--shard", "1"]) == 0
    assert rw.current(spark, str(tmp_path / "w")).count() == 1 and spark.read.parquet(str(tmp_path / "a")).count() == 1


def test_questions_of_many_blocks(spark, tmp_path, monkeypatch):
    """More questions than one block holds: the vectors of the windows are not shuffled for any block, and answers are those of one block."""
    rng = random.Random(4)
    said = lambda: " ".join(rng.choice(("cache", "entry", "route", "table", "parse", "evict", "token")) + str(rng.randrange(9)) for _ in range(8))
    docs, talk = tmp_path / "docs", tmp_path / "talk"
    spark.createDataFrame([(i, said(), "en", "s", 0) for i in range(200)], DOCS).repartition(8).write.parquet(str(docs))
    conversations(spark, talk, [(i, 0, "user", said()) for i in range(150)] + [(i, 1, "user", "which cache") for i in range(20)])
    config = aq.Config(k=3, dimension=32, shards=4)
    plans, plain = [], aq.top_k

    def told(out):
        done = aq.answer(spark, str(docs), str(talk), out, config)
        assert done == {"answers": 510, "questions": 170, "shards": 4}
        assert not list((tmp_path / out).glob("_hits-*/block=*"))
        return sorted(map(tuple, spark.read.schema(aq.ANSWERS).parquet(out).collect()))

    def watched(*given):
        hits = plain(*given)
        plans.append(hits._jdf.queryExecution().optimizedPlan().toString())
        return hits

    one = told(str(tmp_path / "one"))
    monkeypatch.setattr(search, "QUERY_BLOCK", 64)
    monkeypatch.setattr(search, "DEALT", 1)
    monkeypatch.setattr(aq, "top_k", watched)
    assert told(str(tmp_path / "many")) == one
    assert len(plans) > 3 and not any("CoGroups" in p or "RepartitionByExpression" in p for p in plans)
