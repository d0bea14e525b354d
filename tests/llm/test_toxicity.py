import random
import time

import numpy as np
import pytest

from seekstone.llm import toxicity as tox

from .common import awkward, docs, empty, words

BAD = ["idiot", "worthless", "stupid", "clown"]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(1)
    out = []
    for i in range(600):
        w = words(i, 60).split()
        bad = i % 5 == 0
        for _ in range(3 * bad):
            w.insert(rng.randrange(len(w)), rng.choice(BAD))
        out.append((i, " ".join(w), int(bad)))
    return out


@pytest.fixture(scope="module")
def scorer(spark, rows):
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i < 400], "doc_id long, label int")
    return tox.train(docs(spark, [(i, t) for i, t, _ in rows]).select("doc_id", "text"), labels)


def test_held_out(rows, scorer):
    for i, t, y in rows[400:]:
        assert (scorer.score(t) >= 0.5) == bool(y)


def test_restores(scorer):
    for span, plain in {"1d10t": "idiot", "w0rthl3ss": "worthless", "s t u p i d": "stupid", "cl0000wn": "clown", "iiidiot": "idiot", "s.t.u.p.i.d": "stupid"}.items():
        assert tox.restored(span, scorer.model) == plain
        assert scorer.score(f"{words(7, 30)} {span} and {span} {words(8, 30)}") >= 0.5
    plain = "Ordinary text, with words! And 3 numbers: 1999."
    assert tox.restored(plain, scorer.model) == plain.lower() and scorer.score(plain) < 0.5


def test_character_model():
    counts = np.bincount(np.random.default_rng(1).integers(0, 32**4, 5000), minlength=32**4)
    p = np.exp(tox.character_model(counts)).reshape(-1, 32)
    assert np.allclose(p.sum(axis=1), 1, atol=1e-4)
    assert tox.symbols("Éa-- b🙂").tolist() == [0, 5, 1, 0, 2, 0]


def test_no_labels_and_awkward(spark, scorer):
    df = awkward(spark)
    base = tox.pick(df, "doc_id long", "text string")
    for labels in ([], [(1, 1), (2, 1)], [(None, 1), (3, None)]):
        one = tox.train(base, spark.createDataFrame(labels, "doc_id long, label int"))
        got = tox.score(base, one).collect()
        assert len(got) == df.count() and len({r["score"] for r in got}) == 1 and 0 <= got[0]["score"] <= 1
    assert tox.score(tox.pick(empty(spark), "doc_id long", "text string"), scorer).count() == 0
    assert tox.train(tox.pick(empty(spark), "doc_id long", "text string"), spark.createDataFrame([], "doc_id long, label int")).weights == {}
    assert tox.restored("z1" * 500, scorer.model)


def test_symbols_at_the_end_and_spaced(scorer):
    """Symbols at a word's end, spaced symbols, and three spaced letters are decoded; plain punctuation and figures are left."""
    for span, plain in {"idi0+": "idiot", "1d107": "idiot", "i d 1 0 t": "idiot", "5 t u p 1 d": "stupid", "c-l-0-w-n": "clown"}.items():
        assert tox.restored(span, scorer.model) == plain
        assert scorer.score(f"{words(7, 30)} {span} and {span} {words(8, 30)}") >= 0.5
    counts = np.zeros(32**4, np.int64)
    for w in [" ass ", " you are "] * 50:
        c = tox.symbols(w)
        c = np.concatenate([[0, 0], c])
        np.add.at(counts, c[:-3] << 15 | c[1:-2] << 10 | c[2:-1] << 5 | c[3:], 1)
    model = tox.character_model(counts)
    assert [tox.restored(t, model) for t in ("you a$$", "a s s", "you a $ s")] == ["you ass", "ass", "you ass"]
    for plain in ("idiot!!!!!!!!", "1 2 3 4", "words! 1999", "clown?"):
        assert tox.restored(plain, scorer.model) == plain


def test_exact_path():
    """The path found is the best of all readings, counted one by one; there is no beam."""
    look = np.random.default_rng(1).uniform(-12, 0, tox.SYMBOLS**tox.ORDER).astype(np.float32)

    def cost_of(parts):
        context, score = 0, 0.0
        for letters, cost in parts:
            score += cost
            for c in map(tox._symbol, letters):
                if c or context & 31:
                    score += float(look[context << 5 | c])
                    context = (context << 5 | c) & 0x7FFF
        return score + (float(look[context << 5]) if context & 31 else 0.0)

    def readings(span, spaced, i=0):
        if i == len(span):
            yield ()
        for letters, nxt, cost in tox._edges(span, i, spaced) if i < len(span) else ():
            for rest in readings(span, spaced, nxt):
                yield ((letters, cost), *rest)

    rng = random.Random(5)
    assert not hasattr(tox, "BEAM")
    for span in [*("".join(rng.choice("61|") for _ in range(7)) for _ in range(30)), *("".join(rng.choice("16|!0ab") for _ in range(5)) for _ in range(30)), *(" ".join(rng.choice("16!0ab") for _ in range(3)) for _ in range(20))]:
        spaced = bool(tox._SPACED.match(span))
        best = max(map(cost_of, readings(span, spaced)))
        found = [p for p in readings(span, spaced) if "".join(x for x, _ in p) == tox.restore(span, look)]
        assert max(map(cost_of, found)) == pytest.approx(best)


def test_long_runs_in_linear_time():
    """A megabyte without a blank, of any script, is searched and restored whole within seconds; what
    is given out early is what the whole search finds."""
    rng = random.Random(6)
    look = np.random.default_rng(2).uniform(-12, 0, tox.SYMBOLS**tox.ORDER).astype(np.float32)
    base = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(1_000_000))
    began = time.time()
    assert tox.restored("汉字文本测试" * 170_000, look) == "汉字文本测试" * 170_000
    assert tox.restored("x." * 500_000, look).startswith("x")
    assert len(tox.restored(base[:200_000], look)) > 150_000 and len(tox.restored("!" * 200_000 + "a", look)) > 0
    assert tox.doubtful(base) == [(0, len(base), False)] and tox.doubtful("a,b" * 300_000) == []
    assert time.time() - began < 60
    whole = base[:10_000]
    flush, tox._FLUSH = tox._FLUSH, 10**9
    try:
        want = tox.restore(whole, look)
    finally:
        tox._FLUSH = flush
    assert tox.restore(whole, look) == want


def test_doubtful_spans():
    assert [("x a$$ y"[a:b], s) for a, b, s in tox.doubtful("x a$$ y")] == [("a$$", False)]
    for text, spans in {"no 5 doubt here, 1999!": [], "s.p.a.m.foo@x": ["s.p.a.m", "foo@x"], "a b c d": ["a b c d"], "see fooo's": ["fooo's"], "a b, c": [], "": []}.items():
        assert [text[a:b] for a, b, _ in tox.doubtful(text)] == spans


def test_query_columns(spark, rows, tmp_path):
    """The query's rows by a plain computation: folds by zlib, scores by the scorer itself."""
    import zlib

    df = docs(spark, [(i, t) for i, t, _ in rows] + [(9000, None), (9001, "")])
    df.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{tmp_path}/labels.parquet")
    got = {r["doc_id"]: r for r in tox.op2_toxicity(spark, str(tmp_path)).collect()}
    fold = {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in got}
    base = tox.pick(df, "doc_id long", "text string")
    own = tox.train(base, spark.createDataFrame([(i, y) for i, _, y in rows if not fold[i]], "doc_id long, label int"))
    text = {i: t for i, t, _ in rows}
    for i, r in got.items():
        assert r["held_out"] == fold[i] and r["score"] == pytest.approx(own.score(text.get(i)), abs=1e-9) and r["predicted"] == int(r["score"] >= 0.5)
    assert len(got) == len(rows) + 2 and all(r["predicted"] == y for i, _, y in rows if fold[i] for r in [got[i]])
