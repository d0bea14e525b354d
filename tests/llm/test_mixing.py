import re

import numpy as np
import pytest

from seekstone.llm import mixing

from .common import awkward, empty, words


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def fill(sizes, weights=(5, 2, 1), share=1.5, ceiling=2.0):
    """Targets by the rule's words: share by weight, stop at the ceiling, share the rest again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    out, rest, open_ = {}, share * sum(sizes.values()), set(names)
    while open_:
        total = sum(w[s] for s in open_)
        over = {s for s in open_ if rest * w[s] / total > ceiling * sizes[s]}
        if not over:
            return out | {s: rest * w[s] / total for s in open_}
        for s in over:
            out[s] = ceiling * sizes[s]
        rest -= sum(ceiling * sizes[s] for s in over)
        open_ -= over
    return out


def test_targets_and_sums(spark):
    rows = [(i, words(i, 5 + (i * 37) % 200), ["a", "b", "c", None, "d"][min(i % 9, 4)]) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.taken(df).toPandas()
    again = mixing.taken(df.repartition(7)).toPandas()
    assert got.sort_values("doc_id").taken.tolist() == again.sort_values("doc_id").taken.tolist()
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + size(t)
    want = fill(sizes)
    for s, part in got.groupby("source", dropna=False):
        s = None if s is None or s != s else s
        assert part.target.iloc[0] == pytest.approx(want[s]) and part.source_size.iloc[0] == sizes[s]
        assert abs(part.taken.sum() - want[s]) < 0.02 * sizes[s] + 50 and (part.taken <= 2 * part["size"]).all()
        assert abs(part.copies.sum() - len(part) * want[s] / sizes[s]) <= 2


def test_blocks_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK", 40)
    df = spark.createDataFrame([(i, words(i, 3 + i % 50), "ab"[i % 3 == 0]) for i in range(1000)], "doc_id long, text string, source string")
    got = mixing.taken(df).toPandas()
    for _, part in got.groupby("source"):
        assert abs(part.taken.sum() - part.target.iloc[0]) < 150
    assert len(got) == 1000


def test_flight_keeps_totals():
    rng = np.random.default_rng(1)
    p, words_ = rng.random(300), np.sort(rng.integers(1, 1000, 300))[::-1].astype(float)
    ones, draws = np.ones(300), rng.random(300)
    out = mixing.flight(p, ones, words_, draws)
    assert ((out > 0) & (out < 1)).sum() <= 2 and out.sum() == pytest.approx(p.sum()) and (out * words_).sum() == pytest.approx((p * words_).sum())
    assert set(mixing.land(out, words_, draws)) <= {0.0, 1.0}
    mean = np.mean([mixing.land(mixing.flight(p[:12], ones[:12], words_[:12], rng.random(12)), words_[:12], rng.random(12)) for _ in range(4000)], axis=0)
    assert np.abs(mean - p[:12]).max() < 0.05


def test_awkward(spark):
    df = awkward(spark)
    got = mixing.taken(df).toPandas()
    assert len(got) == df.count() and mixing.taken(empty(spark)).count() == 0
    assert (got[got["size"] == 0].taken == 0).all()
    kept = mixing.stage(spark, df, "")
    assert kept.columns == df.columns
    assert mixing.stage(spark, empty(spark), "").count() == 0
    assert kept.count() == int(got.copies.sum())


def test_repeated_rows(spark):
    """One row repeated very often is no unit that is taken whole: its source meets its target."""
    rows = [(i, words(i, 40), "a", i) for i in range(120)] + [(999, words(999, 50), "a", i % 3) for i in range(400)]
    rows += [(2000 + i, words(i, 60), "b", i) for i in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, other int")
    got = mixing.taken(df).toPandas()
    assert len(got) == len(rows) and (got.taken <= 2 * got["size"]).all()
    for _, part in got.groupby("source"):
        assert abs(part.taken.sum() - part.target.iloc[0]) <= 60
    kept = mixing.stage(spark, df, "").toPandas()
    for i, part in got.groupby("doc_id"):
        assert (kept.doc_id == i).sum() == part.copies.sum()
    share = kept[kept.doc_id == 999].groupby("other").size()
    assert set(share.index) <= {0, 1, 2} and share.sum() == got[got.doc_id == 999].copies.sum() and share.max() <= 2 * 134


def plain_cube(p, words_, draws):
    """One block's flight and landing, with vectors of the null-space by singular values."""
    p = p.copy()
    while True:
        open_ = np.flatnonzero((p > 1e-9) & (p < 1 - 1e-9))
        if len(open_) < 3:
            return p
        pool = open_[:3]
        u = np.linalg.svd(np.array([np.ones(3), words_[pool]]))[2][-1]
        steps = [((1 - p[j]) / v if v > 0 else -p[j] / v) for j, v in zip(pool, u) if abs(v) > 1e-12]
        p[pool] = np.clip(p[pool] + min(steps) * u, 0, 1)


def test_against_a_plain_cube():
    """Totals of documents and words are those that a plain null-space flight keeps."""
    rng = np.random.default_rng(4)
    for n in (5, 50, 400):
        p, words_ = rng.random(n), np.sort(rng.integers(1, 500, n))[::-1].astype(float)
        plain, own = plain_cube(p, words_, None), mixing.flight(p, np.ones(n), words_, rng.random(n))
        for x in (plain, own):
            assert x.sum() == pytest.approx(p.sum(), abs=1e-6) and (x * words_).sum() == pytest.approx((p * words_).sum(), rel=1e-6)
            assert ((x > 1e-9) & (x < 1 - 1e-9)).sum() <= 2
