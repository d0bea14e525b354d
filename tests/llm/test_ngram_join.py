import random

import numpy as np
import pytest

from seekstone.llm import ngram_join as nj

from .common import awkward, docs, empty
from .test_minhash import brute, family


def sets_of(rng, n, parts):
    return np.unique(rng.integers(0, 1 << 62, n, dtype=np.uint64))[:n]


def edited(rng, s, out, in_):
    keep = np.delete(s, rng.choice(len(s), out, replace=False))
    return np.unique(np.concatenate([keep, rng.integers(0, 1 << 62, in_, dtype=np.uint64)]))


@pytest.mark.parametrize("percent", [50, 80, 85, 95])
def test_bands_cover_partners(percent):
    low, high, many = nj.bands(percent)
    assert (low[1:] == high[:-1] + 1).all()
    for r in range(1, 3000):
        k = nj.band_of(np.array([r]), percent)[0]
        for s in range(-(-percent * r // 100), r + 1):
            if nj.most_apart(r, s, percent) >= (1 if s < r else 2):
                own = nj.band_of(np.array([s]), percent)[0]
                assert 0 <= own and k - own in (0, 1)
                assert nj.most_apart(r, min(r, high[own]), percent) < many[own]


@pytest.mark.parametrize("percent", [60, 80, 85])
def test_pigeonhole_loses_nothing(percent):
    """Sets just within the limit share a key, the larger as probe; whatever the costs say."""
    rng = np.random.default_rng(percent)
    for trial in range(150):
        n = int(rng.integers(8, 400))
        a = sets_of(rng, n, 1)
        most = nj.most_apart(n, n, percent)
        out = int(rng.integers(0, most + 1))
        b = edited(rng, a, min(out, n - 1), most - out)
        both = len(np.intersect1d(a, b))
        if 100 * both < percent * (len(a) + len(b) - both) or np.array_equal(a, b):
            continue
        cost = rng.integers(1, 1000, nj.COUNTERS).astype(np.float32) if trial % 2 else np.ones(nj.COUNTERS, np.float32)
        small, large = (a, b) if len(a) <= len(b) else (b, a)
        keys, who, roles = nj.keys_of([small, large], percent, cost)
        index = set(keys[(who == 0) & (roles & nj.INDEX > 0)].tolist())
        probe = set(keys[(who == 1) & (roles & nj.PROBE > 0)].tolist())
        assert index & probe


def test_costs_move_units():
    """A segment whose subset is common is left out, and wide ones take two units instead."""
    rng = np.random.default_rng(1)
    s = sets_of(rng, 300, 1)
    band = nj.band_of(np.array([300]), 85)
    parts = nj.Segments([s], band, 85)
    cost = np.ones(nj.COUNTERS, np.float32)
    hot = parts.exact[-3:] & np.uint64(nj.COUNTERS - 1)
    cost[hot.astype(np.int64)] = 1e6
    need = np.array([len(parts.exact)])
    once, twice = nj.allocate(parts, need, cost)
    assert not once[-3:].any() and once.sum() + twice.sum() == need[0] and twice.sum() >= 3 and (once | ~twice).all()


def test_empty_segments_are_left_out():
    """Segments that are empty in a set are not probed while wide ones can take their units."""
    rng = np.random.default_rng(2)
    sets = [sets_of(rng, 3000, 1) for _ in range(20)]
    parts = nj.Segments(sets, nj.band_of(np.full(20, 3000), 85), 85)
    need = np.full(20, nj.most_apart(3000, 3000, 85) + 1)
    once, twice = nj.allocate(parts, need, np.ones(nj.COUNTERS, np.float32))
    assert (parts.size == 0).sum() > 10 and not once[parts.size == 0].any() and not twice[parts.size < 2].any()
    assert (np.bincount(parts.owner, once.astype(int) + twice) == need).all()


def test_sketch_is_a_lower_bound():
    rng = np.random.default_rng(3)
    for _ in range(50):
        a = sets_of(rng, int(rng.integers(1, 2000)), 1)
        b = edited(rng, a, int(rng.integers(0, len(a) // 3 + 1)), int(rng.integers(0, 300)))
        x, y = sorted((nj.parities(a), nj.parities(b)), key=len)
        while len(y) > len(x):
            y = y[: len(y) // 2] ^ y[len(y) // 2 :]
        apart = sum(int(z).bit_count() for z in (x ^ y).view(np.uint64))
        assert apart <= len(np.setxor1d(a, b)) and 64 * len(nj.parities(a)) >= 4 * len(a)


@pytest.mark.parametrize("width,percent", [(4, 85), (5, 80), (2, 60)])
def test_brute_force(spark, width, percent):
    rng = random.Random(width)
    rows = [(i, " ".join(str(rng.randint(0, 10**9)) for _ in range(rng.randint(0, 60)))) for i in range(60)]
    for k in range(8):
        rows += family(rng, 150, 25, (0, 1, 2, 4, 6, 9, 12), 1000 + 100 * k)
    rows += [(3000 + i, " ".join(rng.choice("ab") for _ in range(rng.randint(1, 40)))) for i in range(150)]  # small sets that meet a lot
    rows += [(5000, "Same Words HERE"), (5001, "same words here"), (5002, "two words"), (5003, "TWO  words"), (5004, "")]
    rng.shuffle(rows)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in nj.groups(docs(spark, rows), width, percent).collect()}
    assert got == brute(rows, width, percent)


def test_hot_keys_are_dealt_by_class(spark, monkeypatch):
    """With every key hot, the result is the same."""
    rng = random.Random(5)
    rows = [r for k in range(3) for r in family(rng, 120, 20, (0, 1, 3, 5), 100 * k)]
    monkeypatch.setattr(nj, "HOT", 0)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in nj.groups(docs(spark, rows), 4, 85).collect()}
    assert got == brute(rows, 4, 85)


def test_templates_grow_with_texts(spark, monkeypatch):
    """Texts of 400 common words and 20 optional passages: pairs of sets compared grow about as texts do, and few don't link."""
    rng = random.Random(8)
    word = lambda: str(rng.randint(0, 10**9))
    common, passages = [word() for _ in range(400)], [[word() for _ in range(20)] for _ in range(20)]
    counts, compared = [], nj._compared

    def count(*given):
        out = compared(*given)
        counts[-1] += out.count()
        return out

    monkeypatch.setattr(nj, "_compared", count)
    for n in (100, 400):
        counts.append(0)
        rows = [(i, " ".join(common + [w for p in passages if rng.random() < 0.5 for w in p])) for i in range(n)]
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in nj.groups(docs(spark, rows), 3, 85).collect()}
        assert got == brute(rows, 3, 85)
    assert counts[0] <= 3 * 100 and counts[1] <= 3 * 400, counts  # of 4,950 and 79,800 pairs


def test_texts_are_shuffled_once(spark):
    """The aggregate of repeats and the join share one exchange of texts; only the classes have another."""
    df = docs(spark, [(1, "a b c"), (None, "d e f"), (None, None)])
    wanted = spark.createDataFrame([(7, None, 0)], "cls long, doc_id long, text_key long")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    plan = nj._texts_of(df, wanted)._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning") == 2


def test_session_is_left_as_it_was(spark):
    before = dict(spark.conf.getAll), {t.name for t in spark.catalog.listTables()}
    nj.groups(docs(spark, [(1, "a b c d e f g h i j"), (2, "a b c d e f g h i j k")]), 2, 80).collect()
    assert before == (dict(spark.conf.getAll), {t.name for t in spark.catalog.listTables()})


def test_awkward_rows(spark):
    got = {(r["doc_id"], r["n_shingles"]): r["component_id"] for r in nj.groups(awkward(spark), 4, 85).collect()}
    assert nj.groups(awkward(spark), 4, 85).count() == awkward(spark).count()
    assert got[2, 117] == 1 and got[None, 117] == 1 and got[3, 118] == 1
    assert got[4, 0] == 4 and got[6, 0] == 6 and got[None, 0] is None and got[7, 1] == 7 and got[12, 1] == 12


def test_empty_table_and_equal_sets_only(spark):
    assert nj.groups(empty(spark)).collect() == []
    rows = [(1, "a b c d e f"), (2, "A b c d e f"), (3, "a b c d e g")]
    assert {r["doc_id"]: r["component_id"] for r in nj.groups(docs(spark, rows), 3, 100).collect()} == {1: 1, 2: 1, 3: 3}
