import random
import re
from collections import Counter

from seekstone.llm import quality

from .common import awkward, docs, empty, words


def brute(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    wins = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    often = {g for g, n in Counter(wins).items() if n >= 2}
    covered = {i + d for i, g in enumerate(wins) if g in often for d in range(3)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), sum(x in lines[:i] for i, x in enumerate(lines)), len(covered)


def test_counts():
    texts = [None, "", " \n ", "a b c a b c a", "x\nx\ny\n x\n\n", "é é é é # $ |<>", words(1, 500), "a b\va b\fa b\r\na b", "the the the the"]
    for t in texts:
        assert quality.measure_text(t)[:5] == brute(t), t


def test_verdicts(spark):
    clean = [(i, words(i, 80 + i % 40)) for i in range(200)]
    junk = [(1000, " ".join(w + "###" for w in words(1, 90).split())), (1001, words(5, 90).upper()), (1002, ("spam " * 40 + words(7, 60))), (1003, "tiny text"), (1004, "a " * 100)]
    got = {r["doc_id"]: r for r in quality.verdicts(docs(spark, clean + junk)).collect()}
    assert all(got[i]["kept"] for i, _ in clean) and not any(got[i]["kept"] for i, _ in junk)
    assert got[1003]["base_failed"] and got[1004]["base_failed"] and not got[1000]["base_failed"]
    kept = quality.stage(spark, docs(spark, clean + junk), "")
    assert {r["doc_id"] for r in kept.collect()} == {i for i, _ in clean} and kept.columns == ["doc_id", "text", "lang", "source"]


def test_merged_sketches_agree(spark):
    rows = [(i, words(i, 60 + i % 90)) for i in range(120)]
    m = quality.measure(docs(spark, rows).select("text", "lang", "source"))
    half = quality.sketch(m.limit(120)).withColumn("source", quality.F.lit("t"))
    both = quality.merge(quality.sketch(m).unionByName(half), "lang")
    assert {r["n"] % 2 for r in both.collect()} == {0}
    q = {r["measure"]: r for r in quality.quartiles(quality.merge(quality.sketch(m), "lang"), "lang").collect()}
    values = sorted(len(t.replace(" ", "")) / len(t.split()) for _, t in rows)
    for p, name in ((0.25, "q1"), (0.75, "q3")):
        exact = values[int(p * (len(values) - 1))]
        assert abs(q[0][name] - exact) <= 0.02 * exact


def test_awkward(spark):
    df = awkward(spark)
    got = quality.verdicts(df)
    assert got.count() == df.count() and quality.verdicts(empty(spark)).count() == 0
    none = [r for r in got.collect() if r["n_words"] == 0]
    assert len(none) == 4 and all(r["base_failed"] and not r["kept"] for r in none)
    assert quality.stage(spark, df, "").columns == df.columns and quality.stage(spark, empty(spark), "").count() == 0


def test_long_texts_by_arrays(monkeypatch):
    """Texts over the limit are measured by arrays of hashes, with the same counts."""
    rng = random.Random(3)
    texts = [" ".join(rng.choice("ab cd e f g".split()) + ("\n" if rng.random() < 0.2 else "") for _ in range(n)) for n in (1, 2, 3, 4, 30, 300)] + ["", " \n ", "x" * 50]
    want = [quality.measure_text(t) for t in texts]
    monkeypatch.setattr(quality, "LONG_TEXT", 0)
    assert [quality.measure_text(t) for t in texts] == want
