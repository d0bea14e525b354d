from collections import Counter
from itertools import permutations

from seekstone.llm import filter_audit as fa

from .common import awkward, awkward_rows, empty


def marks(spark, rows=()):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int, TOXIC string, k1 long")


def brute(rows, labels):
    """rows: (doc_id, text, lang); the pipeline document by document, order by order."""
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    told = []
    for i, t, lang in rows:
        t = t or ""
        w = [x for x in "".join(" " if c in " \t\n\v\f\r" else c for c in t).split(" ") if x]
        fails = {
            "A": len(w) < 200,
            "B": 100 * len(set(w)) < 50 * len(w),
            "C": 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t),
            "D": any(c in "#$%&*|" for c in t),
            "E": i is not None and least.get(t, i) < i,
        }
        told.append((lang or "", {k for k, v in fails.items() if v}, i))
    out = {}
    for part in {x[0] for x in told}:
        own, shapley = [x for x in told if x[0] == part], Counter()
        for order in permutations("ABCDE"):
            left = own
            for k, f in enumerate(order, 1):
                gone = [x for x in left if f in x[1]]
                removed_before = [x for x in own if x not in left]
                redundant = sum(f in x[1] for x in removed_before)
                left = [x for x in left if f not in x[1]]
                shapley[f] += len(gone)
                lost = lambda at: sum(1 for x in gone if labels.get(x[2], (0, 0))[at] == 1)  # noqa: B023, E731
                out[part, "".join(order), k] = [len(left), len(gone), redundant, sum(x[1] == {f} for x in own), lost(0), lost(1)]
        for order in permutations("ABCDE"):
            for k, f in enumerate(order, 1):
                out[part, "".join(order), k].append(shapley[f])
    return out


def got(df):
    return {(r["part"], r["filter_order"], r["step"]): [r[c] for c in "kept removed redundant unique_fails good_lost toxic_lost shapley".split()] for r in df.collect()}


def test_brute_force(spark):
    texts = ["w " * 300, " ".join(f"w{i}" for i in range(250)), "Ab " * 10, "a # b", "", None, "x" * 50_000, "É Ü |", " ".join(f"W{i}" for i in range(400)) + " $"]
    rows = [(i, texts[i % len(texts)] if i % 4 else f"{texts[i % 5]}{i % 7}", ("en", "de", None)[i % 3]) for i in range(60)]
    labels = {i: (i % 2, int(i % 5 == 0)) for i in range(0, 80, 2)}
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    # rows that are equal in all but doc_id are told apart by it, so membership in a list is by identity
    assert got(fa.audit(frame, marks(spark, [(i, *v, "x", 1) for i, v in labels.items()]))) == brute(rows, labels)


def test_awkward_rows(spark):
    told = got(fa.audit(awkward(spark), marks(spark, [(1, 1, 0, "x", 1), (1, 0, 1, "y", 2), (None, 1, 1, "z", 3), (99, 1, 1, "", 4)])))
    parts = {r[2] or "" for r in awkward_rows()}
    assert len(told) == len(parts) * 600
    for part in parts:
        n = sum((r[2] or "") == part for r in awkward_rows())
        for order in map("".join, permutations("ABCDE")):
            assert told[part, order, 5][0] + sum(told[part, order, k][1] for k in range(1, 6)) == n
    assert sum(told["en", "ABCDE", k][4] for k in range(1, 6)) == 1 and sum(told["en", "ABCDE", k][5] for k in range(1, 6)) == 1
    # both rows of document 13 are documents, and neither is a copy of a smaller doc_id
    assert told["fr", "ABCDE", 1][:2] == [0, 2] and told["fr", "EDCBA", 1][:2] == [2, 0]


def test_empty_table(spark):
    assert fa.audit(empty(spark), marks(spark)).collect() == []


def test_words_are_not_shuffled(spark):
    """One exchange of texts; the aggregates by (text, word) and by text need none of their own."""
    plan = fa.text_flags(awkward(spark))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Python" not in plan
