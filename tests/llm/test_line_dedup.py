from pyspark.sql import functions as F

from seekstone.llm import line_dedup

from .common import awkward, docs, empty, words


def brute(rows):
    """Line dedup of (doc_id, text) rows by dictionaries."""
    seen, out = set(), {}
    for i, text in sorted(rows):
        lines = text.split("\n")
        full = [(k, x.strip(" \t\n\v\f\r")) for k, x in enumerate(lines) if x.strip(" \t\n\v\f\r")]
        gone = set()
        for a in range(len(full) - 2):
            key = tuple(x for _, x in full[a : a + 3])
            if key in seen:
                gone |= set(range(full[a][0], full[a + 2][0] + 1))
            seen.add(key)
        out[i] = "\n".join(x for k, x in enumerate(lines) if k not in gone)
    return out


def test_brute_force(spark):
    rows = [(i, "\n".join(f"line {(i * 7 + j * j) % 13}" if j % 5 else " " for j in range(3 + i % 20))) for i in range(60)]
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup(docs(spark, rows)).collect()}
    assert got == brute(rows)


def test_passage(spark):
    p = "first of the passage\nsecond of it\nthird of it\nfourth of it"
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup(docs(spark, [(1, f"a\n{p}\nb"), (2, f"c\n {p}\t\nd"), (3, "second of it\nthird of it")])).collect()}
    assert got == {1: f"a\n{p}\nb", 2: "c\nd", 3: "second of it\nthird of it"}


def test_awkward(spark):
    df = awkward(spark)
    out = line_dedup.stage(spark, df, "")
    flat = out.toDF(*[f"c{i}" for i in range(len(out.columns))])
    got = {(r["c0"], r["c9"]): r for r in flat.collect()}
    assert out.columns == df.columns and out.count() == df.count()
    by_id = {r["c0"]: r for r in flat.collect()}
    assert by_id[4]["c1"] is None and by_id[5]["c1"] == "" and by_id[6]["c1"] == " \n\t " and got
    assert by_id[10]["c1"] == "new line before\nnew line after" and by_id[10]["c4"] == len(by_id[10]["c1"]) and by_id[9]["c1"].count("\n") == 7
    assert line_dedup.stage(spark, empty(spark), "").count() == 0


def test_no_python(spark):
    plan = line_dedup.dedup(docs(spark, [(1, "a\nb\nc")]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and F is not None


def test_hot_windows(spark, monkeypatch):
    """Windows that occur very often, and a text of very many lines, are treated as all others."""
    passage = "\n".join(words(70 + i, 6) for i in range(5))
    rows = [(i, f"{words(i, 8)}\n{passage}\n{words(1000 + i, 8)}") for i in range(60)]
    rows += [(100, "\n".join(f"line {i % 49_000}" for i in range(100_000))), (101, "a\nb\nc\nd"), (102, "b\nc\nd\ne")]
    want = brute(rows)
    for hot, most in ((5, 50_000), (5, 1), (10**9, 50_000)):
        monkeypatch.setattr(line_dedup, "HOT", hot)
        monkeypatch.setattr(line_dedup, "MOST_HOT", most)
        got = {r["doc_id"]: r["text"] for r in line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert got == want
