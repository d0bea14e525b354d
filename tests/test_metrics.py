import pytest

from seekstone.operators import evaluate as ev


def measure(spark, retrieved, relevant, k):
    hits = spark.createDataFrame([(1, i, r) for i, r in enumerate(retrieved, 1)], "query_id int, rank int, matched string")
    keys = spark.createDataFrame([(1, r) for r in relevant], "query_id int, key string")
    return ev.metrics(hits, keys, [k]).first()


@pytest.mark.parametrize(
    "retrieved,relevant,k,precision,recall,mrr",
    [
        (["a", "b", "c"], ["a", "b"], 3, 2 / 3, 1.0, 1.0),
        (["x", "a"], ["a"], 1, 0.0, 0.0, 0.5),
        (["x", "a"], ["a"], 5, 0.5, 1.0, 0.5),
        (["a", "a", "b"], ["a", "b", "c"], 2, 1.0, 1 / 3, 1.0),
        ([], ["a"], 3, 0.0, 0.0, 0.0),
        (["x", "y"], ["a"], 2, 0.0, 0.0, 0.0),
    ],
)
def test_by_hand(spark, retrieved, relevant, k, precision, recall, mrr):
    r = measure(spark, retrieved, relevant, k)
    assert (r["precision"], r["recall"], r["mrr"]) == (pytest.approx(precision), pytest.approx(recall), pytest.approx(mrr))


def test_queries_without_relevant_spans(spark):
    """They count, with zeros; and the summary has the published keys and heads."""
    hits = spark.createDataFrame([(1, 1, "a"), (2, 1, "__miss__7")], "query_id int, rank int, matched string")
    keys = spark.createDataFrame([(1, "a")], "query_id int, key string")
    asked = spark.createDataFrame([(1, "r"), (2, "r")], "query_id int, repo string")
    told = ev.metrics(hits, keys, [1], asked)
    assert sorted(tuple(r) for r in told.collect()) == [(1, 1, 1.0, 1.0, 1.0), (2, 1, 0.0, 0.0, 0.0)]
    summary = ev.summarize(told, asked)
    part = {"n_queries": 2, "precision_at_k": {1: 0.5}, "recall_at_k": {1: 0.5}, "mrr": 0.5}
    assert ev.summary_dict(summary, [1]) == {"overall": part, "per_repo": {"r": part}}
    assert ev.markdown_table(summary, [1]).splitlines() == ["| Scope | n | P@1 | R@1 | MRR |", "|---|---|---|---|---|", "| **overall** | 2 | 0.500 | 0.500 | 0.500 |", "| r | 2 | 0.500 | 0.500 | 0.500 |"]


def test_matching(spark):
    hits = spark.createDataFrame([(1, 1, 10, "f", "s", 90, 99), (1, 2, 11, "f", "o", 1, 10), (1, 3, 12, "g", "s", 1, 10), (1, 4, 13, "f", "o", 8, 30)], "query_id long, rank int, chunk_id long, file_path string, qualified_name string, start_line int, end_line int")
    queries = spark.createDataFrame([(1, [("f", "t", 1, 10), ("f", "s", 1, 12)])], "id long, relevant array<struct<file:string,symbol:string,start_line:int,end_line:int>>")
    got = {r["rank"]: r["matched"] for r in ev.match_hits(hits, queries).collect()}
    assert got == {1: "f::s", 2: "f::t", 3: "__miss__12", 4: "__miss__13"}


def test_missing_spans(spark, tmp_path):
    (tmp_path / "q.jsonl").write_text('{"id": "1", "repo": "r", "query": "q"}\n')
    with pytest.raises(Exception, match="no relevant spans"):
        ev.load_queries(spark, str(tmp_path / "q.jsonl")).collect()


@pytest.mark.parametrize("least", [0.5, 0.25, 0.03, 1.0])
def test_overlapping_ranges(spark, least):
    """The binned join against all pairs, with long, short, equal and empty ranges, and rows that repeat."""
    import random

    rng = random.Random(9)
    side = lambda n: [(rng.choice("ab"), i, s, s + rng.choice((-1, 0, 0, 1, 3, 15, 16, 17, 200))) for i in range(n) for s in [rng.randint(1, 60)]]
    a, b = side(120), side(120)
    b += [a[0], a[0], ("a", 500, None, 4), (None, 501, 1, 9)]
    frame = lambda rows: spark.createDataFrame(rows, "file string, n int, start_line int, end_line int")

    def iou(x, y):
        both = max(min(x[3], y[3]) - max(x[2], y[2]) + 1, 0)
        return both / (max(x[3], y[3]) - min(x[2], y[2]) + 1)

    fine = lambda r: r[0] is not None and r[2] is not None and r[3] >= r[2]
    want = sorted((x[1], y[1], round(iou(x, y), 9)) for x in a for y in b if fine(x) and fine(y) and x[0] == y[0] and iou(x, y) >= least)
    got = sorted((r["a"]["n"], r["b"]["n"], round(r["iou"], 9)) for r in ev.overlapping(frame(a), frame(b), ["file"], least).collect())
    assert got == want and got


def test_overlaps_are_not_all_pairs(spark):
    """A file of 4,000 windows: the join makes rows in proportion to its windows."""
    rows = spark.range(4000).selectExpr("'f' AS file", "int(id) AS n", "int(id * 10 + 1) AS start_line", "int(id * 10 + 20) AS end_line")
    assert ev.overlapping(rows, rows, ["file"], 0.3).count() == 3 * 4000 - 2
    plan = ev.overlapping(rows, rows, ["file"], 0.3)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
