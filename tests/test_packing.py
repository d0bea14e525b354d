import random

import pytest

from seekstone.functions.packing import pack_lines


def model(text, budget, overlap, dedupe=False):
    """The same by a plain loop: (first line, last line, tokens, text) of every block."""
    units = [(i, t) for i, t in enumerate((text or "").splitlines(), 1) if t.strip()]
    out, held, size, fresh = [], [], 0, 0
    for u in units:
        held.append(u)
        size, fresh = size + len(u[1].split()), fresh + 1
        if size >= budget:
            out.append(list(held))
            tail, count = [], 0
            for v in reversed(held):
                count += len(v[1].split())
                tail.insert(0, v)
                if count >= overlap:
                    break
            held, size, fresh = tail, count, 0
    if held and (fresh or not dedupe):
        out.append(held)
    return [(b[0][0], b[-1][0], sum(len(t.split()) for _, t in b), "\n".join(t for _, t in b)) for b in out]


@pytest.mark.parametrize("budget,overlap,dedupe", [(20, 5, False), (20, 5, True), (7, 7, False), (5, 0, True), (400, 50, False), (1, 1, False)])
def test_equals_the_loop(spark, budget, overlap, dedupe):
    rng = random.Random(budget)
    texts = {i: "\n".join(" ".join("w" * rng.randint(1, 3) for _ in range(rng.choice((0, 0, 1, 2, 3, 9, 30)))) for _ in range(rng.randint(0, 60))) for i in range(60)}
    texts |= {100: None, 101: "", 102: "\n \n", 103: "one", 104: "w " * 5000, 105: "a\r\nb\rc d"}
    rows = spark.createDataFrame(list(texts.items()), "id long, text string")
    got = {}
    for r in sorted(pack_lines(rows, ["id"], "text", budget, overlap, dedupe).collect(), key=lambda r: (r["id"], r["ordinal"])):
        got.setdefault(r["id"], []).append((r["start_line"], r["end_line"], r["n_tokens"], r["text"]))
    assert got == {i: m for i, t in texts.items() if (m := model(t, budget, overlap, dedupe))}


def test_a_long_text_in_one_row(spark):
    text = "\n".join(f"w{i} x y" for i in range(20_000))
    rows = spark.createDataFrame([(1, text)], "id long, text string")
    assert pack_lines(rows, ["id"], "text").count() == len(model(text, 400, 50))


def test_only_texts_are_shuffled(spark):
    plan = pack_lines(spark.createDataFrame([(1, "a")], "id long, text string"), ["id"], "text")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Python" not in plan and "InArrow" not in plan


def test_overlap_beyond_the_budget_is_refused(spark):
    with pytest.raises(ValueError):
        pack_lines(spark.createDataFrame([], "id long, text string"), ["id"], "text", 5, 6)
