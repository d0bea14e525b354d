from seekstone.llm import pii

from .common import docs


def test_values_found_once_count_whatever_the_size(spark, monkeypatch):
    """Values that one row has make their other context confident, whether keys are all broadcast or dealt."""
    rows = [(i, f"please reach me user{i}@host{i}.com or not") for i in range(40)]
    rows += [(100 + i, f"please reach me tag{i}x9 or not") for i in range(20)] + [(200 + i, f"a badge holder tag{i}x9 came in") for i in range(20)]
    rows += [(300 + i, f"a badge holder new{i}y7 came in") for i in range(3)]
    df = docs(spark, rows)
    added = lambda: {r["doc_id"]: [(s["start"], s["end"]) for s in r["all"] if s["kind"] >= len(pii.KINDS)] for r in pii.find(df).collect()}
    want = added()
    assert all(len(want[300 + i]) == 1 for i in range(3))
    monkeypatch.setattr(pii, "BROADCAST_PATTERNS", 1)
    assert added() == want
