import pytest
from pyspark.sql import functions as F

from seekstone.functions import text as tx

SAMPLES = ["", "\n", "a", "a\n", "a\r\nb\rc", "a\x0bb\x0cc\x1cd\x85e f g\n\n", "a b c\x85d\x1ce f", "  \t ", "x\n" * 61, "é\n\nü"]


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame([(i, s) for i, s in enumerate(SAMPLES)], "i int, s string")


def test_tokens_and_lines_as_python(frame):
    got = frame.select("i", tx.token_count(F.col("s")).alias("n"), tx.lines(F.col("s")).alias("l"), tx.is_blank(F.col("s")).alias("b")).orderBy("i").collect()
    for row, s in zip(got, SAMPLES):
        assert row["n"] == len(s.split()) and row["l"] == s.splitlines() and row["b"] == (not s.strip()), repr(s)


@pytest.mark.parametrize("window,overlap", [(60, 10), (20, 5), (3, 3), (5, 0), (1, 0), (4, 9)])
def test_windows_as_a_plain_loop(spark, window, overlap):
    def loop(n):
        out, i, step = [], 0, max(window - overlap, 1)
        while i < n:
            out.append((i + 1, min(i + window, n)))
            if i + window >= n:
                break
            i += step
        return out

    sizes = [0, 1, 2, 3, 4, 5, 19, 20, 21, 59, 60, 61, 110, 111]
    rows = spark.createDataFrame([(n, "\n".join(map(str, range(n)))) for n in sizes], "n int, s string")
    got = {r["n"]: [(w["start_line"], w["end_line"]) for w in r["w"]] for r in rows.select("n", tx.line_windows(F.col("s"), window, overlap).alias("w")).collect()}
    for n in sizes:
        text = "\n".join(map(str, range(n)))
        assert got[n] == loop(n) == [(a, b) for a, b, _ in tx.py_line_windows(text, 1, window, overlap)]


def test_paths(spark):
    paths = {"a/b.d.ts": ".ts", ".bashrc": "", "a.b/c": "", "x.PY": ".PY", "a/.github/w.yml": ".yml", "pkg/__init__.py": ".py"}
    got = {r[0]: (r[1], r[2]) for r in spark.createDataFrame([(p,) for p in paths], "p string").select("p", tx.suffix(F.col("p")), tx.basename(F.col("p"))).collect()}
    assert got == {p: (e, p.split("/")[-1]) for p, e in paths.items()}


def test_decoded_bytes(spark):
    """As Python replaces malformed parts, on random bytes and on every kind of damage."""
    import random

    from seekstone.sources.tree import decoded

    rng = random.Random(3)
    parts = [b"a", b"\r", b"\n", b"\r\n", "é".encode(), "€".encode(), "🙂".encode(), b"\xff", b"\xc3", b"\xe2\x82", b"\xf0\x9f\x98", b"\xed\xa0\x80", b"\xc0\xaf", b"\xf4\x90\x80\x80", b"\x80", b"\xf8\x88", b""]
    rows = [(i, b"".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))) for i in range(400)] + [(1000 + i, bytes(rng.randrange(256) for _ in range(30))) for i in range(200)]
    got = {r["id"]: r["t"] for r in spark.createDataFrame(rows, "id long, b binary").select("id", tx.decoded(F.col("b")).alias("t")).collect()}
    assert got == {i: decoded(b) for i, b in rows}
