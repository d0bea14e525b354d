import os

from seekstone.config import Settings
from seekstone.sources.ignore import IgnoreRules
from seekstone.sources.tree import decoded, list_files, read_tree


def make(top, files):
    for path, content in files.items():
        os.makedirs(os.path.dirname(top / path), exist_ok=True)
        (top / path).write_bytes(content if isinstance(content, bytes) else content.encode())


def test_rules():
    def ignored(text, *paths):
        rules = IgnoreRules(text)
        return [rules.ignores(p) for p in paths]

    assert ignored("*.log\n!keep.log", "a.log", "d/a.log", "d/keep.log") == [True, True, False]
    assert ignored("scratch/", "scratch/a.py", "x/scratch/a.py", "scratch") == [True, True, False]
    assert ignored("/top.txt\nsub/one.txt", "top.txt", "a/top.txt", "sub/one.txt", "a/sub/one.txt") == [True, False, True, False]
    assert ignored("a/**/z\n**/y\nq/**", "a/z", "a/b/c/z", "k/y", "q/r/s", "q") == [True, True, True, True, False]
    assert ignored("# no\n\n\\#yes\nf?o[ab]\n[!x]z", "#yes", "fxoa", "fxoc", "yz", "xz") == [True, True, False, True, False]


def test_tree(spark, tmp_path):
    make(tmp_path, {
        "src/main.py": "x", "pkg/__init__.py": "", ".github/w.yml": "y", "notes.txt": "n", "a.PY": "p", "nul.txt": b"a\0b",
        "logo.png": b"\x89PNG\0", "node_modules/lib.js": "j", "build/out.js": "j", "scratch/temp.py": "t", "sub/.gitignore": "*\n", "sub/kept.txt": "k", ".gitignore": "scratch/\n*.log\n!keep.log\n", "a.log": "l", "keep.log": "k", "bad.txt": b"\xff\r\nz\r",
    })
    got = {r["file_path"]: r for r in read_tree(spark, str(tmp_path)).collect()}
    assert set(got) == {"src/main.py", "pkg/__init__.py", ".github/w.yml", "notes.txt", "a.PY", "sub/.gitignore", "sub/kept.txt", ".gitignore", "keep.log", "bad.txt"}
    assert got["a.PY"]["ext"] == ".PY" and bytes(got["pkg/__init__.py"]["content"]) == b""
    assert decoded(bytes(got["bad.txt"]["content"])) == "�\nz\n"
    assert not any(p.startswith("src/") for p, _ in list_files(str(tmp_path), Settings(excluded_dirs=("src",))))


def test_ignore_column_equals_the_rules(spark):
    """The Column form decides as the rules of single paths do."""
    from pyspark.sql import functions as F

    from seekstone.sources.ignore import IgnoreRules

    text = "# c\n\n*.log\n!keep.log\n/top\nbuild/\ndoc/*.txt\n**/x/**\na/**/z\n[ab]?.c\n[!a-c].d\nsp\\ ace \n\\#hash\n!build/in.txt\nq&&r\n"
    parts = ["a", "b", "top", "build", "doc", "x", "z", "keep.log", "d.log", "t.txt", "in.txt", "ax.c", "c1.c", "e.d", "b.d", "sp ace", "#hash", "q&&r", ".git", "új"]
    paths = sorted({"/".join(p) for p in [(i, j, k)[:n] for i in parts for j in parts for k in parts[:9] for n in (1, 2, 3)]})
    rules = IgnoreRules(text)
    rows = spark.createDataFrame([(p,) for p in paths], "path string").select("path", rules.column(F.col("path")).alias("gone")).collect()
    assert {r["path"]: r["gone"] for r in rows} == {p: rules.ignores(p) for p in paths} and len({r["gone"] for r in rows}) == 2
