import random

import pytest

from seekstone.chunkers.markdown import MarkdownChunker
from seekstone.chunkers.sections import blocks, markdown_sections
from seekstone.config import Settings

from .test_chunkers import MD

CASES = {
    "md": MD, "heading": "# Title\n\nSome content.\n", "none": "Just a paragraph.\n\nAnother paragraph.\n", "empty": "", "blank": "\n \n\t\n", "null": None,
    "preamble": "Preamble text.\n\n# First Heading\n\nBody.\n", "fence": "# Title\n\n```python\n# not a heading\ndef foo():\n    pass\n```\n## after\n",
    "open fence": "# A\n~~~\n# no\n```\n## neither\n", "long fence": "````\n```\n# no\n````\n# yes\n``` a`b\n# also\n", "inline": "# Docs\n\na heading like <h2>this</h2> inline.\n\nmore\n",
    "html": '<p align="center"><img src="l.png" /></p>\n\n<h1 align="center">My: Things</h1>\n\n<p>Tagline.</p>\n\n## Installation\n\nRun.\n', "html twice": "<h1>First</h1>\n\ntext a\n\n<h1>Second</h1>\n\ntext b\n",
    "nested": "# A\n\nintro\n\n## B\n\nb\n\n### C\n\nc\n## D\n# E\n##### F\n### G\n", "skip": "### x\n# y\n###### z\n####### no\n#no\n    # no\n   # yes ##\n#\n",
    "big": "# Top\n\n## Big\n\n" + "\n".join(f"This is sentence number {i} with a bit of filler text to pad it out nicely." for i in range(150)) + "\n", "crumbs": "# Top\n\nintro\n\n<h2>Embedded</h2>\n\nunder it\n\n## Sub\n\nsub\n",
}


def expected(cases, settings):
    own = MarkdownChunker(settings)
    return {name: [tuple(c) for c in own.chunk_file(name, text)] for name, text in cases.items() if text and own.chunk_file(name, text)}


def found(df):
    out = {}
    cols = "file_path start_line end_line symbol_name qualified_name kind code_text embed_text language truncated".split()
    for r in sorted(df.collect(), key=lambda r: (r["file_path"], r["ordinal"])):
        out.setdefault(r["file_path"], []).append(tuple(r[c] for c in cols))
    return out


@pytest.mark.parametrize("settings", [Settings(), Settings(max_chunk_tokens=20, window_lines=5, overlap_lines=2)])
def test_sections_equal_the_chunker(spark, settings):
    """The relational form against the chunker of single files, over fixed cases and random mixtures of all kinds of lines."""
    rng = random.Random(4)
    kinds = ["# a", "## b #", "### c", "text", "", " ", "```", "~~~", "````", "``` x", "<h1>T</h1>", "<h2>a <b>c</b></h2>", "<h3>", "</h3>", "#no", "more words here", "<p>p</p>"]
    cases = CASES | {f"mix{i}": "\n".join(rng.choice(kinds) for _ in range(rng.randint(1, 40))) for i in range(150)}
    rows = spark.createDataFrame(list(cases.items()), "file_path string, text string")
    assert found(markdown_sections(rows, settings)) == expected(cases, settings)


def test_sections_of_the_readme_style(spark):
    got = found(markdown_sections(spark.createDataFrame(list(CASES.items()), "file_path string, text string")))
    assert [c[4] for c in got["nested"]] == ["A", "A > B", "A > B > C", "A > D", "E", "E > F", "E > G"]
    assert [c[3] for c in got["html"]] == ["intro", "My: Things", "Installation"] and [c[4] for c in got["crumbs"]] == ["Top", "Top > Embedded", "Top > Sub"]
    assert len(got["big"]) > 2 and all(c[9] and c[4] == "Top > Big" for c in got["big"][1:]) and not {"empty", "blank", "null"} & set(got)


def test_no_python_workers(spark):
    plan = markdown_sections(spark.createDataFrame([("a", "# b")], "file_path string, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "InArrow" not in plan


def test_index_uses_sections(spark, tmp_path):
    """Markdown files of a tree are cut without Python workers, others by their chunkers; a custom factory gets all files."""
    from seekstone.chunkers.registry import chunk_files, naive_chunker
    from seekstone.sources.tree import read_tree

    (tmp_path / "a.md").write_bytes(b"# T\r\n\xff text\r## U\n")
    (tmp_path / "b.txt").write_text("x\n")
    files = read_tree(spark, str(tmp_path))
    told = {(r["file_path"], r["symbol_name"], r["code_text"]) for r in chunk_files(files).collect()}
    assert told == {("a.md", "T", "# T\n\ufffd text"), ("a.md", "U", "## U"), ("b.txt", "b.txt:window1", "x")}
    assert {r["symbol_name"] for r in chunk_files(files, factory=naive_chunker).collect()} == {"a.md:window1", "b.txt:window1"}


def test_blocks(spark):
    rows = spark.createDataFrame([(1, "a\nb\n\n\n<h1>T</h1>\n \nc"), (2, None), (3, "\n\n"), (4, "x")], "id long, text string")
    got = [(r["id"], r["ordinal"], r["start_line"], r["end_line"], r["text"], r["title"]) for r in blocks(rows, ["id"], "text").collect()]
    assert sorted(got) == [(1, 0, 1, 2, "a\nb", None), (1, 1, 5, 5, "<h1>T</h1>", "T"), (1, 2, 7, 7, "c", None), (4, 0, 1, 1, "x", None)]
