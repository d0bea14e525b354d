import re

import pytest
from pyspark.sql import functions as F

from seekstone.functions import html

PAGES = [
    "<h1>A</h1><p>x</p><H2 class='c'>B <b>bold</b></H2 >",
    "<h1>never <h2>closed</h2> once <h3>x</h2></h3>",
    "<h1>a<h1>b</h1>c</h1>",
    "<h7>no</h7><h1x>no</h1x><header>no</header><h2\n id=1>multi\nline</h2\n>",
    "text only", "", None, "<h1></h1>", "<h2> <> </h2>", "a < b > c <h3>1 < 2 <i>and</i> 3 > 2</h3>", "<h1>" * 3 + "</h1>" * 2, "</h1><h1>t</h1>",
]


def model(page):
    """By a regular expression that looks for an opening tag and the first closing one of its level."""
    out, at = [], 0
    while m := re.compile(r"<h([1-6])(?![A-Za-z0-9_])[^<>]*>", re.I).search(page or "", at):
        end = re.compile(rf"</h{m[1]}\s*>", re.I).search(page, m.end())
        if end:
            out.append((int(m[1]), re.sub("<[^>]+>", "", page[m.end() : end.start()]).strip(" ")))
        at = end.end() if end else m.end()
    return out


def test_headings(spark):
    rows = spark.createDataFrame(list(enumerate(PAGES)), "id long, page string").select("id", html.headings(F.col("page")).alias("h"))
    assert {r["id"]: [tuple(x) for x in r["h"]] for r in rows.collect()} == {i: model(p) for i, p in enumerate(PAGES)}


BLOCKS = {
    "<h1>T</h1>": "T", " <H2 align='x'>a <b>b</b></h2 >\n": "a b", "<h1>a</h1> b": None, "x <h1>a</h1>": None, "<h1>a</h2>": None, "<h1>a\nb</h1>": "a\nb",
    "<h1></h1>": None, "<h1>one</h1> and <h1>two</h1>": "one and two", "<p>a</p>": None, "": None, "plain": None, "<h1>a</h1>>": None, "<h1>a < b</h1>": "a < b", "<h1": None,
}


@pytest.mark.parametrize("block", list(BLOCKS))
def test_whole_blocks(spark, block):
    assert spark.createDataFrame([(block,)], "b string").select(html.block_title(F.col("b"))).first()[0] == BLOCKS[block]
