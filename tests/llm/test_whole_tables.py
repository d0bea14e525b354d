"""Queries without SQL over the whole of the smallest tables, row by row against plain Python."""

import base64
import hashlib
import os
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pyarrow.parquet as pq
import pytest
import tiktoken

from seekstone import llm

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def documents():
    return pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text", "source"]).to_pylist()


def test_op8(spark, documents):
    """Every document's ids as the tiktoken library has them, and its bytes again."""
    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    own = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = {}
    for d in documents:
        ids = own.encode_ordinary(d["text"] or "")
        want[d["doc_id"]] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((d["text"] or "").encode()).hexdigest())
    got = {r["doc_id"]: (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in llm.queries()["op8_bpe"](spark, SF).collect()}
    assert got == want


def test_op10(spark, documents):
    """Every payload's length, digest and checksum; equal texts, equal values in all columns."""
    want = {}
    for d in documents:
        raw = (d["text"] or "").encode()
        full = raw + b"\xff" * (-len(raw) % 576 or (0 if raw else 576))
        want[d["doc_id"]] = (len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-32:]))
    rows = llm.queries()["op10_gif"](spark, SF).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in rows} == want
    seen = defaultdict(set)
    text = {d["doc_id"]: d["text"] for d in documents}
    for r in rows:
        seen[text[r["doc_id"]]].add((r["media_bytes"], r["media_sha256"], r["feature"]))
    assert len(rows) == len(documents) and all(len(v) == 1 for v in seen.values())


def test_op1(spark, documents):
    """Sizes and targets by a plain loop; what is taken meets each source's target, and no document gives more than twice its words."""
    size = {d["doc_id"]: len(re.findall(r"[^\x20\x09-\x0D]+", d["text"] or "")) for d in documents}
    total = Counter()
    for d in documents:
        total[d["source"]] += size[d["doc_id"]]
    order = sorted(total, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, left = {}, 1.5 * sum(total.values())
    while True:
        free = [s for s in order if s not in target]
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 2 * total[s]]
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 2.0 * total[s]
            left -= target[s]
    rows = llm.queries()["op1_mix"](spark, SF).collect()
    source = {d["doc_id"]: d["source"] for d in documents}
    assert {r["doc_id"]: (r["size"], r["source_size"]) for r in rows} == {i: (n, total[source[i]]) for i, n in size.items()}
    assert all(abs(r["target"] - target[source[r["doc_id"]]]) < 1e-6 * max(1, r["target"]) for r in rows)
    taken = Counter()
    for r in rows:
        taken[source[r["doc_id"]]] += r["taken"]
        assert 0 <= r["taken"] <= 2 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0)
    largest = {s: max(size[i] for i in size if source[i] == s) for s in order}
    assert all(abs(taken[s] - target[s]) <= 2 * largest[s] for s in order)
    assert {r["doc_id"]: r["taken"] for r in llm.queries()["op1_mix"](spark, SF).collect()} == {r["doc_id"]: r["taken"] for r in rows}
