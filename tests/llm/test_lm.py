import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from seekstone.llm import lm
from seekstone.llm._hashing import mix64, word_hashes

from .common import awkward, awkward_rows, docs, empty, words

END = "</s>"


def tokens(t):
    return [*(t or "").encode().lower().split(), END]


class Brute:
    """The model by dictionaries."""

    def __init__(self, texts):
        data = [tokens(t) for t in texts]
        self.c = Counter(w for d in data for w in d)
        self.pairs = Counter(p for d in data for p in zip([END, *d], d))
        self.total, self.kinds = sum(self.c.values()), len(self.c)
        of = lambda counts: [0.0, *lm.discounts(*[sum(v == k for v in counts) for k in (1, 2, 3, 4)])]
        self.d = of(self.pairs.values())
        self.before, self.after = Counter(w for _, w in self.pairs), defaultdict(Counter)
        for (p, _), n in self.pairs.items():
            self.after[p][min(n, 3)] += 1
        self.d1 = of(self.before.values())
        self.left = sum(self.d1[min(v, 3)] for v in self.before.values()) / max(len(self.pairs), 1)

    def low(self, w):
        if not self.total:
            return 1.0
        n = self.before[w]
        return (n - self.d1[min(n, 3)]) / len(self.pairs) + self.left / (self.kinds + 1)

    def p(self, before, w):
        if not self.c[before]:
            return self.low(w)
        n = self.pairs[before, w]
        gamma = sum(self.d[k] * m for k, m in self.after[before].items()) / self.c[before]
        return (n - self.d[min(n, 3)]) / self.c[before] + gamma * self.low(w)


def check(spark, rows):
    df = docs(spark, rows)
    out = df.withColumn("held_out", lm.held_out("doc_id", 1)).select("doc_id", "text", "held_out")
    spec = lm.train(out.where("not held_out"))
    got = {r["doc_id"]: r for r in lm.score(out, spec).collect()}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i, _ in rows}
    m = Brute([t for i, t in rows if not held[i]])
    for i, t in rows:
        d, r = tokens(t), got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(d), sum(m.c[w] > 0 for w in d), m.total)
        assert r["base_score"] == pytest.approx(sum(math.log10((m.c[w] + 0.5) / (m.total + 0.5 * (m.kinds + 1))) for w in d))
        assert r["score"] == pytest.approx(sum(math.log10(m.p(a, b)) for a, b in zip([END, *d], d)))
    return m, got


def test_brute_force(spark):
    rows = [(i, " ".join(f"{'Aa'[k % 2]}{(k * k + i * 7) % (5 + i % 23)}" for k in range(i % 37))) for i in range(150)]
    rows += [(900, None), (901, ""), (902, "never seen words"), (903, "é 🙂 \v x\fy")]
    m, got = check(spark, rows)
    for before in ("unseen", END, next(iter(m.c))):
        assert sum(m.p(before, w) for w in m.c) + m.p(before, "unseen word") == pytest.approx(1)


def test_held_out_perplexity(spark):
    """Texts of a few phrases: the bigram model beats unigrams on those it didn't learn from."""
    phrases = ["the cat sat on the mat", "a dog ran over the hill", "some birds sing at dawn", "rain falls on the roof"]
    _, got = check(spark, [(i, " ".join(phrases[(i * 7 + k * k) % 4] for k in range(1 + i % 6))) for i in range(200)])
    held = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > 0.5 * sum(r["base_score"] for r in held) and all(r["perplexity"] < 10 for r in held)


def test_hashes():
    x = np.arange(1000, dtype=np.uint64) * np.uint64(0x123456789ABCDEF)
    assert (lm._unmix(mix64(x)) == x).all()
    texts = [b"", b"one  two\tone", b"\n", "é\x0bone".encode(), b"x" * 70_000, b"two " * 40_000]
    h, n = word_hashes(texts)
    w = [p for t in texts for p in t.split()]
    assert n.tolist() == [len(t.split()) for t in texts] and len(h) == len(w)
    by = {}
    for a, b in zip(w, h.tolist()):
        assert by.setdefault(a, b) == b
    assert len(set(by.values())) == len(by)


def test_awkward(spark):
    df = awkward(spark)
    base = lm.pick(df, "doc_id long", "text string")
    spec = lm.train(base)
    got = lm.score(base, spec)
    assert got.count() == len(awkward_rows()) and spec["tokens"] == sum(len(tokens(r[1])) for r in awkward_rows())
    nothing = lm.train(lm.pick(empty(spark), "doc_id long", "text string"))
    assert [(r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in lm.score(docs(spark, [(1, words(1, 5))]).select("doc_id", "text"), nothing).collect()] == [(0, 0, 0.0, 0.0)]
    assert lm.score(lm.pick(empty(spark), "doc_id long", "text string"), spec).count() == 0
