import base64
import random

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken

from seekstone.llm import bpe

from .common import awkward, empty

RAW = open(P.path("byte_bpe_50k.tiktoken"), "rb").read()


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in RAW.splitlines())}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_as_tiktoken(library):
    rng = random.Random(1)
    texts = ["", None, "a" * 3000, "aaaa " * 30, "\x00ÿ　é" * 20, "  \n\n x", "日本語テキスト" * 9, "<|endoftext|> I'll 123 !!!???"]
    texts += ["".join(rng.choice("abcdeth ERt\n é日🙂0'") for _ in range(rng.randint(0, 200))) for _ in range(300)]
    codec = bpe.Codec(RAW, P.PATTERN)
    for t, ids in zip(texts, codec.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(t or "") and codec.decode(ids) == (t or "").encode()
    for piece in (b"\xff\xfe", b"hello world" * 9, bytes(range(256))):
        assert codec.merge_one(piece) == library._encode_single_piece(piece)


def test_long_text_in_parts(library, monkeypatch):
    monkeypatch.setattr(bpe, "LONG_TEXT", 50)
    monkeypatch.setattr(bpe, "LONG_PIECES", 3)
    monkeypatch.setattr(bpe, "CACHE", 4)
    t = "Some words of a text that is long enough, and then some more words.  "
    assert [np.frombuffer(x, "<u4").tolist() for x in bpe.Codec(RAW, P.PATTERN).encode([t, "x", t])] == [library.encode_ordinary(x) for x in (t, "x", t)]


def test_errors():
    codec = bpe.Codec(RAW, P.PATTERN)
    with pytest.raises(ValueError):
        codec.decode(b"\xff\xff\xff\xff")
    with pytest.raises(ValueError):
        codec.decode(b"\0")


def test_awkward(spark, library):
    import hashlib

    df = awkward(spark)
    got = bpe.digests(df).collect()
    want = sorted((r[0] is None, r[0] or 0, hashlib.sha256((r[1] or "").encode()).hexdigest(), len(library.encode_ordinary(r[1] or ""))) for r in df.collect())
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["decoded_sha256"], r["n_tokens"]) for r in got) == want
    out = bpe.stage(spark, df, "")
    assert out.columns == [*df.columns, "ids", "n_tokens"] and out.count() == df.count() and bpe.digests(empty(spark)).count() == 0


def test_columns_that_clash(spark, library):
    """Columns whose names differ from the results' in case only stay; those of just these names are replaced."""
    df = spark.createDataFrame([(1, "some text", "i", "n", "x"), (2, None, "j", "m", "y")], "doc_id long, text string, IDS string, N_TOKENS string, ids string")
    out = bpe.stage(spark, df, "")
    assert out.columns == ["doc_id", "text", "IDS", "N_TOKENS", "ids", "n_tokens"]
    rows = {r[0]: r for r in out.collect()}
    assert (rows[1][2], rows[1][3], rows[2][2], rows[2][3]) == ("i", "n", "j", "m")
    assert np.frombuffer(rows[1][4], "<u4").tolist() == library.encode_ordinary("some text") and rows[1][5] == len(rows[1][4]) // 4 and rows[2][5] == 0


def test_stage_by_brute_force(spark, library):
    """The stage's whole rows against the library: ids, counts and every other column."""
    df = awkward(spark)
    got = sorted((str(tuple(r)[:-2]), bytes(r["ids"]), r["n_tokens"]) for r in bpe.stage(spark, df, "").collect())
    assert got == sorted((str(tuple(r)), (x := np.array(library.encode_ordinary(r[1] or ""), "<u4")).tobytes(), len(x)) for r in df.collect())
