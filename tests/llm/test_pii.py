import hashlib
import random
import re

import numpy as np
from pyspark.sql import functions as F

from seekstone.llm import pii

from .common import awkward, awkward_rows, docs, empty

E = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
I = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")  # noqa: E741
C = re.compile(r"[0-9]([\x20-]?[0-9])+")
P = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def digits(x):
    return re.sub("[^0-9]", "", x)


def luhn(d):
    return sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(reversed(d))) % 10 == 0


def base(t):
    spans = [[m.span() for m in E.finditer(t)], [m.span() for m in I.finditer(t) if all(int(x) <= 255 for x in m.group().split("."))]]
    spans.append([m.span() for m in C.finditer(t) if 13 <= len(digits(m.group())) <= 19 and luhn(digits(m.group()))])
    spans.append([m.span() for m in P.finditer(t) if 9 <= len(digits(m.group())) <= 15])
    return ",".join(f"{k}:{a}:{b}" for k, x in zip(pii.KINDS, spans) for a, b in x)


TEXTS = [
    "", "a@b.co_d@e.fr x..y@z.co.uk.", "@@a@b @c.d a@b@c.de", "🙂 é a+b@c-d.ef, q", "1.2.3.4.5.6 300.1.1.1 01.002.0003.255 1.2.3 9.9.9.9.", "4111 1111 1111 1111 and 4111-1111-1111-1112 5500000000000004x",
    "4111  1111 1111 1111", "12 34", "+1 (499) 555-6503 +44 20 7946 0958. +1 +12345678901234567 +1((((5", "1 2 3 4 5 6 7 8 9 0 " * 30, "a" * 5000 + "@" + "b" * 5000, "1" * 4000 + ".1.1.1", "x\x01y 4111\x014111 4111 1111 1111 1111",
    " ".join(f"u{i}@h{i}.com" for i in range(300)),
]


def test_base_spans(spark):
    rng = random.Random(3)
    rows = list(enumerate(TEXTS + ["".join(rng.choice("a1.@+- 5(4é") for _ in range(rng.randint(0, 80))) for _ in range(400)]))
    found = docs(spark, rows).select("doc_id", pii._joined(pii.base_spans(F.col("text"))).alias("s")).collect()
    assert {r["doc_id"]: r["s"] for r in found} == {i: base(t) for i, t in rows}


def test_contexts_find_identifiers(spark):
    """E-mail addresses after "reach me" teach a pattern that finds an address in another form."""
    rng = random.Random(4)
    rows = [(i, f"word{i} text please reach me user{i}@host{i}.com or not") for i in range(40)]
    rows += [(100, "some words then please reach me user77(at)host9 for more"), (101, "the room 12345 is free"), (102, " ".join(str(rng.randint(0, 99)) for _ in range(30)))]
    got = {r["doc_id"]: r for r in pii.find(docs(spark, rows)).select("doc_id", pii._joined(F.col("all")).alias("spans")).collect()}
    text = dict(rows)
    assert [text[100][int(a) : int(b)] for k, a, b in (x.split(":") for x in got[100]["spans"].split(","))] == ["user77(at)host9"]
    assert all(got[i]["spans"] == base(t) for i, t in rows if i != 100)


def found_ids(spark, rows):
    got = pii.find(docs(spark, rows)).select("doc_id", pii._joined(F.col("all")).alias("spans")).collect()
    text = dict(rows)
    return {text[r["doc_id"]][int(a) : int(b)] for r in got for k, a, b in (x.split(":") for x in r["spans"].split(",") if x) if k == "id"}


def test_contexts_with_unseen_values(spark):
    """A third of a context's values has no known kind: all are found; so are two beside five entities."""
    for known, unseen in ((20, 10), (6, 3), (5, 2)):
        rows = [(i, f"word{i} text please reach me user{i}@host{i}.com or not") for i in range(known)]
        rows += [(100 + i, f"other{i} words please reach me user{i}(at)host{i} or not") for i in range(unseen)]
        assert found_ids(spark, rows) == {f"user{i}(at)host{i}" for i in range(unseen)}


def test_very_many_labels(spark):
    """An address with very many labels neither kills the JVM nor is cut; nor does a very long word."""
    text = "x a@" + ".".join("b" for _ in range(100_000)) + " and " + "9" * 4_000 + ".1.1.1"
    rows = [(1, text), (2, "c" * 300_000 + "@d.e"), (3, "f@g.h" * 20_000)]
    found = pii.find(docs(spark, rows)).select("doc_id", pii._joined(F.col("base")).alias("s")).collect()
    assert {r["doc_id"]: r["s"] for r in found} == {i: base(t) for i, t in rows}


def test_secrets_in_a_learned_context(spark):
    """Tokens of a secret's shape are found where their context is common to several, and so is
    another value there; elsewhere the shape alone is nothing. Long words of a context count whole."""
    rng = random.Random(9)
    key = lambda n=40: "".join(rng.choice("0123456789abcdef") for _ in range(n - 2)) + "a1"
    keys = {i: key() for i in range(8)}
    rows = [(i, f'some{i} words token = "{k}" more') for i, k in keys.items()] + [(100, 'other words token = "hunter-2-hunter" end'), (101, f"a checksum is {key()} here"), (102, f"revision {key()} there")]
    long = "w" * 300
    rows += [(200 + i, f"{long}x is {long}y user{i}@host{i}.com") for i in range(8)] + [(300, f"{long}x is {long}y user99(at)h"), (301, f"{long}z is {'w' * 299}zy user98(at)h")]
    got = {r["doc_id"]: r["spans"] for r in pii.find(docs(spark, rows)).select("doc_id", pii._joined(F.col("all")).alias("spans")).collect()}
    text = dict(rows)
    told = {i: [(k, text[i][int(a) : int(b)]) for k, a, b in (x.split(":") for x in s.split(",") if x)] for i, s in got.items()}
    assert all(told[i] == [("secret", k)] for i, k in keys.items()) and told[100] == [("secret", "hunter-2-hunter")]
    assert told[101] == told[102] == told[301] == [] and told[300] == [("id", "user99(at)h")]


def modelled(rows):
    """The bootstrap's rounds over instances (doc, start, end, value, kind, patterns), in plain Python."""
    edges = [(d, s, e, v, k, p) for d, s, e, v, k, ps in rows for p in ps]
    scores = {}
    for step in range(pii.ROUNDS):
        weight, kind, docs_ = {}, {}, {}
        for d, s, e, v, k, p in edges:
            w, own = (1.0 if k is not None else 0.0), k
            if v in scores:
                w, own = max(w, scores[v][0]), k if k is not None else scores[v][1]
            weight[p, v] = max(weight.get((p, v), 0.0), w)
            if own is not None:
                kind[p, v] = max(kind.get((p, v), -1), own)
            docs_.setdefault(p, set()).add(d)
        sure = {}
        for p in {p for p, _ in weight}:
            values = [v for q, v in weight if q == p]
            sums = [sum(weight[p, v] for v in values if kind.get((p, v)) == k) for k in range(len(pii.SEEDS))]
            best = max(sums)
            confidence = best / (sum(sums) + pii.UNSEEN * (len(values) - sum(sums)) + 1)
            if best >= pii.LEAST_VALUES and confidence >= pii.LEAST_CONFIDENCE and len(docs_[p]) > 1:
                sure[p] = (confidence, sums.index(best))
        hits = [x for x in edges if (x[4] is None or x[4] >= len(pii.KINDS)) and x[5] in sure]
        if step == pii.ROUNDS - 1 or not sure:
            break
        scores = {}
        for v in {x[3] for x in hits}:
            own = {x[5] for x in hits if x[3] == v}
            s = 1 - np.prod([1 - min(sure[p][0], 0.999) for p in own])
            if s >= pii.LEAST_SCORE:
                scores[v] = (s, max(sure[p][1] for p in own))
    out = {}
    for d, s, e, v, k, p in hits:
        out.setdefault((d, s, e), []).append(sure[p])
    return {key: 5 if max(k for _, k in x) >= len(pii.KINDS) else 4 for key, x in out.items() if 1 - np.prod([1 - min(c, 0.999) for c, _ in x]) >= pii.LEAST_SCORE}


def test_rounds_by_a_plain_model(spark):
    rng = random.Random(11)
    verbs, rows = ["call", "reach", "mail", "ask"], []
    for i in range(400):
        parts = []
        for _ in range(rng.randint(1, 3)):
            who = rng.choice(verbs)
            mail = rng.random() < {"call": 0.1, "reach": 0.9, "mail": 0.97, "ask": 0.7}[who]
            parts.append(f"{who} {rng.choice('ab')} me {f'u{rng.randint(0, 60)}@h{rng.randint(0, 9)}.com' if mail else f'u{rng.randint(0, 60)}#h{rng.randint(0, 9)}'} {rng.choice(['now', 'then'])}")
        if rng.random() < 0.1:
            parts.append(f'key: "{rng.getrandbits(160):040x}"')
        rows.append((i, " and ".join(parts)))
    df = docs(spark, rows).select("doc_id", F.xxhash64("text").alias("text_key"), F.explode(pii.instances(F.col("text"))).alias("s")).select("doc_id", "text_key", "s.*").distinct()
    seen = [(r["doc_id"], r["start"], r["end"], r["value"], r["kind"], r["patterns"]) for r in df.collect()]
    got = {(r["doc_id"], r["start"], r["end"]): r["kind"] for r in pii.discover(df).collect()}
    assert got == modelled(seen) and set(got.values()) == {4, 5} and len(got) > 20


def test_query_columns(spark, tmp_path):
    """The query's counts, digest and spans, of the base kinds and beyond."""
    rows = [(i, f'{t} token = "{i:040x}ab" end') for i, t in enumerate(TEXTS)] + [(900, None)]
    docs(spark, rows).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in pii.op6_pii(spark, str(tmp_path)).collect()}
    for i, t in rows:
        want = base(t or "")
        r = got[i]
        kinds = [x.split(":")[0] for x in want.split(",") if x]
        assert [r[f"n_{k}"] for k in pii.KINDS] == [kinds.count(k) for k in pii.KINDS] and r["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()
        more = [x for x in r["spans"].split(",") if x and x.split(":")[0] not in pii.KINDS]
        assert [x for x in r["spans"].split(",") if x][: len(kinds)] == [x for x in want.split(",") if x]
        assert (f"secret:{len(t) - 47}:{len(t) - 5}" in more) if t else not more


def test_contexts_that_tell_nothing(spark):
    """A context in which entities are few, or whose entities are of two kinds, finds nothing."""
    rows = [(i, f"see the user{i}@host{i}.com") for i in range(10)] + [(100 + i, f"see the {40_000 + i}") for i in range(60)]
    rows += [(200 + i, f"look for that user{i}@place{i}.com") for i in range(10)] + [(300 + i, f"look for that 10.0.0.{i}") for i in range(10)] + [(400, "look for that a1b2c3d4")]
    assert found_ids(spark, rows) == set()


def test_awkward(spark):
    df = awkward(spark)
    got = pii.find(df).select("doc_id", pii._joined(F.col("base")).alias("b")).collect()
    assert sorted((str(r["doc_id"]), r["b"]) for r in got) == sorted((str(r[0]), base(r[1] or "")) for r in awkward_rows())
    assert pii.find(empty(spark)).count() == 0


def test_no_python(spark):
    plan = docs(spark, [(1, "a@b.co")]).select(pii.base_spans(F.col("text")), pii.instances(F.col("text")))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_more_keys_than_are_broadcast(spark, monkeypatch):
    """Patterns and values beyond those broadcast are met by a shuffle, with the same spans."""
    rows = [(i, f"badge number {'QX' if i % 2 else 'ZT'}{i * 7919 % 90000 + 10000} was read and mail u{i}@x{i}.org sent to user u{i}@x{i}.org by ip 10.0.{i}.{i} now") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    told = lambda: sorted(map(str, pii.find(df).collect()))
    want = told()
    for most in (0, 1):
        monkeypatch.setattr(pii, "BROADCAST_PATTERNS", most)
        assert told() == want


def test_held_back_seeds(spark):
    """Of addresses in a learned context those held back are found again, of those in none none is."""
    rows = [(i, f"word{i} text please reach me user{i}@host{i}.com or not") for i in range(60)] + [(100 + i, f"w{i} x{i} 10.1.{i}.7 y{i} z{i}") for i in range(60)]
    got = {r["kind"]: (r["held"], r["found"]) for r in pii.held_back(docs(spark, rows), 4).collect()}
    assert got["email"][0] > 5 and got["email"][1] == got["email"][0] and got["ip"][0] > 5 and got["ip"][1] == 0
    assert pii.held_back(empty(spark)).collect() == []
