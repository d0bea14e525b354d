"""Toxicity by noisy-channel deobfuscation and a classifier on the restored text.

1. A character model (interpolated 4-grams over 28 symbols) is counted over all texts.
2. In a text, spans that may be written to deceive - symbols before or after a letter, letters
   repeated three times or more, three or more letters and symbols spaced out - become character
   lattices: a symbol may stand for letters it looks like, a run for one letter or two, a gap for
   nothing. The Viterbi path under the model, with the channel's costs, is the restored span; every
   context is kept, so it is the best one. Text outside such spans has one reading only, itself.
3. A logistic regression over words and word beginnings of the restored texts, chosen by their
   association with the label, scores each text. It is fitted on at most ``SAMPLE`` labelled
   rows; labels of held-out rows (crc32 of doc_id mod 5 is 0) are never read.

Scores use the text alone. Defined cases: null texts count as empty and get the score of a text
without features; without labels of both kinds every score is the labels' share; several labels
of a doc_id count as their largest; repeated rows get equal scores; of readings that are equally
likely the first is taken; an empty table gives an empty result. Texts are whole, and the time for
a run of characters without a blank grows with its length. Extra columns never matter.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import bound_batches, pick, slices, table, written

#: Labelled rows that the classifier is fitted on, and features that it has, at most.
SAMPLE, FEATURES = 20_000, 1024
#: Toxic texts that a feature must occur in, how much likelier it must be in toxic ones, and its least chi-square.
LEAST_TEXTS, LEAST_RATIO, LEAST_CHI = 5, 3.0, 15.0
#: Fixed values of the channel: what a character may stand for.
LOOKS_LIKE = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i", "×": "x"}
#: Natural logarithms of the channel's probabilities.
SYMBOL_COST, SYMBOL_KEPT, REPEAT_COST, GAP_COST = -1.0, -2.0, -0.5, -0.5
ORDER, SYMBOLS = 4, 32
_OTHER_LETTER = 27

_LETTER, _SYM, _GAP = r"[^\W\d_]", re.escape("".join(LOOKS_LIKE)), r"[ .\-_*]"
_EITHER = rf"(?:{_LETTER}|[{_SYM}])"
_SPACED_OUT = re.compile(rf"(?<!\S){_EITHER}(?:({_GAP}){_EITHER}(?=\1))(?:\1{_EITHER}(?=\1|[\s.,;:!?]|$))+")  # s p a c 3 d
_BESIDE = re.compile(rf"[{_SYM}](?:(?={_LETTER})|(?<={_LETTER}[{_SYM}]))")  # a symbol beside a letter
_REPEATS = re.compile(rf"({_LETTER})\1\1")  # rrrepeats
_BLANK = re.compile(r"\s")
_EDGES = ".,;:!?-_*"
_SPACED = re.compile(rf"{_LETTER}{_GAP}{_LETTER}{_GAP}|{_EITHER}(?:{_GAP}{_EITHER})+\Z")
_WORDS = re.compile(r"[^\W\d_]+")


@lru_cache(maxsize=4096)
def _symbol(ch: str) -> int:
    """0 for what isn't a letter, 1 to 26 for a-z with or without marks, else 27."""
    if not ch.isalpha():
        return 0
    base = unicodedata.normalize("NFD", ch.lower())[0]
    return ord(base) - 96 if "a" <= base <= "z" else _OTHER_LETTER


@lru_cache(maxsize=1)
def _symbol_table() -> np.ndarray:
    return np.array([_symbol(chr(c)) for c in range(0x250)] + [0, _OTHER_LETTER], np.int32)


def symbols(text: str) -> np.ndarray:
    """The symbols of a text, runs of 0 as one 0, between two 0."""
    raw = np.frombuffer(text.encode("utf-32-le"), "<u4")
    far = raw >= 0x250
    code = _symbol_table()[np.where(far, 0x250, raw)]
    if far.any():
        code[far] = [_symbol(chr(c)) for c in raw[far].tolist()]
    code = np.concatenate([[0], code, [0]]).astype(np.int32)
    keep = np.ones(len(code), bool)
    keep[1:] = (code[1:] != 0) | (code[:-1] != 0)
    return code[keep]


def count_grams(texts: DataFrame) -> np.ndarray:
    """Counts of all 4-grams of symbols over the one text column: 2**20 sums, whatever the corpus."""

    def run(batches):
        counts = np.zeros(SYMBOLS**ORDER, np.int64)
        for batch in batches:
            column = batch.column(0).to_pylist()
            for a, b in slices(column, 500_000):
                c = symbols("\n".join(t or "" for t in column[a:b]))
                c = np.concatenate([np.zeros(ORDER - 2, np.int32), c])
                grams = c[:-3] << 15 | c[1:-2] << 10 | c[2:-1] << 5 | c[3:]
                counts += np.bincount(grams, minlength=len(counts))
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int64)), pa.array(counts[seen])], names=["gram", "n"])

    sums = texts.mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    found = written(sums, "toxicity-grams").toArrow()  # at most 2**20 rows
    out = np.zeros(SYMBOLS**ORDER, np.int64)
    out[found["gram"].to_numpy()] = found["n"].to_numpy()
    return out


def character_model(counts: np.ndarray) -> np.ndarray:
    """Log probabilities of a symbol after three others, interpolated with shorter contexts."""
    p = np.full(SYMBOLS, 1.0 / SYMBOLS)
    for order in range(1, ORDER + 1):
        n = counts.reshape(-1, SYMBOLS**order).sum(axis=0).astype(float).reshape(-1, SYMBOLS)
        kinds = (n > 0).sum(axis=1, keepdims=True) + 1.0
        lower = np.broadcast_to(p.reshape(-1, SYMBOLS), (max(1, SYMBOLS ** (order - 2)), SYMBOLS)) if order > 1 else p.reshape(1, -1)
        lower = np.tile(lower, (n.shape[0] // lower.shape[0], 1))
        p = ((n + kinds * lower) / (n.sum(axis=1, keepdims=True) + kinds)).ravel()
    return np.log(p).astype(np.float32)


def _readings(s: str, i: int, run: int, spaced: bool) -> list[tuple[str, int, int, float]]:
    """What the characters from i may stand for: (letters, how often, next place, cost). ``run`` is
    where the equal characters from i end."""
    ch = s[i]
    out: list[tuple[str, int, int, float]] = []
    if ch.isalpha():
        out.append((ch, 1, i + 1, 0.0))
        if run > i + 1:
            out.append((ch, 1, run, REPEAT_COST))
        if run > i + 2:
            out.append((ch * 2, 1, run, REPEAT_COST))
        return out
    for letter in LOOKS_LIKE.get(ch, ""):
        out.append((letter, 1, i + 1, SYMBOL_COST))
        if run > i + 1:
            out.append((letter, 1, run, SYMBOL_COST + REPEAT_COST))
    if spaced and ch in " .-_*":
        out.append(("", 1, i + 1, GAP_COST))
    kept = ch if ch.isdecimal() or not ch.isalnum() else " "
    out.append((kept, 1, i + 1, SYMBOL_KEPT if out else 0.0))
    if run > i + 1 and ch in LOOKS_LIKE:  # !!! or 000 is kept as one
        out.append((kept, run - i, run, SYMBOL_KEPT + REPEAT_COST))
    return out


def _edges(s: str, i: int, spaced: bool) -> list[tuple[str, int, float]]:
    """As :func:`_readings`, spelled out: (letters, next place, cost)."""
    return [(letters * times, nxt, cost) for letters, times, nxt, cost in _readings(s, i, _run_ends(s)[i], spaced)]


def _run_ends(s: str) -> list[int]:
    """For every place, where the equal characters from it end."""
    out = [len(s)] * len(s)
    for i in range(len(s) - 2, -1, -1):
        out[i] = out[i + 1] if s[i] == s[i + 1] else i + 1
    return out


#: Places after which the path that all readings share so far is given out.
_FLUSH = 4096


def _shared_path(paths: list[tuple]) -> list[tuple[str, int]]:
    """The parts (letters, how often) that all paths, (rest, part) down to (), begin with."""
    first = []
    path = paths[0]
    while path:
        first.append(path)
        path = path[0]
    at = {id(node): len(first) - i for i, node in enumerate(first)}
    common = len(first)
    for path in paths[1:]:
        while path and id(path) not in at:
            path = path[0]
        common = min(common, at[id(path)] if path else 0)
    return [node[1] for node in reversed(first)][:common]


def _without(path: tuple, n: int) -> tuple:
    """The path without its first n parts."""
    parts = []
    while path:
        parts.append(path[1])
        path = path[0]
    out: tuple = ()
    for part in reversed(parts[: len(parts) - n]):
        out = (out, part)
    return out


def restore(span: str, model: np.ndarray) -> str:
    """The likeliest reading of a span (lower case) by Viterbi search over all contexts.

    In long spans, what all live paths begin with is given out from time to time, so memory follows
    the part that is still open.
    """
    spaced, look, ends_at = bool(_SPACED.match(span)), memoryview(model), _run_ends(span)
    states: dict[int, dict[int, tuple[float, tuple]]] = {0: {0: (0.0, ())}}
    done: list[tuple[str, int]] = []
    for i in range(len(span)):
        here = states.pop(i, None)
        if not here:
            continue
        if i % _FLUSH == 0 and i and not states and (begun := _shared_path([path for _, path in here.values()])):
            done += begun
            here = {c: (score, _without(path, len(begun))) for c, (score, path) in here.items()}
        for letters, times, nxt, cost in _readings(span, i, ends_at[i], spaced):
            codes = [_symbol(c) for c in letters]  # what is kept more than once is no letter
            into = states.setdefault(nxt, {})
            for context, (score, path) in here.items():
                score += cost
                for c in codes:
                    if c or context & 31:  # a second 0 in a row costs nothing
                        score += look[context << 5 | c]
                        context = (context << 5 | c) & 0x7FFF
                old = into.get(context)
                if old is None or score > old[0]:
                    into[context] = (score, (path, (letters, times)))
    ends = [(score + (look[context << 5] if context & 31 else 0.0), path) for context, (score, path) in states[len(span)].items()] if span else [(0.0, ())]
    _, path = max(ends, key=lambda x: x[0])
    parts = []
    while path:
        path, part = path
        parts.append(part)
    return "".join(letters * times for letters, times in [*done, *reversed(parts)])


def doubtful(text: str) -> list[tuple[int, int, bool]]:
    """begin, end and whether it is spaced out of every span of a text (lower case) that may be
    written to deceive. Three searches go through the text once each."""
    out, at = [], 0
    searches = [_SPACED_OUT, _BESIDE, _REPEATS]
    ahead = [r.search(text) for r in searches]
    while any(ahead):
        spaced, *cores = ahead
        core = min((m.start() for m in cores if m), default=None)
        if core is not None:
            begin = core
            while begin > at and not text[begin - 1].isspace():
                begin -= 1
        if spaced and (core is None or spaced.start() <= begin):
            out.append((*spaced.span(), True))
            at = spaced.end()
            while at < len(text) and not text[at].isspace() and text[at - 1] not in _EDGES:  # what follows begins after a mark
                at += 1
        else:
            end = _BLANK.search(text, core)
            out.append((begin, end.start() if end else len(text), False))
            at = out[-1][1]
        ahead = [r.search(text, at) if m and m.start() < at else m for r, m in zip(searches, ahead)]
    return out


#: Restored spans of up to so many characters are kept for the next time, and so many of them.
_KEPT_LENGTH, _KEPT = 256, 50_000


def restored(text: str | None, model: np.ndarray, cache: dict[str, str] | None = None) -> str:
    """The text in lower case with every doubtful span restored."""
    cache, text = {} if cache is None else cache, (text or "").lower()
    parts, at = [], 0
    for begin, end, spaced in doubtful(text):
        span = text[begin:end]
        if spaced and not _WORDS.search(span):  # 1 2 3 holds no word
            continue
        found = cache.get(span)
        if found is None:
            found = restore(span, model)
            if len(span) <= _KEPT_LENGTH:
                if len(cache) >= _KEPT:
                    cache.clear()
                cache[span] = found
        parts += [text[at:begin], found]
        at = end
    return "".join([*parts, text[at:]])


def features(text: str) -> set[str]:
    """Words of a restored text and their beginnings of 4 and 5 letters."""
    words = set(_WORDS.findall(text))
    return words | {"4 " + w[:4] for w in words if len(w) > 4} | {"5 " + w[:5] for w in words if len(w) > 5}


def weight_of(count: int) -> float:
    """What a feature that a text has so often counts."""
    return 1.0 + math.log(count)


class Scorer:
    """Restores texts and scores them; what the workers share."""

    def __init__(self, model: np.ndarray, weights: dict[str, float], bias: float):
        self.model, self.bias, self.weights, self.cache = model, bias, weights, {}
        self.words = {k for k in weights if k[1:2] != " "}
        self.four = {k[2:] for k in weights if k[:2] == "4 "}
        self.five = {k[2:] for k in weights if k[:2] == "5 "}

    def hits_in(self, text: str) -> dict[str, int]:
        """How often a restored text has each feature of the classifier."""
        words = _WORDS.findall(text)
        kinds = set(words)
        four = {w for w in kinds if len(w) > 4 and w[:4] in self.four}
        five = {w for w in kinds if len(w) > 5 and w[:5] in self.five}
        found = (kinds & self.words) | four | five
        if not found:
            return {}
        out: Counter = Counter()
        for w, n in Counter(w for w in words if w in found).items():
            if w in self.words:
                out[w] += n
            if w in four:
                out["4 " + w[:4]] += n
            if w in five:
                out["5 " + w[:5]] += n
        return dict(out)

    def hits(self, text: str | None) -> dict[str, int]:
        return self.hits_in(restored(text, self.model, self.cache))

    def score_of(self, hits: dict[str, int]) -> float:
        z = self.bias + math.fsum(self.weights[h] * weight_of(n) for h, n in hits.items())
        return 1 / (1 + math.exp(-min(max(z, -700.0), 700.0)))

    def score(self, text: str | None) -> float:
        return self.score_of(self.hits(text))


def fit(rows: list[list[tuple[int, float]]], labels: np.ndarray, n: int, penalty: float = 1e-5, steps: int = 600) -> tuple[np.ndarray, float]:
    """Logistic regression over sparse rows of (feature number, value), by Adam over all rows."""
    cols = np.fromiter((c for r in rows for c, _ in r), np.int64)
    values = np.fromiter((v for r in rows for _, v in r), np.float64)
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    w, b = np.zeros(n), math.log((labels.sum() + 0.5) / (len(labels) - labels.sum() + 0.5))
    m, v = np.zeros(n + 1), np.zeros(n + 1)
    for t in range(1, steps + 1):
        z = b + np.bincount(owner, w[cols] * values, len(rows))
        err = (1 / (1 + np.exp(-np.clip(z, -50, 50))) - labels) / len(rows)
        grad = np.append(np.bincount(cols, err[owner] * values, n) + penalty * w, err.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        step = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        w, b = w - step[:-1], b - step[-1]
    return w, float(b)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Scorer:
    """A scorer from docs (doc_id, text) and labels (doc_id, label 0 or 1; training rows only)."""
    spark = docs.sparkSession
    model = character_model(count_grams(docs.select("text")))
    shared = spark.sparkContext.broadcast(model)  # 4 MB, whatever the corpus
    told = labels.where("label in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("label").alias("label"))
    told = told.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    told = written(told, "toxicity-labels")  # at most ``sample`` rows of 12 bytes
    right = F.broadcast(told.withColumnRenamed("doc_id", "__id"))
    rows = docs.join(right, F.col("doc_id") == F.col("__id")).select("text", "label")

    def restore_rows(batches):
        cache: dict[str, str] = {}
        for batch in batches:
            texts = [restored(t, shared.value, cache) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(texts), batch.column(1)], names=["text", "label"])

    ready = written(rows.mapInArrow(restore_rows, "text string, label int"), "toxicity-sample")
    n, positive = ready.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    if not 0 < positive < n:
        share = (positive + 0.5) / (n + 1.0)
        return Scorer(model, {}, math.log(share / (1 - share)))

    def count(batches):
        seen: tuple[Counter, Counter] = Counter(), Counter()

        def out():
            names = [*{*seen[0], *seen[1]}]
            return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([c[x] for x in names], pa.int64()) for c in seen)], names=["feature", "clean", "toxic"])

        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                seen[label].update(features(text))
            if len(seen[0]) + len(seen[1]) > 400_000:
                yield out()
                seen[0].clear()
                seen[1].clear()
        yield out()

    sums = ready.mapInArrow(count, "feature string, clean long, toxic long").groupBy("feature").agg(F.sum("clean").alias("a"), F.sum("toxic").alias("b"))
    n0, n1 = n - positive, positive
    ratio = (F.col("b") + 0.5) / (n1 + 1.0) / ((F.col("a") + 0.5) / (n0 + 1.0))
    total = F.col("a") + F.col("b")
    chi = n * F.pow(F.col("b") * n0 - F.col("a") * n1, F.lit(2)) / (total * (n - total) * n0 * n1)
    chosen = sums.where((F.col("b") >= LEAST_TEXTS) & (total < n)).where((ratio >= LEAST_RATIO) & (chi >= LEAST_CHI)).orderBy(chi.desc(), "feature").limit(FEATURES)
    names = [r["feature"] for r in chosen.select("feature").collect()]  # at most FEATURES rows
    at = {f: i for i, f in enumerate(names)}

    blank = Scorer(model, dict.fromkeys(names, 0.0), 0.0)
    knobs = spark.sparkContext.broadcast((blank.model, blank.weights))

    def vectors(batches):
        own = Scorer(*knobs.value, 0.0)
        for batch in batches:
            found = [sorted((at[f], k) for f, k in own.hits_in(t).items()) for t in batch.column(0).to_pylist()]
            feature = pa.array([[f for f, _ in x] for x in found], pa.list_(pa.int32()))
            count = pa.array([[k for _, k in x] for x in found], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([feature, count, batch.column(1)], names=["f", "k", "label"])

    data = ready.mapInArrow(vectors, "f array<int>, k array<int>, label int").toArrow()  # at most ``sample`` rows
    data = sorted(zip(data["f"].to_pylist(), data["k"].to_pylist(), data["label"].to_pylist()))  # the same order in every run
    rows_ = [[(f, weight_of(k)) for f, k in zip(fs, ks)] for fs, ks, _ in data]
    w, b = fit(rows_, np.array([y for _, _, y in data], float), len(names))
    return Scorer(model, dict(zip(names, w.tolist())), b)


def score(df: DataFrame, scorer: Scorer, column: str = "text") -> DataFrame:
    """The other columns of df with score (0 to 1) and hits (the features found)."""
    keep = [f for f in df.schema.fields if f.name != column]
    shared = df.sparkSession.sparkContext.broadcast((scorer.model, scorer.weights, scorer.bias))

    def run(batches):
        own = Scorer(*shared.value)
        for batch in batches:
            hits = [own.hits(t) for t in batch.column(batch.schema.get_field_index(column)).to_pylist()]
            p = [own.score_of(x) for x in hits]
            cols = [batch.column(batch.schema.get_field_index(f.name)) for f in keep]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(p, pa.float64()), pa.array([sorted(x) for x in hits], pa.list_(pa.string()))], names=[*[f.name for f in keep], "score", "hits"])

    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in keep)
    return df.mapInArrow(run, kept + "score double, hits array<string>")


def held_out():
    """crc32 of the doc_id as text, mod 5, is 0; a null doc_id counts as empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    docs = pick(table(spark, sf_dir, "documents"), "doc_id long", "text string")
    labels = pick(table(spark, sf_dir, "labels"), "doc_id long", "toxic int").where(~held_out()).select("doc_id", F.col("toxic").alias("label"))
    out = score(docs.withColumn("held_out", held_out()), train(docs, labels))
    return out.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.array_join("hits", ",").alias("hits"))


QUERIES = {"op2_toxicity": op2_toxicity}
ORACLE: dict[str, str] = {}
