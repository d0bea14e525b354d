"""LM scoring: an interpolated modified Kneser-Ney bigram model of hashed words.

Counting is Spark aggregation: words by their 64-bit hashes, then bigrams by a key made of both
words' numbers (places in the sorted hashes). The model is sorted hash arrays in files of the
shared folder, in shards by the leading bits of the hash; scoring tasks map them into memory and
look whole batches up by binary search. Every count covers all training texts; what is gathered
grows with them, and only figures by shard (files, sizes, counts of counts) reach the driver.

A text's tokens are its words, A-Z lowered, and one end; the first word follows an end. Unknown
words share the unigram model's uniform part. Defined cases: null texts count as empty (one
token, the end); rows without doc_id train; without any training token every probability is 1;
repeated rows count and are scored each. Very long texts are whole. Extra columns never matter.
"""

from __future__ import annotations

import functools
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import bound_batches, new_path, pick, slices, table, written
from ._files import ArrayWriter, part
from ._hashing import mix64, word_hashes

#: Hash of the end token; shards (powers of two) of words and of bigrams.
END = np.uint64(0x9B3F_6E21_D05A_C417)
WORD_SHARDS_LOG, PAIR_SHARDS_LOG = 9, 11
#: Tokens that a counting task holds before it passes their counts on.
HELD = 4_000_000
_I64 = np.int64


def _unmix(z: np.ndarray) -> np.ndarray:
    """The inverse of mix64."""
    with np.errstate(over="ignore"):
        z = z ^ (z >> np.uint64(31)) ^ (z >> np.uint64(62))
        z = z * np.uint64(0x319642B2D24D8EC3)
        z = z ^ (z >> np.uint64(27)) ^ (z >> np.uint64(54))
        z = z * np.uint64(0x96DE1B173F119089)
        return z ^ (z >> np.uint64(30)) ^ (z >> np.uint64(60))


def tokens(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, each text's end included, and the number of tokens of each text."""
    words, counts = word_hashes([(t or "").encode().lower() for t in texts])
    ends = np.cumsum(counts + 1) - 1
    out = np.empty(len(words) + len(texts), np.uint64)
    is_word = np.ones(len(out), bool)
    is_word[ends] = False
    out[is_word] = words
    out[ends] = END
    return out, counts + 1


def _signed(hashes: np.ndarray) -> np.ndarray:
    """64-bit hashes as signed integers of the same order."""
    return (hashes ^ np.uint64(1 << 63)).view(_I64)


def _unsigned(keys: np.ndarray) -> np.ndarray:
    return keys.view(np.uint64) ^ np.uint64(1 << 63)


class _Counts:
    """Keys and counts held until there are enough to be worth a batch."""

    def __init__(self, shards_log: int):
        self.shift, self.keys, self.counts, self.size = np.uint64(64 - shards_log), [], [], 0

    def add(self, keys: np.ndarray, counts: np.ndarray | None = None):
        k, n = np.unique(keys, return_counts=True)
        self.keys.append(k)
        self.counts.append(n)
        self.size += len(k)
        if self.size >= HELD:
            yield self.batch()

    def batch(self) -> pa.RecordBatch:
        keys, counts = np.concatenate(self.keys or [np.zeros(0, np.uint64)]), np.concatenate(self.counts or [np.zeros(0, _I64)])
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.diff(keys, prepend=~keys[:1]) != 0) if len(keys) else np.zeros(0, _I64)
        sums = np.add.reduceat(counts, first) if len(keys) else counts
        keys = keys[first]
        self.keys, self.counts, self.size = [], [], 0
        return pa.RecordBatch.from_arrays([pa.array((keys >> self.shift).astype(_I64)), pa.array(_signed(keys)), pa.array(sums.astype(_I64))], names=["shard", "key", "n"])


def _counted(rows: DataFrame, run, shards_log: int, folder: str, name: str) -> list[dict]:
    """Sum the counts by key in Spark, and write each shard's keys and counts, sorted, to files.

    Returns one entry a shard that has keys: its files, where it begins in them, its number of
    keys, the sum of its counts, and how many keys have counts 1 to 4.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.mapInArrow(run, "shard long, key long, n long").repartition(parts, "shard")
    sums = dealt.groupBy("shard", "key").agg(F.sum("n").alias("n")).sortWithinPartitions("shard", "key")

    def write(batches):
        keys = counts = None
        told: dict[int, list[int]] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            if keys is None:
                keys, counts = ArrayWriter(folder, "keys"), ArrayWriter(folder, "counts")
            shard, key, n = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            cuts = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(shard)]
            for a, b in zip(cuts, cuts[1:]):
                t = told.setdefault(int(shard[a]), [keys.size + a, 0, 0, 0, 0, 0, 0])
                t[1] += b - a
                t[2] += int(n[a:b].sum())
                for c in range(1, 5):
                    t[2 + c] += int((n[a:b] == c).sum())
            keys.write(_unsigned(key))
            counts.write(n)
        if keys is not None:
            keys.close()
            counts.close()
            yield pa.RecordBatch.from_pylist([{"shard": s, "keys": keys.name, "counts": counts.name, "told": t} for s, t in told.items()])

    index = written(sums.mapInArrow(write, "shard long, keys string, counts string, told array<long>"), name)
    return [r.asDict() for r in index.orderBy("shard").collect()]  # by shard: at most 2 ** shards_log rows


class Model:
    """The arrays of a model, as workers see them; made from the driver's description."""

    def __init__(self, spec: dict):
        self.spec = spec
        self.words = self._tables(spec["words"], WORD_SHARDS_LOG)
        self.pairs = self._tables(spec["pairs"], PAIR_SHARDS_LOG) if "pairs" in spec else None

    def _tables(self, index: list[dict], log: int) -> dict:
        first = np.zeros((1 << log) + 1, _I64)
        by = {r["shard"]: r for r in index}
        for s in range(1 << log):
            first[s + 1] = first[s] + (by[s]["told"][1] if s in by else 0)
        return {"log": log, "by": by, "first": first}

    def _find(self, tables: dict, hashes: np.ndarray, *wanted: tuple[str, str]) -> tuple[np.ndarray, ...]:
        """For sorted hashes: their places over all shards (-1: absent), and the wanted arrays' values."""
        log, by, first = tables["log"], tables["by"], tables["first"]
        place = np.full(len(hashes), -1, _I64)
        out = [np.zeros(len(hashes), dtype) for _, dtype in wanted]
        shard = (hashes >> np.uint64(64 - log)).astype(_I64)
        cuts = np.searchsorted(shard, np.arange((1 << log) + 1))
        for s in np.unique(shard).tolist():
            r = by.get(s)
            if r is None:
                continue
            a, b, begin, n = cuts[s], cuts[s + 1], r["told"][0], r["told"][1]
            keys = part(self.spec["folder"], r["keys"], "<u8", begin, n)
            at = np.minimum(np.searchsorted(keys, hashes[a:b]), n - 1)
            hit = keys[at] == hashes[a:b]
            place[a:b] = np.where(hit, at + first[s], -1)
            for values, (column, dtype) in zip(out, wanted):
                start = begin if column == "counts" else r["at"]
                found = part(self.spec["folder"], r[column], dtype, start, n)[at]
                values[a:b] = np.where(hit, found, 0)
        return place, *out

    def word_numbers(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each word, -1 for unknown ones."""
        distinct, back = np.unique(hashes, return_inverse=True)
        return self._find(self.words, distinct)[0][back]

    def word_facts(self, hashes: np.ndarray) -> tuple[np.ndarray, ...]:
        """For each hash: number, count, weight left to lower orders, and unigram probability."""
        distinct, back = np.unique(hashes, return_inverse=True)
        number, count, gamma, lower = self._find(self.words, distinct, ("counts", "<i8"), ("gamma", "<f8"), ("lower", "<f8"))
        unknown = self.spec["uniform"]
        lower = np.where(number >= 0, lower, unknown)
        return number[back], count[back], gamma[back], lower[back]

    def pair_counts(self, before: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Counts of bigrams of known words; 0 where either is unknown."""
        out = np.zeros(len(word), _I64)
        both = np.flatnonzero((before >= 0) & (word >= 0))
        distinct, back = np.unique(mix64(_pair(before[both], word[both])), return_inverse=True)
        out[both] = self._find(self.pairs, distinct, ("counts", "<i8"))[1][back]
        return out


def _pair(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    return before.astype(np.uint64) << np.uint64(32) | word.astype(np.uint64)


@functools.lru_cache(maxsize=2)
def _model(spec: str) -> Model:
    return Model(json.loads(spec))


def discounts(t1: int, t2: int, t3: int, t4: int) -> list[float]:
    """Discounts of counts 1, 2 and 3 or more from the counts of counts (0 where they can't be told)."""
    y = t1 / (t1 + 2 * t2) if t1 else 0.0
    raw = [1 - 2 * y * t2 / t1 if t1 else 0.5, 2 - 3 * y * t3 / t2 if t2 else 0.5, 3 - 4 * y * t4 / t3 if t3 else 0.5]
    return [min(max(d, 0.0), float(c)) for c, d in enumerate(raw, 1)]


def train(texts: DataFrame, column: str = "text") -> dict:
    """A model's description: its folder, its shards' files and its totals.

    Three passes: words, bigrams (texts again), and from the bigrams' files each word's followers
    and predecessors. Word numbers have 32 bits; more distinct words are an error.
    """
    spark = texts.sparkSession
    folder = new_path(spark, "lm")
    rows = texts.select(F.col(column).cast("string"))

    def count_words(batches):
        held = _Counts(WORD_SHARDS_LOG)
        for batch in batches:
            column = batch.column(0).to_pylist()
            for a, b in slices(column):
                yield from held.add(tokens(column[a:b])[0])
        yield held.batch()

    words = _counted(rows, count_words, WORD_SHARDS_LOG, folder, "lm-words")
    total, vocabulary = sum(r["told"][2] for r in words), sum(r["told"][1] for r in words)
    if vocabulary >= 1 << 32:
        raise ValueError("more than 2**32 distinct words")
    spec = {"folder": folder, "words": words, "tokens": total, "vocabulary": vocabulary, "uniform": 1.0}
    if not total:
        return spec | {"pairs": [], "discounts": [0.0] * 3}
    partial = spark.sparkContext.broadcast(json.dumps(spec))  # by shard, whatever the corpus

    def count_pairs(batches):
        held, model = _Counts(PAIR_SHARDS_LOG), _model(partial.value)
        for batch in batches:
            column = batch.column(0).to_pylist()
            for a, b in slices(column):
                number = model.word_numbers(np.concatenate([[END], tokens(column[a:b])[0]]))
                yield from held.add(mix64(_pair(number[:-1], number[1:])))
        yield held.batch()

    pairs = _counted(rows, count_pairs, PAIR_SHARDS_LOG, folder, "lm-pairs")
    t = [sum(r["told"][2 + c] for r in pairs) for c in range(1, 5)]
    by_count = discounts(*t)
    spec |= {"pairs": pairs, "discounts": by_count}
    followers, sums = _followers(spark, spec)
    distinct = sum(r["told"][1] for r in pairs)
    lower = discounts(*sums[:4])
    left = (lower[0] * sums[0] + lower[1] * sums[1] + lower[2] * (vocabulary - sums[0] - sums[1])) / distinct
    uniform = left / (vocabulary + 1)
    _finish(spark, spec, followers, by_count, lower, distinct, uniform)
    return spec | {"uniform": uniform}


def _followers(spark: SparkSession, spec: dict) -> tuple[list[dict], list[int]]:
    """By shard of words: files of the numbers of followers seen once, twice and more often, and
    of distinct predecessors; and how many words have 1 to 4 predecessors."""
    folder, shared = spec["folder"], spark.sparkContext.broadcast(json.dumps(spec))
    shards = spark.createDataFrame([(r["shard"],) for r in spec["pairs"]], "shard long")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def read(batches):
        model = _model(shared.value)
        first = model.words["first"]
        held, size = [], 0

        def rows():
            ids, n = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
            distinct, back = np.unique(ids, return_inverse=True)
            sums = np.stack([np.bincount(back, n[:, c], len(distinct)).astype(_I64) for c in range(4)])
            shard = (np.searchsorted(first, distinct, "right") - 1).astype(_I64)
            return pa.RecordBatch.from_arrays([pa.array(shard), pa.array(distinct), *map(pa.array, sums)], names=["shard", "id", "n1", "n2", "n3", "before"])

        for batch in batches:
            for s in batch.column(0).to_pylist():
                r = model.pairs["by"][s]
                begin, n_keys = r["told"][:2]
                key = _unmix(np.asarray(part(folder, r["keys"], "<u8", begin, n_keys)))
                count = np.asarray(part(folder, r["counts"], "<i8", begin, n_keys))
                n = np.zeros((2 * len(key), 4), np.int32)
                n[np.arange(len(key)), np.minimum(count, 3) - 1] = 1
                n[len(key) :, 3] = 1
                held.append((np.concatenate([key >> np.uint64(32), key & np.uint64(0xFFFFFFFF)]).astype(_I64), n))
                size += len(n)
                if size >= HELD:
                    yield rows()
                    held, size = [], 0
        if held:
            yield rows()

    told = shards.repartition(parts, "shard").mapInArrow(read, "shard long, id long, n1 long, n2 long, n3 long, before long").repartition(parts, "shard")

    def write(batches):
        model = _model(shared.value)
        first, arrays = model.words["first"], {}
        for batch in batches:
            shard, ids, *n = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            for s in np.unique(shard).tolist():
                if s not in arrays:
                    arrays[s] = np.zeros((4, int(first[s + 1] - first[s])), _I64)
                of = shard == s
                for c in range(4):
                    np.add.at(arrays[s][c], ids[of] - first[s], n[c][of])
        if not arrays:
            return
        out = ArrayWriter(folder, "followers")
        rows = []
        for s, a in arrays.items():
            rows.append({"shard": s, "followers": out.name, "at": out.size, "told": [int((a[3] == c).sum()) for c in range(1, 5)]})
            out.write(a.ravel())
        out.close()
        yield pa.RecordBatch.from_pylist(rows)

    index = written(told.mapInArrow(write, "shard long, followers string, at long, told array<long>"), "lm-followers")
    found = [r.asDict() for r in index.collect()]
    return found, [sum(r["told"][c] for r in found) for c in range(4)]


def _finish(spark: SparkSession, spec: dict, followers: list[dict], by_count: list[float], lower: list[float], distinct: int, uniform: float) -> None:
    """Write gamma and lower (each word's weight for lower orders, and unigram probability) beside
    the words' counts, and note their files in the description."""
    folder, words = spec["folder"], {r["shard"]: r for r in spec["words"]}
    rows = [(r["shard"], r["followers"], r["at"], words[r["shard"]]["counts"], *words[r["shard"]]["told"][:2]) for r in followers]
    shards = spark.createDataFrame(rows, "shard long, followers string, at long, counts string, begin long, n long")

    def run(batches):
        gamma = ArrayWriter(folder, "gamma")
        low = ArrayWriter(folder, "lower")
        told = []
        for batch in batches:
            for r in batch.to_pylist():
                n = np.asarray(part(folder, r["followers"], "<i8", r["at"], 4 * r["n"])).reshape(4, -1)
                count = np.asarray(part(folder, r["counts"], "<i8", r["begin"], r["n"]))
                told.append({"shard": r["shard"], "gamma": gamma.name, "lower": low.name, "at": gamma.size})
                gamma.write((by_count[0] * n[0] + by_count[1] * n[1] + by_count[2] * n[2]) / count)
                less = np.array([0.0, *lower])[np.minimum(n[3], 3)]
                low.write((n[3] - less) / distinct + uniform)
        gamma.close()
        low.close()
        if told:
            yield pa.RecordBatch.from_pylist(told)

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    index = written(shards.repartition(parts, "shard").mapInArrow(run, "shard long, gamma string, lower string, at long"), "lm-arrays")
    for r in index.collect():
        words[r["shard"]] |= r.asDict()


def score(df: DataFrame, spec: dict, column: str = "text") -> DataFrame:
    """The other columns of df with n_tokens, n_known, train_tokens, base_score (add-half
    unigrams), score (the model's log10 probability) and perplexity of every row's text."""
    keep = [f for f in df.schema.fields if f.name != column]
    shared = df.sparkSession.sparkContext.broadcast(json.dumps(spec))
    total, vocabulary = spec["tokens"], spec["vocabulary"]
    names = ["n_tokens", "n_known", "train_tokens", "base_score", "score", "perplexity"]

    def told(model: Model, texts: list) -> tuple[np.ndarray, ...]:
        hashes, sizes = tokens(texts)
        starts = np.cumsum(sizes) - sizes
        if not total:
            zero = np.zeros(len(texts))
            return sizes, zero.astype(_I64), zero, zero
        number, count, gamma, lower = model.word_facts(np.concatenate([[END], hashes]))
        pair = model.pair_counts(number[:-1], number[1:])
        known = number[:-1] >= 0
        less = np.array([0.0, *spec["discounts"]])[np.minimum(pair, 3)]
        high = np.where(known, (pair - less) / np.maximum(count[:-1], 1), 0.0)
        p = high + np.where(known, gamma[:-1], 1.0) * lower[1:]
        base = np.log10((count[1:] + 0.5) / (total + 0.5 * (vocabulary + 1)))
        sums = lambda x: np.add.reduceat(x, starts)
        return sizes, sums((count[1:] > 0).astype(_I64)), sums(base), sums(np.log10(p))

    def run(batches):
        model = _model(shared.value)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(column)).to_pylist()
            if not texts:
                continue
            n, known, base, log = (np.concatenate(x) for x in zip(*(told(model, texts[a:b]) for a, b in slices(texts))))
            cols = [batch.column(batch.schema.get_field_index(f.name)) for f in keep]
            out = [pa.array(n.astype(_I64)), pa.array(known), pa.array(np.full(len(n), total, _I64)), pa.array(base), pa.array(log), pa.array(np.power(10.0, np.minimum(-log / n, 300.0)))]
            yield pa.RecordBatch.from_arrays([*cols, *out], names=[*[f.name for f in keep], *names])

    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in keep)
    return df.mapInArrow(run, kept + "n_tokens long, n_known long, train_tokens long, base_score double, score double, perplexity double")


def held_out(column: str, fold: int):
    """Whether crc32 of the id as text, mod 5, is ``fold``; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % 5 == fold


def op5_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    docs = pick(table(spark, sf_dir, "documents"), "doc_id long", "text string").withColumn("held_out", held_out("doc_id", 1))
    spec = train(docs.where(~F.col("held_out")))
    return score(docs, spec)


QUERIES = {"op5_lm": op5_lm}
ORACLE: dict[str, str] = {}
