"""Near-duplicate detection: circulant MinHash, banding, exact verification, components.

A text's set is its distinct word shingles as 64-bit hashes (fewer words than a shingle has: the
whole sequence as one). Signatures use two permutations: sigma sends each shingle to one of D
places, and coordinate k is the least value of pi, shifted circularly by k, over those places.
Texts with equal sets are one class. Bands of signature coordinates deal the classes to buckets.
In each bucket every class is compared with one centre only (the best by rank: the class that
shares most buckets, as an original does with its copies), so the pairs made are as many as the
rows of buckets, not their square. Two classes that both link to the centre are joined by it.
Members of buckets that may hold further links are compared with their bucket's hub, the best
centre that any member has in any of its buckets, so a whole family meets one hub (in a crowded star, the
class nearest to it where fewer fail with that: of copies of an original, the original); those pairs
that a star can still hold are found by how its members differ from the hub:

* Two members that link, one of which failed, have an added shingle (one that the hub lacks) in
  common, among the first (1 - limit) * size + 1 of each in the order of hashes: a class that
  shares much of the other but little of the hub shares many added ones (a prefix filter).
* Or they have none in common. Then one is smaller than the hub by more than the other lacks to
  the limit, and any few of the shingles that it lacks hold one that the other lacks as well.

Both are exact: what shares no such shingle is settled. Members that share such a shingle make a new bucket; independent edits of one
original share none, so large families end here. Members so far from the hub that no member linked
to it can be linked with them are
dealt by many long bands instead. In the new buckets one class (of those that failed with the hub,
the best) is compared with all others that aren't in its component, then components are
merged. In buckets still of several components more classes lead, then many times more, until no bucket with leads
has several. Only where very many share a difference (``CROWDED``), as a whole family shares a passage, they are dealt by long bands
instead, in which those far from a link seldom meet; a smaller bucket makes pairs in proportion to its rows. Before
sets are brought together there, a pair must pass a sketch of parities, which rules out nothing that
links (``_parity``). All links are confirmed on whole sets. At similarity 0.85 a
linked pair shares no bucket with probability 4e-7 (0.8: 5e-5), and no long band with 2e-6.

Defined cases: null and empty texts have no set, and stay; rows without doc_id link like others,
but a component's id is its least doc_id, and null only if it has none; a row is kept if its
doc_id is its component's (so rows that repeat doc_id and text go together). An empty table
gives an empty result. Texts are whole, however long: one text's set is held by one task. Classes of equal score are
ordered by their fingerprints, so reruns agree. Extra columns never matter, and the stage keeps
them, whatever their names.
"""

from __future__ import annotations

import functools
import hashlib
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import ROW, all_of, bound_batches, pack, pick, slices, table, unpack, written
from ._hashing import mix64, stream64, word_hashes
from ._parity import near, parities

BANDS, ROWS = 25, 5
#: Bands of the second dealing, whose rows follow from the limit, and the chance that it loses a link.
FINE_BANDS, FINE_LOSS = 180, 2e-6
#: Edges of components in one file, about.
EDGES_A_FILE = 100_000
#: Classes that share a difference, above which those left after one lead are dealt by long bands.
CROWDED = 48
#: Classes of a bucket that are compared with all others of it at once after the first, and how many times more in each later round.
FIRST_LEADS, LEADS_GROW = 16, 128
#: Stars with more near members that failed try another hub, the class nearest to theirs.
CROWD = 16
#: Members of a star that one task compares, about: larger stars' centres go to several.
STAR_ROWS = 512
#: Places of the circulant permutation, and coordinates that are made at once at most.
PLACES_LOG, MOST_SHIFTS = 22, 8192
#: Rows of a written table in one file, and sets or pairs of sets that one task takes, about (an Arrow batch).
ROWS_A_FILE, SETS_A_TASK = 20_000, 2000
#: Bits by which rows are left out that a join can't want (a power of two): 2 MB when all are used.
LIKELY_BITS = 1 << 24
_SIGMA = stream64(2, 21)
_CHUNK = 1 << 20


@functools.lru_cache(maxsize=1)
def _circle() -> np.ndarray:
    """The permutation pi, and its beginning once more."""
    rng = np.random.default_rng(23)
    pi = np.arange(1 << PLACES_LOG, dtype=np.int32)
    rng.shuffle(pi)
    return np.concatenate([pi, pi[: MOST_SHIFTS - 1]])


def _shifts(k: int) -> np.ndarray:
    """Row i: the values that place i has in pi shifted by 0 to k - 1 (a view, whatever k)."""
    return np.lib.stride_tricks.sliding_window_view(_circle(), k)


def shingle_sets(texts: list[str | None], width: int) -> list[np.ndarray]:
    """Each text's distinct shingle hashes, sorted; A-Z is taken as a-z."""
    weights = stream64(width + 1, 20)
    out: list[np.ndarray] = []
    for a, b in slices(texts):
        words, counts = word_hashes([(t or "").encode().lower() for t in texts[a:b]])
        with np.errstate(over="ignore"):
            whole = np.zeros(max(0, len(words) - width + 1), np.uint64)
            for j in range(width):
                whole += words[j : j + len(whole)] * weights[j]
            whole = mix64(whole)
            at = 0
            for n in counts.tolist():
                if n >= width:
                    out.append(np.unique(whole[at : at + n - width + 1]))
                elif n:
                    out.append(mix64((words[at : at + n] * weights[:n]).sum(keepdims=True) + np.uint64(n) * weights[width]))
                else:
                    out.append(np.zeros(0, np.uint64))
                at += n
    return out


def signature(shingles: np.ndarray, k: int = BANDS * ROWS, start: int = 0) -> np.ndarray:
    """Coordinates start to start + k - 1 of a set that isn't empty."""
    with np.errstate(over="ignore"):
        place = ((mix64(shingles * _SIGMA[0] + _SIGMA[1])) >> np.uint64(64 - PLACES_LOG)).astype(np.int64)
    place = (place + start) & ((1 << PLACES_LOG) - 1)  # a shift of pi is a shift of places
    shifts, best, step = _shifts(k), None, max(1, _CHUNK // k)
    for i in range(0, len(place), step):
        least = shifts[place[i : i + step]].min(axis=0)
        best = least if best is None else np.minimum(best, least)
    return best


def bucket_keys(signatures: np.ndarray, bands: int, seed: int) -> np.ndarray:
    """64-bit keys of the bands, one row a signature."""
    parts = signatures.astype(np.uint64).reshape(len(signatures), bands, -1)
    with np.errstate(over="ignore"):
        sums = (parts * stream64(parts.shape[2], seed)).sum(axis=2) + np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return mix64(sums).view(np.int64)


def sketches(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, text_key, n (size of the set), fp (16 bytes, equal for equal sets; null if empty)
    and the bucket keys of every row; written."""
    rows = pick(docs, "doc_id long", "text string").select("doc_id", F.xxhash64("text").alias("text_key"), "text")

    def run(batches):
        for batch in batches:
            sets = shingle_sets(batch.column(2).to_pylist(), width)
            full = [s for s in sets if s.size]
            keys = iter(bucket_keys(np.array([signature(s) for s in full]), BANDS, 22) if full else ())
            fps = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if s.size else None for s in sets]
            buckets = pa.array([next(keys) if s.size else None for s in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([s.size for s in sets], pa.int64()), pa.array(fps, pa.binary()), buckets],
                names=["doc_id", "text_key", "n", "fp", "buckets"],
            )

    return written(rows.mapInArrow(run, "doc_id long, text_key long, n long, fp binary, buckets array<long>"), "minhash-sketches")


def _few(df: DataFrame, most: int, each: int = ROWS_A_FILE) -> DataFrame:
    """df, of ``most`` rows at most, in as many partitions as these rows need, or keep the cores busy, where it has more: each
    costs a task, a file, often a Python worker, and work for whatever reads it."""
    return df.coalesce(max(2 * df.sparkSession.sparkContext.defaultParallelism, -(-most // each)))


def _likely(rows: DataFrame, wanted: DataFrame, *keys: str) -> DataFrame:
    """The rows whose keys are in ``wanted``, and a few others: those left out needn't be shuffled for a join."""
    at = F.pmod(F.xxhash64(*keys), F.lit(LIKELY_BITS))
    marks = wanted.select(at.alias("at")).groupBy(F.bitmap_bucket_number("at").alias("__part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("__bits"))
    bit = F.bitmap_bit_position(at)
    byte = F.conv(F.hex(F.substring("__bits", (bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return rows.join(F.broadcast(marks), (F.bitmap_bucket_number(at) == F.col("__part")) & (F.getbit(byte, (bit % 8).cast("int")) == 1), "left_semi")


def _sets_of(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """fp, set (sorted hashes as bytes), n and sketch (parities) of the classes ``wanted`` (fp, doc_id, text_key)."""
    rows = pick(docs, "doc_id long", "text string").select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    most = wanted.count()
    rows, w = _likely(rows, wanted, "doc_id", "text_key").alias("r"), wanted.alias("w")
    on = (F.col("r.text_key") == F.col("w.text_key")) & F.col("r.doc_id").eqNullSafe(F.col("w.doc_id"))
    found = _few(rows.join(w, on).select("w.fp", "r.text").dropDuplicates(["fp"]), most, SETS_A_TASK)

    def run(batches):
        for batch in batches:
            sets = shingle_sets(batch.column(1).to_pylist(), width)
            more = [pa.array([s.tobytes() for s in sets], pa.binary()), pa.array([s.size for s in sets], pa.int64()), pa.array([parities(s) for s in sets], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *more], names=["fp", "set", "n", "sketch"])

    return written(found.mapInArrow(run, "fp binary, set binary, n long, sketch array<long>"), "minhash-sets")


def differences(p: np.ndarray, q: np.ndarray, percent: int) -> dict:
    """How a member's set p stands to its centre's set q (both sorted).

    ``linked``; ``near``: some member linked to the centre may be linked to this one; ``added``: the
    first shingles that the centre lacks, as many as a link by them can begin in; ``lacks``: the
    shingles missing of a member that failed, if a link without added ones is possible, and
    ``few`` of them, those of a smaller member (``gain``, against the others' ``short``).
    """
    at = np.minimum(np.searchsorted(q, p), len(q) - 1)
    hit = q[at] == p
    both = int(hit.sum())
    union = len(p) + len(q) - both
    short, gain = percent * union - 100 * both, percent * (len(q) - len(p))
    least = max(1, -(-percent * len(p) // 100) - both)  # added shingles that any link shares, if any
    added = p[~hit]
    few = (gain - 1) // (100 + percent) + 1 if gain > 0 else 0
    lacks = q[:0]
    if 100 * both >= percent * len(p) and (short > 0 or few):
        gone = np.ones(len(q), bool)
        gone[at[hit]] = False
        lacks = q[gone]
    return {
        "linked": short <= 0, "apart": 1 - both / union, "near": 100 * (union - both) <= 2 * (100 - percent) * union, "short": short, "gain": gain, "few": few,
        "added": added[: max(0, len(added) - least + 1)], "lacks": lacks if short > 0 else lacks[:few],
    }


_COMPARED = "a binary, b binary, score long, linked boolean, apart double, near boolean, short long, gain long, few int, added array<long>, lacks array<long>"


def _verify(stars: DataFrame, sets: DataFrame, percent: int, shingles: bool = False, few: bool = True) -> DataFrame:
    """The pairs (a, b, score) with what :func:`differences` says of them, on whole sets; written.

    A centre's set goes to as many tasks as its star needs. The lists of shingles are filled only
    if wanted, and for near members. Where the pairs have ``few`` of the sets, only these are shuffled.
    """
    most = stars.count()
    if few:
        sets = _likely(sets.select("fp", "set"), stars.select(F.explode(F.array("a", "b")).alias("fp")), "fp")
    parts = F.ceil(F.col("n") / STAR_ROWS).cast("int")
    salts = stars.groupBy("b").agg(F.count("*").alias("n")).select(F.col("b").alias("__b"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("__salt"), parts.alias("parts"))
    sizes = salts.where("__salt = 0 and parts > 1").select("__b", "parts")
    salt = F.pmod(F.xxhash64("a"), F.coalesce("parts", F.lit(1))).cast("int")
    pairs = stars.join(sizes, F.col("b") == F.col("__b"), "left").select("a", "b", "score", salt.alias("salt"))
    # both sides join the same table on the same key, so it is shuffled once
    left = pairs.join(sets.alias("x"), F.col("a") == F.col("x.fp")).select("a", "b", "score", "salt", F.col("x.set").alias("set_a"))
    right = salts.join(sets.alias("y"), F.col("__b") == F.col("y.fp")).select("__b", "__salt", F.col("y.set").alias("set_b"))
    rows = left.join(right, (F.col("b") == F.col("__b")) & (F.col("salt") == F.col("__salt"))).select("a", "b", "score", "set_a", "set_b")
    rows = _few(rows, most, SETS_A_TASK)

    def run(batches):
        for batch in batches:
            told = []
            for x, y in zip(batch.column(3), batch.column(4)):
                d = differences(*(np.frombuffer(s.as_buffer(), np.uint64) for s in (x, y)), percent)
                if not (shingles and d["near"]):
                    d["added"] = d["lacks"] = d["added"][:0]
                told.append(d)
            kinds = {"linked": pa.bool_(), "apart": pa.float64(), "near": pa.bool_(), "short": pa.int64(), "gain": pa.int64(), "few": pa.int32()}
            plain = [pa.array([d[k] for d in told], t) for k, t in kinds.items()]
            lists = [pa.array([d[k].view(np.int64) for d in told], pa.list_(pa.int64())) for k in ("added", "lacks")]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *plain, *lists], names=["a", "b", "score", *kinds, "added", "lacks"])

    return written(rows.mapInArrow(run, _COMPARED), "minhash-verified")


def components(edges: DataFrame) -> DataFrame:
    """node, root: the least node of each component of the edges (a, b), by alternating large
    and small stars until nothing changes; every step makes as many rows as there are edges. A file's worth of edges
    isn't shuffled: that would take as many tasks for each step as there are partitions."""
    now = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b"), "components")
    last = None
    while True:
        mark = now.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
        if mark == last:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        n, last = mark[0], mark
        if n <= EDGES_A_FILE:
            now = now.coalesce(1)  # the only partition: what follows needs no shuffle
        # a is the greater of each edge, so a node's least neighbour, if less than itself, is among its b
        least = now.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        large = now.join(least, F.col("b") == F.col("u"), "left").select("a", F.coalesce("m", "b").alias("b")).distinct()
        lower = large.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        small = large.join(lower, F.col("a") == F.col("u")).select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        # the edges don't grow in number: as many files as they need, not as there are partitions
        now = written(small.distinct().coalesce(max(1, -(-n // EDGES_A_FILE))), "components")


def merged(links: DataFrame, fresh: DataFrame, most: int) -> DataFrame:
    """The components ``links`` (node, root; ``most`` nodes at most), those that the ``fresh`` edges (a, b) join made one; written.
    Only the roots that fresh edges join go through rounds, not what the components hold."""
    for side in "ab":
        fresh = _labelled(fresh.withColumnRenamed(side, "fp"), links).drop("fp").withColumnRenamed("label", side)
    roots = components(fresh)
    to = roots.select(F.col("node").alias("__n"), F.col("root").alias("__r"))
    moved = links.join(to, F.col("root") == F.col("__n"), "left").select("node", F.coalesce("__r", "root").alias("root"))
    return written(_few(moved.union(roots), most), "components-merged")


def _labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Add label: the class's component root, or itself."""
    right = labels.select(F.col("node").alias("__node"), F.col("root").alias("__root"))
    return rows.join(right, F.col("fp") == F.col("__node"), "left").withColumn("label", F.coalesce("__root", "fp")).drop("__node", "__root")


def _ranked(rows: DataFrame) -> DataFrame:
    """bucket, fp and score of the rows (bucket, fp, n: the bucket's classes): classes that share buckets with many others
    come first as centres."""
    told = rows.groupBy("fp").agg(F.sum(F.col("n") - 1).alias("score"), F.collect_list("bucket").alias("buckets"))
    return told.select(F.explode("buckets").alias("bucket"), "fp", "score")


def _hubs(rows: DataFrame, most: int) -> DataFrame:
    """bucket, fp, score, centre (the best of its bucket) and hub (the best of its members' centres); written.

    A class's buckets, BANDS at most, stay together where its own best centre is found, so they needn't be joined with it.
    """
    best = rows.groupBy("bucket").agg(F.max(F.struct("score", "fp")).alias("centre")).withColumnRenamed("bucket", "__b")
    told = rows.join(best, F.col("bucket") == F.col("__b"))
    own = told.groupBy("fp", "score").agg(F.max("centre").alias("own"), F.collect_list(F.struct("bucket", F.col("centre.fp").alias("centre"))).alias("stars"))
    own = own.select("fp", "score", "own", F.inline("stars"))
    hub = own.groupBy("bucket").agg(F.max("own").alias("hub")).withColumnRenamed("bucket", "__b")
    out = own.join(hub, F.col("bucket") == F.col("__b"))
    return written(_few(out.select("bucket", "fp", "score", "centre", F.col("hub.fp").alias("hub")), most), "minhash-hubs")


def _stars(rows: DataFrame, centre: str, most: int) -> DataFrame:
    """a, b, score (of a): every class a with its ``centre`` b; written."""
    return written(_few(rows.where(F.col("fp") != F.col(centre)).select(F.col("fp").alias("a"), F.col(centre).alias("b"), "score").distinct(), most), "minhash-stars")


def _unsettled(hubs: DataFrame, compared: DataFrame) -> DataFrame:
    """The rows of hubs that may hold links with others of their bucket, besides those to its centre."""
    told = compared.select("a", "b", "linked", "near")
    rows = hubs.join(told, (F.col("fp") == F.col("a")) & (F.col("centre") == F.col("b"))).drop("a", "b")
    sums = rows.groupBy("bucket").agg(F.count_if(~F.col("linked")).alias("n_failed"), F.count_if(~F.col("linked") & F.col("near")).alias("n_near"), F.count("*").alias("n"))
    sums = sums.where("n > 1 and n_failed > 0").withColumnRenamed("bucket", "__b")
    return rows.join(sums, F.col("bucket") == F.col("__b")).where("n_near > 0 or (n_failed > 1 and not linked)").select("bucket", "fp", "score", "hub")


def _open(compared: DataFrame) -> DataFrame:
    """The members of stars that may hold further links, with far: a star's member is not near."""
    failed = ~F.col("linked")
    contained = failed & (F.size("lacks") > 0)
    told = compared.groupBy("b").agg(
        F.count_if(failed).alias("n_failed"),
        F.count_if(failed & F.col("near")).alias("n_near"),
        F.count("*").alias("n"),
        F.min(F.when(contained, F.col("short"))).alias("least"),
        F.max("gain").alias("most"),
    )
    told = told.where("n > 1 and n_failed > 0").withColumnRenamed("b", "__b")
    rows = compared.join(told, F.col("b") == F.col("__b")).where((failed & (F.col("n_failed") > 1)) | (F.col("n_near") > 0))
    lacks = F.when(failed & (F.col("short") <= F.col("most")), F.col("lacks")).when(F.col("gain") >= F.col("least"), F.slice("lacks", F.lit(1), "few"))
    return rows.select("a", "b", "score", "linked", "near", (F.col("n_failed") > F.col("n_near")).alias("far"), "n_failed", "added", lacks.alias("lacks"))


def _recentred(second: DataFrame, sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """The comparisons with the hubs nearest to those of crowded stars; and those of all stars, with
    the hub with which fewer members fail."""
    crowd = second.groupBy("b").agg(F.count_if(~F.col("linked") & F.col("near")).alias("n"), F.min_by("a", F.struct("apart", "a")).alias("other"))
    crowd = crowd.where(f"n > {CROWD}").select(F.col("b").alias("__b"), "other")
    most = second.count()
    moved = second.join(crowd, F.col("b") == F.col("__b")).where("a != other").select("a", "b", "score", "linked", "other")
    moved = written(_few(moved, most), "minhash-crowds")
    more = _verify(written(_few(moved.select("a", F.col("other").alias("b"), "score").distinct(), most), "minhash-stars"), sets, percent, True)
    now = more.select(F.col("a").alias("__a"), F.col("b").alias("__b"), F.col("linked").alias("__linked"))
    both = moved.join(now, (F.col("a") == F.col("__a")) & (F.col("other") == F.col("__b")))
    better = both.groupBy("b", "other").agg(F.count_if(~F.col("linked")).alias("old"), F.count_if(~F.col("__linked")).alias("new")).where("new < old")
    better = written(_few(better.select("b", "other"), most), "minhash-moved")
    stay = second.join(better.select("b").distinct(), "b", "left_anti")
    return more, stay.unionByName(more.join(better.select(F.col("other").alias("b")).distinct(), "b", "left_semi"))


def _dealt_again(told: DataFrame) -> DataFrame:
    """bucket, fp, score, lead (it failed) and long (false) of members that share a shingle in which they differ
    from the hub."""
    keys = F.concat("added", F.coalesce("lacks", F.array().cast("array<long>")))
    rows = told.select(F.col("a").alias("fp"), "score", (~F.col("linked")).alias("lead"), "b", F.explode(keys).alias("key"))
    return _shared(rows.select(F.xxhash64("b", "key").alias("bucket"), "fp", "score", "lead", F.lit(False).alias("long")))


def _several(rows: DataFrame, links: DataFrame, most: int) -> DataFrame:
    """bucket, fp, score, lead, long, label, n (the bucket's classes) and n_lead (its leads) of the buckets with leads and
    more than one component, one of those with the same members; written."""
    rows = _labelled(rows, links)
    told = F.xxhash64("fp", "lead"), F.xxhash64(F.lit("again"), "fp", "lead")
    members = [F.count("*").alias("n"), F.bit_xor(told[0]).alias("x"), F.bit_xor(told[1]).alias("y")]
    sums = rows.groupBy("bucket", "long").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count_if("lead").alias("n_lead"), *members).where("lo != hi and n_lead > 0")
    # what shares a passage shares many shingles: of buckets with the same members, which hold the same pairs, one is enough
    many = sums.groupBy("n", "x", "y", "long").agg(F.min("bucket").alias("__b"), F.first("n_lead").alias("n_lead")).select("__b", F.col("long").alias("__long"), "n", "n_lead")
    rows = rows.join(many, (F.col("bucket") == F.col("__b")) & (F.col("long") == F.col("__long")))
    return written(_few(rows.select("bucket", "fp", "score", "lead", "long", "label", "n", "n_lead"), most), "minhash-rows")


def _led(rows: DataFrame, leads: int, most: int) -> tuple[DataFrame, DataFrame]:
    """The pairs a, b, score of the buckets' best leads with members of other components, written;
    and the rows, these leads no longer leading."""
    order = Window.partitionBy("bucket").orderBy(F.desc("score"), F.desc("fp"))
    best = rows.where("lead").withColumn("place", F.row_number().over(order)).where(F.col("place") <= leads)
    best = best.select(F.col("bucket").alias("__b"), F.col("fp").alias("b"), F.col("label").alias("__label"))
    pairs = rows.join(best, (F.col("bucket") == F.col("__b")) & (F.col("label") != F.col("__label")))
    pairs = pairs.select(F.greatest("fp", "b").alias("a"), F.least("fp", "b").alias("b"), F.lit(0).cast("long").alias("score")).distinct()
    rest = rows.where(f"n_lead > {leads}").join(best, (F.col("bucket") == F.col("__b")) & (F.col("fp") == F.col("b")), "left")
    return written(_few(pairs, most * leads), "minhash-pairs"), rest.select("bucket", "fp", "score", (F.col("lead") & F.col("b").isNull()).alias("lead"), "long")


def fine_rows(percent: int) -> int:
    """Rows of a band of the second dealing, as many as FINE_LOSS allows."""
    most = MOST_SHIFTS // FINE_BANDS
    return most if percent >= 100 else min(most, max(1, int(np.log(1 - FINE_LOSS ** (1 / FINE_BANDS)) / np.log(percent / 100))))


def _fine(sets: DataFrame, percent: int) -> DataFrame:
    """bucket, fp, score, lead and long (true) of the classes by many long bands of coordinates of their own."""
    rows = fine_rows(percent)

    def run(batches):
        for batch in batches:
            sigs = [signature(np.frombuffer(s.as_buffer(), np.uint64), FINE_BANDS * rows) for s in batch.column(1)]
            keys = bucket_keys(np.array(sigs), FINE_BANDS, 25) if sigs else []
            yield pa.RecordBatch.from_arrays([batch.column(0), *batch.columns[2:], pa.array([k for k in keys], pa.list_(pa.int64()))], names=["fp", "score", "lead", "buckets"])

    keys = sets.select("fp", "set", "score", "lead").mapInArrow(run, "fp binary, score long, lead boolean, buckets array<long>")
    return keys.select(F.explode("buckets").alias("bucket"), "fp", "score", "lead", F.lit(True).alias("long"))


def _long_bands(sets: DataFrame, chosen: DataFrame, percent: int) -> DataFrame:
    """The long bands of the chosen classes (__fp, score, lead)."""
    likely = _likely(sets.select("fp", "set"), chosen.select(F.col("__fp").alias("fp")), "fp")
    return _fine(likely.join(chosen, F.col("fp") == F.col("__fp")), percent)


def _shared(dealt: DataFrame, *sums: Column) -> DataFrame:
    """The rows (bucket, fp and more) of buckets with two classes at least, and a lead where there are leads; with ``sums``
    of their buckets."""
    lead = F.bool_or("lead") if "lead" in dealt.columns else F.lit(True)
    told = dealt.groupBy("bucket").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi"), lead.alias("led"), *sums).where("lo != hi and led")
    return dealt.join(told.withColumnRenamed("bucket", "__b"), F.col("bucket") == F.col("__b")).drop("__b", "lo", "hi", "led")


def _links(docs: DataFrame, sketched: DataFrame, width: int, percent: int) -> DataFrame:
    """node, root of all classes that are linked with another."""
    full = sketched.where("n > 0")
    dealt = full.groupBy("fp").agg(F.first("buckets").alias("buckets")).select("fp", F.explode("buckets").alias("bucket"))
    n_docs = sketched.count()
    left = _shared(dealt.repartition("bucket"), F.count("*").alias("n"))  # shuffled once for the sums and the join
    left = written(_few(left, BANDS * n_docs), "minhash-buckets")
    classes = full.groupBy("fp").agg(F.min(F.struct("doc_id", "text_key")).alias("r"))
    wanted = written(_few(left.select("fp").distinct().join(classes, "fp").select("fp", "r.doc_id", "r.text_key"), n_docs), "minhash-wanted")
    sets = _sets_of(docs, wanted, width)

    n_rows = left.count()
    hubs = _hubs(_ranked(left), n_rows)
    first = _verify(_stars(hubs, "centre", n_rows), sets, percent, False, False)
    second = _verify(_stars(_unsettled(hubs, first), "hub", n_rows), sets, percent, True)
    third, stars = _recentred(second, sets, percent)
    told = written(_few(_open(stars), n_rows), "minhash-open")
    far = told.where("far and n_failed > 1 and not linked").groupBy(F.col("a").alias("__fp")).agg(F.first("score").alias("score"), F.bool_or(~F.col("near")).alias("lead"))
    fine = written(_long_bands(sets, written(_few(far, n_rows), "minhash-far"), percent), "minhash-fine")

    most = told.select(F.sum(F.size("added") + F.coalesce(F.size("lacks"), F.lit(0)))).first()[0] or 0
    most += fine.count()
    rows, leads = _dealt_again(told).unionByName(_shared(fine)), 1
    links = components(all_of([first, second, third]).where("linked").select("a", "b"))
    for turn in itertools.count():  # the leads of a bucket get fewer, and the more of them are compared at once
        several = _several(rows, links, most)
        if turn == 1:  # one lead was enough for those that link with it
            leads, crowd = FIRST_LEADS, several.where(f"n > {CROWDED} and not long")
            if not crowd.isEmpty():
                left = crowd.groupBy(F.col("fp").alias("__fp")).agg(F.max("score").alias("score"), F.bool_or("lead").alias("lead"))
                dealt = written(_long_bands(sets, written(left, "minhash-crowd"), percent), "minhash-fine")
                several = _several(several.where(f"n <= {CROWDED} or long").select(*dealt.columns).unionByName(_shared(dealt)), links, most + dealt.count())
        most = several.count()
        if not most:
            return links
        pairs, rows = _led(several, leads, most)
        pairs = _few(near(pairs, sets.select(F.col("fp").alias("id"), "n", "sketch"), percent), pairs.count())
        fresh = _verify(written(pairs, "minhash-near"), sets.select("fp", "set"), percent).where("linked").select("a", "b")
        if not fresh.isEmpty():
            links = merged(links, fresh, n_docs)
        leads *= LEADS_GROW


def groups(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, text_key (xxhash64 of the text), n_shingles, component_id and kept of every row."""
    return _grouped(docs, width, percent).drop("label")


def _grouped(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """As :func:`groups`, with a label of each component, also of those without any doc_id."""
    bound_batches(docs.sparkSession)
    sketched = sketches(docs, width)
    links = _links(docs, sketched, width, percent)
    ids = sketched.where("n > 0").groupBy("fp").agg(F.min("doc_id").alias("least"))
    ids = _labelled(ids, links)
    whole = ids.groupBy("label").agg(F.min("least").alias("component_id"))
    ids = ids.join(whole, "label").select(F.col("fp").alias("__fp"), "component_id", "label")
    rows = sketched.select("doc_id", "text_key", F.col("n").alias("n_shingles"), "fp")
    joined = rows.join(ids, F.col("fp") == F.col("__fp"), "left")
    component = F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return joined.select("doc_id", "text_key", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), "label")


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(table(spark, sf_dir, "documents"), width=3, percent=85).drop("text_key")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the rows kept, unchanged (five-word shingles, similarity 0.8).

    Of a component without any doc_id, the row of the least text hash stays, and of rows that
    share it the least as JSON. Rows that repeat a doc_id and its text stay or go together.
    """
    told = written(_grouped(docs), "minhash-groups")
    nameless = told.where("component_id is null and n_shingles > 0")
    chosen = written(nameless.groupBy("label").agg(F.min("text_key").alias("least")), "minhash-nameless")
    none = chosen.isEmpty()
    gone = told.where("not kept" if none else "not kept or (component_id is null and n_shingles > 0)")
    gone = gone.select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key")).distinct()
    packed, names = pack(docs, "doc_id long", "text string")
    packed = packed.withColumn("__h", F.xxhash64("text")).drop("text")
    on = (F.col("__h") == F.col("__key")) & F.col("doc_id").eqNullSafe(F.col("__id"))
    kept = packed.join(gone, on, "left_anti")
    if none:
        return unpack(kept, names)
    one = packed.where("doc_id is null").join(chosen, F.col("__h") == F.col("least"), "left_semi")
    one = one.groupBy("__h").agg(F.min_by(ROW, F.to_json(ROW)).alias(ROW))
    return unpack(kept.select(ROW).union(one.select(ROW)), names)


_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), g AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
         ELSE list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i : i + 2], ' ')) END) AS s FROM w
), n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS i FROM g a JOIN g b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT u, v FROM p JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * i >= 85 * (x.n + y.n - i)),
e AS (SELECT u, v FROM l UNION ALL SELECT v, u FROM l),
r AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, e.v FROM r JOIN e ON r.other = e.u),
c AS (SELECT doc_id, min(other) AS component_id FROM r GROUP BY doc_id)
SELECT c.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, c.doc_id = component_id AS kept FROM c LEFT JOIN n ON n.doc_id = c.doc_id
"""

QUERIES = {"op9_minhash": op9_minhash}
ORACLE = {"op9_minhash": _SQL}
