"""N-gram Jaccard join: partitioned universe, pigeonhole on segments, exact verification.

Two sets of sizes a and b link at p percent exactly if they differ in at most
H = (100 - p) * (a + b) / (100 + p) members. Sizes are dealt to bands so that a set links only with
sets of its own band and the one below. A band of smaller partners cuts the universe of hashed
n-grams into as many segments as H + 1 can be for it; of these the first sixteenth are wide. Sets
that link then agree, for every choice of H + 1 units, on some unit: one unit of a segment means that
both subsets in it are equal, a second one (wide segments only) that they differ in one member at
most, by the pigeonhole principle.

Every distinct set is indexed in its own band: a key for each segment's subset, and for wide segments
the one-deletion neighbourhood, a key for each subset without one member. It probes its own band
and the one below with the H + 1 cheapest units; what a unit costs is the number of rows that its keys
meet in the index, by counters over all documents (2**18 of them, an upper bound of each key's count).
So units of empty segments and common subsets are left out where cheaper ones are left. A key is a hash,
so strangers may meet; nothing that links is lost.

Sets that share keys are first compared each with one hub (the set that shares most, of its family). Of two
sets of one hub, a pair that could still link shares something that sets both apart from the hub, and is met
by that; sets of different hubs meet in their keys' groups. In each such group a few leads (those that share
most) are compared with all members of other components, then components are merged; each round has eight
times the leads of the last one, so that a group ends after a few rounds and none is cut off. Before sets
are brought together, a pair must pass a sketch of parities, whose distance never exceeds the number of
members in which two sets differ (``_parity``). All links are confirmed on whole sets.

Defined cases: A-Z counts as a-z; a text of fewer words than an n-gram has its whole sequence as one
member; null texts and texts without words have no set, link with nothing and are their own
component; rows without doc_id link like others, but a component's id is its least doc_id, null only
if it has none; rows that repeat doc_id and text are one set; an empty table gives an empty result. Texts
are whole, however long: one text is held by one task. Extra columns never matter.
"""

from __future__ import annotations

import contextlib
import functools
import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import new_path, pick, slices, table, written
from ._hashing import mix64, stream64
from ._parity import most_apart, near, parities
from .minhash import components, differences, merged, shingle_sets

#: Of so many segments one is wide.
WIDE = 16
COUNTERS = 1 << 18
#: What a subset of no, one, two or more members costs besides the rows that counters tell of.
CHANCE = np.array([1e9, 1e4, 10.0, 0.0])
#: Keys with so many index rows beyond the mean are taken as shared without a look at their group.
HOT = 50_000
#: Leads of a group in the first round, and how many times more in each later one.
FIRST_LEADS, LEADS_GROW = 1, 8
#: Members of a star that one task compares, about.
STAR_ROWS = 512
LARGEST_SET = 1 << 40
_TEXT_AT_ONCE = 400_000
_VALUE, _PLACE, _EXACT, _LESS = stream64(4, 41)
INDEX, PROBE = 1, 2


@functools.lru_cache(maxsize=8)
def bands(percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First size, last size and number of segments of each band."""
    low = 1
    while low < 1000 and most_apart(low, 100 * low // percent, percent) < 1:
        low += 1
    out = []
    while low < LARGEST_SET and percent < 100 and most_apart(low, 100 * low // percent, percent) > 0:
        high = max(low, 100 * low // percent)
        out.append((low, high, most_apart(high, 100 * high // percent, percent) + 1))
        low = high + 1
    cols = np.array(out, np.int64).reshape(-1, 3)
    return cols[:, 0].copy(), cols[:, 1].copy(), cols[:, 2].copy()


def band_of(sizes: np.ndarray, percent: int) -> np.ndarray:
    """Each size's band; -1 for sets that link with equal ones only."""
    return np.searchsorted(bands(percent)[0], sizes, "right") - 1


class Segments:
    """The segments of many sets, each under one band's partition of the universe."""

    def __init__(self, sets: list[np.ndarray], band: np.ndarray, percent: int):
        many = bands(percent)[2][band]
        sizes = np.fromiter(map(len, sets), np.int64, len(sets))
        begin = np.cumsum(many) - many
        self.owner = np.repeat(np.arange(len(sets)), many)
        number = np.arange(len(self.owner)) - begin[self.owner]
        self.wide = number < -(-many // WIDE)[self.owner]
        tokens = np.concatenate(sets)
        of = np.repeat(np.arange(len(sets)), sizes)
        with np.errstate(over="ignore"):
            values = mix64(tokens * _VALUE)
            place = mix64(tokens * _PLACE) >> np.uint64(32)
            segment = begin[of] + ((place * many[of].astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
            total = len(self.owner)
            # sums of 32-bit halves are exact in doubles, for up to 2**21 members a segment
            low = np.bincount(segment, (values & np.uint64(0xFFFFFFFF)).astype(np.float64), total).astype(np.uint64)
            high = np.bincount(segment, (values >> np.uint64(32)).astype(np.float64), total).astype(np.uint64)
            self._sums = low + (high << np.uint64(32))
            self._code = mix64((band[self.owner].astype(np.uint64) << np.uint64(44)) + number.astype(np.uint64))
            self.exact = mix64(self._sums + self._code * _EXACT)
            within = self.wide[segment]
            self.near_segment = segment[within]  # the segment of every member of a wide one
            self._fewer = self._sums[self.near_segment] - values[within]
        self.size = np.bincount(segment, minlength=total)

    def shorter(self, kind: np.uint64, members: slice | np.ndarray = slice(None)) -> np.ndarray:
        """Keys of the wide segments without one member, for every member of them."""
        with np.errstate(over="ignore"):
            return mix64(self._fewer[members] + self._code[self.near_segment[members]] * kind)

    def whole_as_shorter(self, segments: np.ndarray) -> np.ndarray:
        """Keys of whole segments, to meet larger ones without one member."""
        with np.errstate(over="ignore"):
            return mix64(self._sums[segments] + self._code[segments] * _LESS)


def allocate(parts: Segments, need: np.ndarray, cost: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which segments each set probes (exactly; and with one deletion): its ``need`` cheapest units.

    ``cost`` has the rows that a key meets; a second unit of a segment costs what its keys meet, and not
    less than the first. To that comes what subsets of so few members meet by chance: empty ones every
    other set with that segment empty, which counters of a large corpus don't tell from their noise.
    """
    slot = lambda keys: cost[(keys & np.uint64(COUNTERS - 1)).astype(np.int64)]
    chance = lambda members: CHANCE[np.clip(members, 0, len(CHANCE) - 1)]
    first = slot(parts.exact) + chance(parts.size)
    second = np.bincount(parts.near_segment, slot(parts.shorter(_EXACT)), len(first))
    wide = np.flatnonzero(parts.wide)
    second = np.maximum(first[wide], second[wide] + slot(parts.whole_as_shorter(wide)) + chance(parts.size[wide] - 1))
    owner = np.concatenate([parts.owner, parts.owner[wide]])
    order = np.lexsort((np.concatenate([first, second]), owner))  # stable: a segment's first unit comes before its second
    begin = np.searchsorted(owner[order], np.arange(len(need)))
    chosen = np.zeros(len(owner), bool)
    chosen[order[np.arange(len(order)) - begin[owner[order]] < need[owner[order]]]] = True
    twice = np.zeros(len(first), bool)
    twice[wide] = chosen[len(first) :]
    return chosen[: len(first)], twice


def index_keys(sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys that the sets (with a band) are indexed by, and the number of the set of each."""
    band = band_of(np.fromiter(map(len, sets), np.int64, len(sets)), percent)
    parts = Segments(sets, band, percent)
    return np.concatenate([parts.exact, parts.shorter(_LESS)]), np.concatenate([parts.owner, parts.owner[parts.near_segment]])


def keys_of(sets: list[np.ndarray], percent: int, cost: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All keys of sets (with a band), the number of the set and the role (INDEX, PROBE or both) of each."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    own, high = band_of(sizes, percent), bands(percent)[1]
    keys, who, roles = [], [], []

    def add(k: np.ndarray, w: np.ndarray, role) -> None:
        keys.append(k)
        who.append(w)
        roles.append(np.broadcast_to(np.asarray(role, np.uint8), k.shape))

    for below in (0, 1):
        at = np.flatnonzero(own >= below)
        if not at.size:
            continue
        band = own[at] - below
        parts = Segments([sets[i] for i in at], band, percent)
        need = most_apart(sizes[at], np.minimum(sizes[at], high[band]), percent) + 1
        once, twice = allocate(parts, need, cost)
        if below:
            add(parts.exact[once], at[parts.owner[once]], PROBE)
        else:
            add(parts.exact, at[parts.owner], INDEX + PROBE * once)
            add(parts.shorter(_LESS), at[parts.owner[parts.near_segment]], INDEX)
        wide = np.flatnonzero(twice)
        add(parts.whole_as_shorter(wide), at[parts.owner[wide]], PROBE)
        members = np.flatnonzero(twice[parts.near_segment])
        add(parts.shorter(_EXACT, members), at[parts.owner[parts.near_segment[members]]], PROBE)
    return tuple(np.concatenate(x) if x else np.zeros(0, t) for x, t in ((keys, np.uint64), (who, np.int64), (roles, np.uint8)))


@contextlib.contextmanager
def _settings(spark: SparkSession):
    """For one write: small Arrow batches, and shuffle files that go when it ends, as nothing reads them again."""
    own = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "500", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}
    before = {k: spark.conf.get(k) for k in own}
    try:
        for k, v in own.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def _written(df: DataFrame, name: str) -> DataFrame:
    with _settings(df.sparkSession):
        return written(df, name)


def _rows(docs: DataFrame) -> DataFrame:
    return pick(docs, "doc_id long", "text string").select("doc_id", F.xxhash64("text").alias("text_key"), "text")


def _profiles(docs: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """doc_id, text_key, n and fp (equal for equal sets; null if empty) of every row; and the counters
    (slot, n) of index keys, summed in each task before they are shuffled."""

    def run(batches):
        counts = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            texts = batch.column(2).to_pylist()
            sizes, fps = [], []
            for a, b in slices(texts, _TEXT_AT_ONCE):
                sets = shingle_sets(texts[a:b], width)
                sizes += [len(s) for s in sets]
                fps += [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if s.size else None for s in sets]
                banded = [s for s in sets if s.size and band_of(np.array([s.size]), percent)[0] >= 0]
                if banded:
                    keys = index_keys(banded, percent)[0]
                    counts += np.bincount((keys & np.uint64(COUNTERS - 1)).astype(np.int64), minlength=COUNTERS)
            n = len(texts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([False] * n), batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(fps, pa.binary())], names=["counter", "doc_id", "text_key", "n", "fp"]
            )
        used = np.flatnonzero(counts)
        nothing = pa.nulls(len(used), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(used), bool)), pa.array(used), nothing, pa.array(counts[used]), pa.nulls(len(used), pa.binary())], names=["counter", "doc_id", "text_key", "n", "fp"])

    told = _written(_rows(docs).mapInArrow(run, "counter boolean, doc_id long, text_key long, n long, fp binary"), "ngram-profiles")
    counters = told.where("counter").groupBy(F.col("doc_id").alias("slot")).agg(F.sum("n").alias("n"))
    return told.where("not counter").drop("counter"), counters


def _costs(counters: DataFrame) -> np.ndarray:
    """What each counter's keys cost: 1, and the rows beyond the mean. At most COUNTERS rows come to the driver."""
    told = counters.toArrow()
    counts = np.zeros(COUNTERS, np.float64)
    counts[told["slot"].to_numpy()] = told["n"].to_numpy()
    return np.maximum(counts - counts.mean(), 0.0).astype(np.float32) + np.float32(1)


def _texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """cls and text of the classes ``wanted`` (cls, doc_id, text_key); repeats are combined before the shuffle.

    Both sides have the same keys without nulls, so that the join keeps the partitioning of the aggregate.
    """
    keyed = lambda df, *more: df.select("text_key", F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("doc_id").isNull().alias("no_id"), *more)
    keys = ["text_key", "id", "no_id"]
    rows = keyed(_rows(docs), "text").groupBy(*keys).agg(F.first("text").alias("text"))
    return rows.join(keyed(wanted, "cls"), keys).select("cls", "text")


def _shared_keys(texts: DataFrame, width: int, percent: int, cost: np.ndarray) -> DataFrame:
    """key, cls and role of the keys that two classes have at least; written."""
    held = texts.sparkSession.sparkContext.broadcast(cost)

    def run(batches):
        cost = held.value
        for batch in batches:
            ids, all_texts = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            for a, b in slices(all_texts, _TEXT_AT_ONCE):
                sets = shingle_sets(all_texts[a:b], width)
                keys, who, roles = keys_of(sets, percent, cost)
                hot = cost[(keys & np.uint64(COUNTERS - 1)).astype(np.int64)] > HOT
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(4 * ids[a:b][who] + roles), pa.array(hot)], names=["key", "who", "hot"])

    rows = texts.mapInArrow(run, "key long, who long, hot boolean")
    own, role = F.shiftright("who", 2), F.col("who").bitwiseAND(3)
    # a hot key is shared anyway: its rows are dealt by class, so that they needn't meet in one task
    rows = rows.withColumn("hot_part", F.when(F.col("hot"), own).otherwise(-1))
    group = Window.partitionBy("key", "hot_part")
    told = [F.min(own).over(group).alias("lo"), F.max(own).over(group).alias("hi"), F.bit_or(role).over(group).alias("roles"), F.count("*").over(group).alias("many")]
    kept = rows.select("key", own.alias("cls"), role.cast("int").alias("role"), "hot", *told).where("hot or (lo != hi and roles = 3)")
    return _written(kept.select("key", "cls", "role", F.when(F.col("hot"), HOT).otherwise(F.col("many")).alias("many")), "ngram-keys")


@contextlib.contextmanager
def _sets(texts: DataFrame, width: int):
    """cls, n, set (sorted hashes as bytes) and sketch, in a table bucketed by cls: pairs are brought to
    the sets' buckets, round after round, and the sets stay where they are. The table's name goes in the end."""
    spark = texts.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        for batch in batches:
            sets = shingle_sets(batch.column(1).to_pylist(), width)
            sketch = pa.array([parities(s) for s in sets], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.size for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary()), sketch], names=["cls", "n", "set", "sketch"])

    name = f"ngram_sets_{uuid.uuid4().hex}"
    made = texts.repartition(buckets, "cls").mapInArrow(run, "cls long, n long, set binary, sketch array<long>")
    with _settings(spark):
        made.write.format("parquet").bucketBy(buckets, "cls").option("path", new_path(spark, "ngram-sets")).saveAsTable(name)
    try:
        yield spark.table(name)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")  # its files lie in the application's folder, which goes at exit


def _classes(shared: DataFrame, sizes: DataFrame) -> DataFrame:
    """cls, n (size of the set) and score (rows that share its keys) of the classes with shared keys; written."""
    score = shared.groupBy("cls").agg(F.sum(F.col("many") - 1).alias("score"))
    return _written(score.join(sizes, "cls").select("cls", "n", "score"), "ngram-scores")


def _labelled(rows: DataFrame, links: DataFrame | None) -> DataFrame:
    """Add label: the root of the class's component, or the class itself."""
    if links is None:
        return rows.withColumn("label", F.col("cls"))
    right = links.select(F.col("node").alias("__node"), F.col("root").alias("__root"))
    return rows.join(right, F.col("cls") == F.col("__node"), "left").withColumn("label", F.coalesce("__root", "cls")).drop("__node", "__root")


def _by_score():
    """Groups, those first that share most."""
    return Window.partitionBy("key").orderBy(F.desc("score"), F.desc("cls"), "role")


def _meets(percent: int):
    """The condition that a row (cls, role, n) could link with a lead (b, role_b, n_b) by their common key."""
    is_ = lambda c, bit: F.col(c).bitwiseAND(bit) != 0
    roles = (is_("role", INDEX) & is_("role_b", PROBE) & (F.col("n") <= F.col("n_b"))) | (is_("role_b", INDEX) & is_("role", PROBE) & (F.col("n_b") <= F.col("n")))
    return (F.col("cls") != F.col("b")) & roles & (100 * F.least("n", "n_b") >= percent * F.greatest("n", "n_b"))


def _hubs(rows: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """cls and hub of every class (itself if no other is better): the best that any member of any of its groups has in any
    of its own, so that a whole family has one hub; written."""
    group = Window.partitionBy("key")
    lead = F.struct("score", F.col("cls").alias("hub"), F.col("n").alias("n_hub"))
    own = rows.join(classes, "cls").withColumn("own", F.max(lead).over(group)).groupBy("cls").agg(F.max("own").alias("own"))
    sized = 100 * F.least(F.col("n"), F.col("best.n_hub")) >= percent * F.greatest(F.col("n"), F.col("best.n_hub"))
    told = rows.join(own, "cls").withColumn("best", F.max("own").over(group)).select("cls", "best").join(classes, "cls").where(sized)
    chosen = told.groupBy("cls").agg(F.max("best").alias("best")).select(F.col("cls").alias("__c"), F.col("best.hub").alias("hub"))
    out = classes.join(chosen, F.col("cls") == F.col("__c"), "left").select("cls", F.coalesce("hub", "cls").alias("hub"))
    return _written(out, "ngram-hubs")


def _open_groups(rows: DataFrame, labels: DataFrame, done: int) -> DataFrame:
    """key, cls, role, star, lead and what ``labels`` has, of groups with several components and stars and with leads beyond the first
    ``done``; written."""
    group = Window.partitionBy("key")
    told = rows.join(labels, "cls").select("*", *[f(c).over(group).alias(f"{n}_{c}") for c in ("label", "star") for n, f in (("lo", F.min), ("hi", F.max))], F.count_if("lead").over(group).alias("many"))
    return _written(told.where(f"lo_label != hi_label and lo_star != hi_star and many > {done}").select("key", "cls", "role", "star", "lead", *[c for c in labels.columns if c != "cls"]), "ngram-open")


def _pairs(rows: DataFrame, done: int, upto: int, percent: int) -> DataFrame:
    """a, b: leads ``done`` + 1 to ``upto`` of each group as b, with members of other components and stars as a."""
    leads = rows.where("lead").withColumn("place", F.row_number().over(_by_score())).where(F.col("place") <= upto).where(F.col("place") > done)
    leads = leads.select(F.col("key").alias("__k"), *[F.col(c).alias(x) for c, x in (("cls", "b"), ("role", "role_b"), ("n", "n_b"), ("label", "label_b"), ("star", "star_b"))])
    others = (F.col("label") != F.col("label_b")) & (F.col("star") != F.col("star_b"))
    pairs = rows.join(leads, (F.col("key") == F.col("__k")) & others & _meets(percent))
    return pairs.select(F.greatest("cls", "b").alias("a"), F.least("cls", "b").alias("b")).distinct()


def _differing(told: DataFrame) -> DataFrame:
    """key, cls, role, star and lead: members of a star by what sets them apart from its hub.

    Two members that link, one of which doesn't link with the hub, share such a key (see
    :func:`minhash.differences`): a member that the hub lacks, among the first of each, or one that both lack. Edits
    that are independent share none, so copies of one original don't meet here.
    """
    failed = ~F.col("linked")
    sums = told.groupBy("b").agg(F.min(F.when(failed & (F.size("lacks") > 0), F.col("short"))).alias("least"), F.max("gain").alias("most"), F.count_if(failed).alias("n_failed"), F.count("*").alias("many"))
    rows = told.join(sums.where("many > 1 and n_failed > 0").withColumnRenamed("b", "__b"), F.col("b") == F.col("__b"))
    lacks = F.when(failed & (F.col("short") <= F.col("most")), F.col("lacks")).when(F.col("gain") >= F.col("least"), F.slice("lacks", F.lit(1), "few"))
    keys = rows.select("a", failed.alias("lead"), "b", F.explode(F.concat("added", F.coalesce(lacks, F.array().cast("array<long>")))).alias("x"))
    keys = keys.select(F.xxhash64("b", "x", F.lit("apart")).alias("key"), F.col("a").alias("cls"), "lead")
    group = Window.partitionBy("key")
    met = keys.select("*", F.count("*").over(group).alias("many"), F.bool_or("lead").over(group).alias("led")).where("many > 1 and led")
    return _written(met.select("key", "cls", F.lit(INDEX | PROBE).alias("role"), F.col("cls").alias("star"), "lead"), "ngram-apart")


_TOLD = {"linked": pa.bool_(), "short": pa.int64(), "gain": pa.int64(), "few": pa.int32()}
_LISTS = ("added", "lacks")


def _compared(pairs: DataFrame, sets: DataFrame, percent: int, apart: bool = False) -> DataFrame:
    """a, b, linked, on whole sets; with ``apart`` also the rest of :func:`minhash.differences` of a from b; written.
    A hub's or lead's set goes to as many tasks as its star needs."""
    pairs = _written(pairs, "ngram-pairs")
    parts = F.ceil(F.col("many") / STAR_ROWS).cast("int")
    stars = pairs.groupBy(F.col("b").alias("__b")).agg(F.count("*").alias("many")).select("__b", parts.alias("parts"))
    left = pairs.join(stars, F.col("b") == F.col("__b")).select("a", "b", F.pmod(F.xxhash64("a"), "parts").cast("int").alias("salt"))
    left = left.join(sets, F.col("a") == F.col("cls")).select("a", "b", "salt", F.col("set").alias("set_a"))
    right = stars.join(sets, F.col("__b") == F.col("cls")).select("__b", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("__salt"), F.col("set").alias("set_b"))
    rows = left.join(right, (F.col("b") == F.col("__b")) & (F.col("salt") == F.col("__salt"))).select("a", "b", "set_a", "set_b")

    def run(batches):
        for batch in batches:
            told = [differences(*(np.frombuffer(s.as_buffer(), np.uint64) for s in both), percent) for both in zip(batch.column(2), batch.column(3))]
            plain = [pa.array([d[k] for d in told], t) for k, t in _TOLD.items()]
            lists = [pa.array([d[k].view(np.int64) if apart else () for d in told], pa.list_(pa.int64())) for k in _LISTS]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *plain, *lists], names=["a", "b", *_TOLD, *_LISTS])

    return _written(rows.mapInArrow(run, "a long, b long, linked boolean, short long, gain long, few int, added array<long>, lacks array<long>"), "ngram-compared")


def _links(shared: DataFrame, classes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """node, root of all classes that link with another."""
    rows, done, upto = shared.select("key", "cls", "role"), 0, FIRST_LEADS
    hubs = _hubs(rows, classes, percent)
    first = _compared(hubs.where("cls != hub").select(F.col("cls").alias("a"), F.col("hub").alias("b")), sets, percent, True)
    # members of one star meet by what sets them apart, those of several by their segments
    rows = rows.join(hubs, "cls").select("key", "cls", "role", F.col("hub").alias("star"), F.lit(True).alias("lead")).unionByName(_differing(first))
    known, most = first.select("a", "b", "linked"), classes.count()
    links = components(known.where("linked").select("a", "b"))
    while True:  # a group's leads grow by a factor each round, so rounds are few
        opened = _open_groups(rows, _written(_labelled(classes, links), "ngram-labels"), done)
        if opened.isEmpty():
            return links
        rows = opened.select("key", "cls", "role", "star", "lead")  # a group that is one component stays so
        pairs = near(_pairs(opened, done, upto, percent), sets.select(F.col("cls").alias("id"), "n", "sketch"), percent)
        old = known.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        told = _compared(pairs.join(old, ["a", "b"], "left_anti"), sets, percent).select("a", "b", "linked")
        known, fresh = known.unionByName(told), told.where("linked").select("a", "b")
        if not fresh.isEmpty():
            links = merged(links, fresh, most)
        done, upto = upto, upto * LEADS_GROW


def groups(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, text_key (xxhash64 of the text), n_shingles and component_id of every row."""
    told, counters = _profiles(docs, width, percent)
    least_size = bands(percent)[0][:1]
    chosen = told.where("n > 0").groupBy("fp").agg(F.min(F.struct("doc_id", "text_key")).alias("r"), F.first("n").alias("n"))
    # numbers are given by the write, so they are unique and stay
    classes = _written(chosen.select(F.monotonically_increasing_id().alias("cls"), "fp", "n", "r.doc_id", "r.text_key"), "ngram-classes")
    if least_size.size:
        banded = classes.where(F.col("n") >= int(least_size[0]))
        shared = _shared_keys(_texts_of(docs, banded.select("cls", "doc_id", "text_key")), width, percent, _costs(counters))
        sharing = _classes(shared, classes.select("cls", "n"))
        wanted = sharing.select("cls").join(classes, "cls").select("cls", "doc_id", "text_key")
        with _sets(_texts_of(docs, wanted), width) as sets:
            links = _links(shared, sharing, sets, percent)
    else:
        links = None
    ids = _labelled(classes.select("cls", "fp", F.col("doc_id").alias("least")), links)
    # a class's chosen row has a null doc_id if any has one, so its least doc_id is taken from the rows
    known = told.where("n > 0").groupBy("fp").agg(F.min("doc_id").alias("least")).withColumnRenamed("fp", "__f")
    ids = ids.drop("least").join(known, F.col("fp") == F.col("__f"))
    whole = ids.groupBy("label").agg(F.min("least").alias("component_id"))
    ids = ids.join(whole, "label").select(F.col("fp").alias("__fp"), "component_id")
    joined = told.join(ids, F.col("fp") == F.col("__fp"), "left")
    component = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return joined.select("doc_id", "text_key", F.col("n").alias("n_shingles"), component.alias("component_id"))


def op11_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups(table(spark, sf_dir, "documents"), width=4, percent=85).drop("text_key")


_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), g AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
         ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i : i + 3], ' ')) END) AS s FROM w
), n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS i FROM g a JOIN g b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT u, v FROM p JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * i >= 85 * (x.n + y.n - i)),
e AS (SELECT u, v FROM l UNION ALL SELECT v, u FROM l),
r AS (SELECT doc_id, doc_id AS other FROM documents UNION SELECT r.doc_id, e.v FROM r JOIN e ON r.other = e.u),
c AS (SELECT doc_id, min(other) AS component_id FROM r GROUP BY doc_id)
SELECT c.doc_id, coalesce(n.n, 0) AS n_shingles, component_id FROM c LEFT JOIN n ON n.doc_id = c.doc_id
"""

QUERIES = {"op11_ngram_join": op11_ngram_join}
ORACLE = {"op11_ngram_join": _SQL}
