"""Mixing sources to target weights by the cube method.

A document of a source whose target is r times its words is taken floor(r) times, and once more
with probability frac(r). The cube method draws those extra takes so that each source's words
and documents stay at their expected totals: three undecided documents at a time have a
direction in the null-space of both constraints; along it, forwards or backwards with the
chances that keep every probability, until one of them is decided. The flight runs in blocks
of about ``BLOCK`` documents dealt by hash, so that no source meets in one task; each block
leaves two undecided at most, which meet again in the next, smaller round of blocks, and the
two that a source has left at last are landed (the documents' constraint dropped first).

Draws are hashes of the document and the seed: reruns agree, however the rows are dealt.

Rows with equal doc_id, source and text are one unit: of t such rows, floor(t * frac(r)) are taken
once more by rule, and one more by the draw, with what is left of the chance.

Defined cases: a null text has no words, and is taken without effect; null source is a source,
the last; a source without words has target 0; an empty table gives an empty result. Texts of any
length are counted whole; units of equal size are drawn in the order of their hashes. Extra columns
never matter. The targets' windows see one row a source, in one task: for sources, not for hosts.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._common import ROW, WORD, pack, pick, table, unpack, written

WEIGHTS = (5.0, 2.0, 1.0)
SHARE, CEILING = 1.5, 2.0
#: Documents of a source that one task's flight passes through, about.
BLOCK = 8_000
#: Sources up to this number are broadcast; beyond it the join is a shuffled one.
BROADCAST_SOURCES = 50_000
_TINY = 1e-12


def units(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, text_hash and how often such a row occurs; copies of a row are
    counted before the shuffle."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    rows = pick(docs, "doc_id long", "source string", "text string").select("doc_id", "source", size.alias("size"), F.xxhash64("text").alias("text_hash"))
    return rows.groupBy("doc_id", "source", "size", "text_hash").agg(F.count("*").alias("times"))


def targets(of: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, ceiling: float = CEILING) -> DataFrame:
    """source, source_size, target, n_units: one row a source.

    The water level: each target is weight times one level, or the ceiling where that is less;
    the level follows from prefix sums in the order in which sources reach their ceilings. Rows
    here are sources, not documents.
    """
    sums = of.groupBy("source").agg(F.sum(F.col("size") * F.col("times")).alias("source_size"), F.count("*").alias("n_units"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = sums.withColumn("rank", F.row_number().over(order) - 1).withColumn("weight", weight).withColumn("most", ceiling * F.col("source_size"))
    fill = Window.orderBy(F.col("most") / F.col("weight"), "rank")
    before, every = fill.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    level = (share * F.sum("source_size").over(every) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    filled = ranked.withColumn("level", level)
    first = F.struct((F.col("most") / F.col("weight")).alias("full"), "rank", "level")
    water = F.min(F.when(F.col("level") * F.col("weight") <= F.col("most"), first)).over(every)["level"]
    target = F.coalesce(F.least(F.col("weight") * water, F.col("most")), F.col("most"))
    return filled.select("source", "source_size", target.alias("target"), "n_units")


def _draws(ids: np.ndarray, seed: int) -> np.ndarray:
    """Uniform numbers in (0, 1) from 64-bit keys (the splitmix64 finisher)."""
    with np.errstate(over="ignore"):
        z = ids.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        z = z ^ (z >> np.uint64(31))
    return ((z >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53


def _direction(x: list[tuple[float, float]]) -> list[float]:
    """A vector of the null-space of two constraints over three units (or of the second over two)."""
    if len(x) == 2:
        (_, a), (_, b) = x
        return [b, -a] if a or b else [1.0, -1.0]
    (a1, b1), (a2, b2), (a3, b3) = x
    u = [a2 * b3 - a3 * b2, a3 * b1 - a1 * b3, a1 * b2 - a2 * b1]
    if not any(u):  # the constraints are one: two units suffice
        return [b2, -b1, 0.0] if b1 or b2 else [a2, -a1, 0.0]
    return u


def _move(p: list[float], u: list[float], draw: float) -> None:
    """Move p along u or against it until one of them is 0 or 1, keeping its expectation."""
    ahead = min(((1 - p[i]) / u[i] if u[i] > 0 else -p[i] / u[i]) for i in range(len(p)) if u[i])
    back = min((p[i] / u[i] if u[i] > 0 else (p[i] - 1) / u[i]) for i in range(len(p)) if u[i])
    step = ahead if draw * (ahead + back) < back else -back
    for i, ui in enumerate(u):
        v = p[i] + step * ui
        p[i] = 0.0 if v < _TINY else 1.0 if v > 1 - _TINY else v


def flight(p: np.ndarray, docs: np.ndarray, words: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """The flight phase over probabilities p: sums of p*docs and p*words stay; all of the result
    are 0 or 1 but two at most.

    Units come with the largest first. The pool holds the two largest and the smallest that are
    open: the two large ones all but swap, so neither stays open for long, and what is left at
    last is of middling size.
    """
    p = p.astype(float).copy()
    open_ = (p > _TINY) & (p < 1 - _TINY)
    p[~open_] = np.round(p[~open_])
    queue = np.flatnonzero(open_).tolist()
    head, tail = 0, len(queue) - 1
    large: list[int] = []
    small: list[int] = []
    while True:
        while len(large) < 2 and head <= tail:
            large.append(queue[head])
            head += 1
        if not small and head <= tail:
            small.append(queue[tail])
            tail -= 1
        pool = large + small
        if len(pool) < 3:
            return p
        part = [float(p[j]) for j in pool]
        _move(part, _direction([(float(docs[j]), float(words[j])) for j in pool]), float(draws[pool[0]] + draws[pool[1]] + draws[pool[2]]) % 1.0)
        for j, v in zip(pool, part):
            p[j] = v
        large = [j for j in large if 0.0 < p[j] < 1.0]
        small = [j for j in small if 0.0 < p[j] < 1.0]


def land(p: np.ndarray, words: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """The landing: while two are undecided keep their words' expected total; the last by its chance."""
    p = p.astype(float).copy()
    while True:
        open_ = [i for i in range(len(p)) if 0.0 < p[i] < 1.0]
        if not open_:
            return p
        if len(open_) == 1:
            i = open_[0]
            p[i] = 1.0 if draws[i] < p[i] else 0.0
            continue
        a, b = open_[:2]
        part = [float(p[a]), float(p[b])]
        _move(part, _direction([(1.0, float(words[a])), (1.0, float(words[b]))]), float(draws[a]))
        p[a], p[b] = part


_STATE = "doc_id long, source string, size long, text_hash long, times long, source_size long, target double, n_units long, sure long, p double"


def _pass(level: int, last: bool, seed: int):
    def run(t: pa.Table) -> pa.Table:
        key, size = (t[c].to_numpy() for c in ("__key", "size"))
        order = np.lexsort((key, -size))  # the largest first
        t, key, words = t.take(order), key[order], size[order].astype(float)
        p = flight(t["p"].to_numpy(), np.ones(len(key)), words, _draws(key, seed + 2 * level))
        if last:
            p = land(p, words, _draws(key, seed + 2 * level + 1))
        return t.set_column(t.schema.get_field_index("p"), "p", pa.array(p)).drop_columns(["__block", "__key"])

    return run


def sample(of: DataFrame, goals: DataFrame, n_sources: int, largest: int, seed: int = 0) -> DataFrame:
    """The units with ``sure`` and ``p``: how many of their rows are taken once more than
    floor(target / source_size) by rule, and by the draw (1 or 0)."""
    right = goals.withColumnRenamed("source", "__source")
    right = F.broadcast(right) if n_sources <= BROADCAST_SOURCES else right
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    state = of.join(right, F.col("source").eqNullSafe(F.col("__source")), "left").drop("__source")
    chance = F.col("times") * (ratio - F.floor(ratio))
    state = state.withColumn("sure", F.floor(chance).cast("long")).withColumn("p", chance - F.floor(chance))
    decided: list[DataFrame] = []
    level = 0
    while True:
        blocks = max(1, math.ceil(largest / BLOCK))
        n = F.greatest(F.lit(1), F.least(F.lit(blocks), F.ceil(F.col("n_units") / F.lit(BLOCK * (BLOCK // 4) ** level)))).cast("long")
        keyed = state.withColumn("__key", F.xxhash64("doc_id", "text_hash", "size", F.lit(level)))
        grouped = keyed.withColumn("__block", F.pmod("__key", n)).groupBy("source", "__block")
        state = written(grouped.applyInArrow(_pass(level, blocks == 1, seed), _STATE), f"mixing-{level}")
        if blocks == 1:
            return state if not decided else _union([*decided, state])
        decided.append(state.where("p in (0.0, 1.0)"))
        state = state.where("p not in (0.0, 1.0)")
        largest = 2 * blocks
        level += 1


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def mix(docs: DataFrame, seed: int = 0) -> DataFrame:
    """doc_id, source, size, text_hash, times, source_size, target, base and more: the mix takes each
    of a unit's ``times`` rows (equal in doc_id, source and text) base times, and ``more`` of them
    once more."""
    of = written(units(docs), "mixing-units")
    goals = written(targets(of), "mixing-targets")
    n, largest = goals.agg(F.count("*"), F.coalesce(F.max("n_units"), F.lit(0))).first()
    ratio = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    return sample(of, goals, n, largest, seed).withColumn("base", ratio.cast("int")).withColumn("more", F.col("sure") + F.col("p").cast("long")).drop("p", "sure", "n_units")


def taken(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, size, source_size, target (its source's) and taken words."""
    rows = mix(docs).withColumn("__n", F.explode(F.expr("sequence(1L, times)")))
    rows = rows.withColumn("copies", (F.col("base") + (F.col("__n") <= F.col("more")).cast("int")).cast("int"))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken"), "source", "copies")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: each document's row as often as the mix takes it. Of a unit of several rows,
    equal ones are counted first (with partial sums), and different ones ordered by their hash."""
    chosen = mix(docs).where("base > 0 or more > 0")
    chosen = chosen.select(F.col("doc_id").alias("__id"), F.col("source").alias("__source"), F.col("text_hash").alias("__hash"), "times", "base", "more")
    packed, names = pack(docs, "doc_id long", "source string", "text string")
    packed = packed.select(ROW, "doc_id", "source", F.xxhash64("text").alias("__h"))
    on = (F.col("__h") == F.col("__hash")) & F.col("doc_id").eqNullSafe(F.col("__id")) & F.col("source").eqNullSafe(F.col("__source"))
    joined = packed.join(chosen, on)
    one = joined.where("times = 1").select(ROW, (F.col("base") + F.col("more")).alias("copies"))
    several = joined.where("times > 1").groupBy(ROW, "doc_id", "source", "__h", "base", "more").agg(F.count("*").alias("n"))
    before = Window.partitionBy("doc_id", "source", "__h").orderBy(F.xxhash64(F.to_json(ROW))).rowsBetween(Window.unboundedPreceding, -1)
    rest = F.col("more") - F.coalesce(F.sum("n").over(before), F.lit(0))
    several = several.withColumn("rest", rest).select(ROW, (F.col("n") * F.col("base") + F.greatest(F.lit(0), F.least("n", "rest"))).alias("copies"))
    rows = one.unionByName(several).where("copies > 0").withColumn("__one", F.explode(F.expr("sequence(1L, copies)")))
    return unpack(rows, names)


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taken(table(spark, sf_dir, "documents"))


QUERIES = {"op1_mix": op1_mix}
ORACLE: dict[str, str] = {}
