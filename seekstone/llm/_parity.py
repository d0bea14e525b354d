"""Sketches of sets by parities: an exact lower bound of the number of members in which two sets differ."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._hashing import mix64, stream64

#: 64-bit words of the smallest sketch.
LEAST_WORDS = 16
_PARITY = stream64(5, 41)[4]


def parities(members: np.ndarray) -> np.ndarray:
    """The parity of the number of members hashed to each of its bits, as 64-bit words; four bits a
    member at least, and a power of two of words."""
    words = max(LEAST_WORDS, 1 << (len(members) // 16).bit_length())
    with np.errstate(over="ignore"):
        at = (mix64(members * _PARITY) & np.uint64(64 * words - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=64 * words) & 1).astype(np.uint8)).view(np.int64)


def most_apart(a, b, percent: int):
    """The most members in which sets of these sizes differ that link at ``percent``."""
    return (100 - percent) * (a + b) // (100 + percent)


def near(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b, ...) whose sketches (id, n, sketch) don't rule a link out. No link is lost, as
    parities differ in no more places than sets do."""
    own = lambda side: sketches.select(F.col("id").alias(f"__{side}"), F.col("n").alias(f"__n{side}"), F.col("sketch").alias(f"__s{side}"))
    rows = pairs.join(own("a"), F.col("a") == F.col("__a")).join(own("b"), F.col("b") == F.col("__b"))
    differ = lambda x, y: x.bitwiseXOR(y)

    def folded(mine: Column, other: Column) -> Column:
        """A sketch in half as many words, if the other has fewer: its halves are laid over each other."""
        half = (F.size(mine) / 2).cast("int")
        return F.when(F.size(mine) > F.size(other), F.zip_with(F.slice(mine, F.lit(1), half), F.slice(mine, half + 1, half), differ)).otherwise(mine)

    same = rows.withColumn("__x", folded(F.col("__sa"), F.col("__sb"))).withColumn("__y", folded(F.col("__sb"), F.col("__sa")))
    apart = F.aggregate(F.zip_with("__x", "__y", lambda x, y: F.bit_count(differ(x, y))), F.lit(0), lambda total, x: total + x)
    most = F.floor((100 - percent) * (F.col("__na") + F.col("__nb")) / (100 + percent))
    # sketches of other lengths, of sizes more than a factor of two apart, aren't comparable
    return same.where((F.size("__x") != F.size("__y")) | (apart <= most)).select(*pairs.columns)
