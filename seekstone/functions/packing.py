"""Units of text packed into blocks of a token budget, each beginning with the tail of the one before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seekstone.functions import text as tx


def _chain(back: Column, forward: Column, n: Column, dedupe: bool) -> Column:
    """array of (first, last) unit, from 1: jumps from each block's end to the next one's.

    back[e]: the unit before the tail that a block ending with unit e leaves; forward[s]: the unit with
    which a block that begins after unit s is full, or null.
    """
    kind = "struct<start:int,end:int,blocks:array<struct<first:int,last:int>>>"

    def block(first: Column, last: Column) -> Column:
        return F.array(F.struct((first + 1).alias("first"), last.alias("last")))

    def jump(s: Column, _: Column) -> Column:
        start = F.get(back, s["end"])
        full = F.get(forward, start)
        end = F.when(full.isNotNull(), F.greatest(s["end"] + 1, full))  # a unit is added before the budget is looked at
        end = F.when(end <= n, end)
        moved = F.struct(start.alias("start"), end.alias("end"), F.concat(s["blocks"], block(s["start"], s["end"])).alias("blocks"))
        return F.when(s["end"].isNull(), s).otherwise(moved.cast(kind))

    def rest(s: Column) -> Column:
        last = F.element_at(s["blocks"], -1)["last"]
        nothing_new = (F.size(s["blocks"]) > 0) & (last == n) if dedupe else F.lit(False)
        return F.when(nothing_new, s["blocks"]).otherwise(F.concat(s["blocks"], block(s["start"], n)))

    none = F.array().cast("array<struct<first:int,last:int>>")
    begin = F.struct(F.lit(0).alias("start"), F.get(forward, F.lit(0)).alias("end"), none.alias("blocks")).cast(kind)
    return F.when(n > 0, F.aggregate(F.sequence(F.lit(1), n), begin, jump, rest)).otherwise(none)


def pack_units(units: DataFrame, keys: list[str], budget: int = 400, overlap: int = 50, dedupe: bool = False) -> DataFrame:
    """keys, ordinal, start_line, end_line, text and n_tokens of the blocks of every key's units.

    units: the keys, pos (1, 2, ...), start_line, end_line, text. A block takes units until it has
    ``budget`` tokens; the next one begins with the shortest tail of it that has ``overlap``. What is
    left at the end is a block too, even if it is that tail alone, unless ``dedupe`` is set.

    Prefix sums and, by range frames over them, every unit's jump back (to its tail) and forward (to a
    full block) are windows over one sort a key; a fold then follows the jumps. Keys lie in one partition
    throughout, so nothing is shuffled but the units.
    """
    if not 0 <= overlap <= budget:
        raise ValueError("the overlap lies between 0 and the budget")
    dealt = units.repartition(*keys).withColumn("__t", tx.token_count(F.col("text")).cast("long"))
    # unit 0 stands before the first one, with no tokens
    mine = F.struct("pos", "start_line", "end_line", "text", "__t").cast("struct<pos:int,start_line:int,end_line:int,text:string,t:bigint>")
    nought = F.struct(F.lit(0), F.lit(None), F.lit(None), F.lit(None), F.lit(0)).cast("struct<pos:int,start_line:int,end_line:int,text:string,t:bigint>")
    rows = dealt.select(*keys, F.explode(F.when(F.col("pos") == 1, F.array(nought, mine)).otherwise(F.array(mine))).alias("__u")).select(*keys, "__u.*")
    rows = rows.withColumn("upto", F.sum("t").over(Window.partitionBy(*keys).orderBy("pos")))
    by_sum = Window.partitionBy(*keys).orderBy("upto")
    back = F.max("pos").over(by_sum.rangeBetween(Window.unboundedPreceding, -overlap))
    full = F.min("pos").over(by_sum.rangeBetween(budget, Window.unboundedFollowing))
    rows = rows.withColumn("back", F.least(back, F.col("pos") - 1)).withColumn("full", full)
    one = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("pos", "back", "full", "start_line", "end_line", "text", "upto"))).alias("__r"))
    n = F.size("__r") - 1
    blocks = one.withColumn("__b", _chain(F.transform("__r", lambda r: r["back"]), F.transform("__r", lambda r: r["full"]), n, dedupe))
    out = blocks.select(*keys, "__r", F.posexplode("__b").alias("ordinal", "__x"))
    first, last = F.col("__x.first"), F.col("__x.last")
    text = F.array_join(F.transform(F.slice("__r", first + 1, last - first + 1), lambda r: r["text"]), "\n")
    tokens = F.get("__r", last)["upto"] - F.get("__r", first - 1)["upto"]
    return out.select(*keys, "ordinal", F.get("__r", first)["start_line"].alias("start_line"), F.get("__r", last)["end_line"].alias("end_line"), text.alias("text"), tokens.cast("int").alias("n_tokens"))


def line_units(rows: DataFrame, keys: list[str], column: str) -> DataFrame:
    """The lines of texts that aren't blank as units."""
    numbered = F.transform(tx.lines(F.col(column)), lambda line, i: F.struct((i + 1).cast("int").alias("line"), line.alias("text")))
    kept = F.filter(numbered, lambda x: ~tx.is_blank(x["text"]))
    cut = rows.repartition(*keys).select(*keys, F.posexplode(kept).alias("at", "u"))
    return cut.select(*keys, (F.col("at") + 1).alias("pos"), F.col("u.line").alias("start_line"), F.col("u.line").alias("end_line"), F.col("u.text").alias("text"))


def pack_lines(rows: DataFrame, keys: list[str], column: str, budget: int = 400, overlap: int = 50, dedupe: bool = False) -> DataFrame:
    """Blocks of lines within a token budget; see :func:`pack_units`."""
    return pack_units(line_units(rows, keys, column), keys, budget, overlap, dedupe)
