"""Personal data: base patterns, and identifiers found by bootstrapped contexts; DataFrame
operations only.

Base spans are e-mail and IP addresses, card and phone numbers by fixed patterns and checks. They
also seed a bootstrap, together with tokens of the shape that secrets have (32 characters or more of
letters and digits, with both): every identifier-like token of the corpus (and every base entity)
is an instance, and the words around it are its lexical patterns - the two words before it, the
word before with the word after, the word before. Patterns and instances form a bipartite graph that
Spark scores in rounds: a pattern's confidence for a kind is the share, smoothed, of its distinct
values that are entities of that kind, where values of other kinds are errors and values of no
known kind, which the pattern may be there to find, count ``UNSEEN`` of one; an instance's score
is the chance that not all its patterns err; and instances that score enough are entities in the
next round. Tokens of no base kind that confident patterns find become spans: of the kind ``secret``
where the patterns are those of secrets, else ``id``. The shape of a secret alone makes no span.

All regular expressions are linear and don't recurse: runs are matched possessively, and only from
where a run begins or the last match ended. Words of a context are whole, however long. Offsets are
code points, end exclusive; spans of different kinds may overlap, added ones overlap none.

Defined cases: null texts count as empty; rows with equal doc_id and text get equal results and
count once as evidence; texts of any length are searched whole; an empty table gives an empty
result. If patterns of several kinds find a token, or a pattern has as many entities of two kinds, the kind decides
that comes later among SEEDS for tokens, and earlier for patterns, so reruns agree. Extra columns never matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import frequent, let, pick, table, written

EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
#: On texts in which a lone blank or hyphen between digits has become \x01.
CARD = "[0-9][0-9\x01]+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_WS = r"\x20\x09-\x0D"
#: Anything that may identify: a phone number, a card number, or a token with a digit or an @.
INSTANCE = rf"{PHONE}|(?<![0-9])[0-9](?:[\x20-]?[0-9]){{12,18}}(?![0-9])|(?:\G|(?<![^{_WS}]))[^{_WS}0-9@+]*+[0-9@+][^{_WS}]*+"
KINDS = ("email", "ip", "card", "phone")
#: Kinds that seed the bootstrap, and names of all spans' kinds, by number.
SEEDS = (*KINDS, "secret")
SPAN_KINDS = (*KINDS, "id", "secret")
#: A pattern needs so many distinct values and documents, and so much confidence; an instance its score.
LEAST_VALUES, LEAST_CONFIDENCE, LEAST_SCORE = 5, 0.8, 0.8
ROUNDS = 3
#: What a value of no known kind counts against a pattern: five entities and two of these are still enough.
UNSEEN = 0.125
#: Letters and digits that a discovered value has at least.
LEAST_LENGTH = 5
#: Characters that a token has at least to be of the shape of a secret.
SECRET_LENGTH = 32
#: So many confident patterns, and found values, the most frequent ones, are broadcast (about 40 bytes each), whatever there is beside them.
BROADCAST_PATTERNS = 50_000
_BLOCK = 64
_WORDS_BEFORE, _WORD_AFTER = rf"^[{_WS}]*+[^{_WS}]*+(?:[{_WS}]++[^{_WS}]++)?+", rf"^[{_WS}]*+[^{_WS}]*+"


_MATCHES = "array<struct<start:int,end:int,value:string,before:string,after:string>>"


def _last_words(gap: Column) -> Column:
    """The last two words of a gap, found from its end."""
    return F.reverse(F.regexp_extract(F.reverse(gap), _WORDS_BEFORE, 0))


def matches(text: Column, pattern: str, context: bool = False) -> Column:
    """start, end, value of every match of the pattern, leftmost first and non-overlapping, and
    (context) the last two words of the gap before it and the first of the gap after it.

    Offsets are running sums of the lengths of matches and gaps. The fold appends to blocks, and
    full blocks to the list of blocks, so long arrays aren't copied for each element.
    """
    values, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    none = F.lit("")
    before = _last_words if context else lambda g: none
    after = (lambda g: F.regexp_extract(g, _WORD_AFTER, 0)) if context else lambda g: none
    ahead = F.zip_with(gaps, F.slice(gaps, F.lit(2), F.lit(2**31 - 1)), lambda g, n: F.struct(F.length(g).alias("skip"), before(g).alias("before"), after(n).alias("after")))
    paired = F.filter(F.zip_with(values, ahead, lambda v, g: F.struct(v.alias("value"), g.alias("gap"))), lambda p: p["value"].isNotNull())
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(_MATCHES).alias("block"), F.array().cast(f"array<{_MATCHES}>").alias("done"))

    def step(acc: Column, p: Column) -> Column:
        start = acc["at"] + p["gap"]["skip"]
        end = start + F.length(p["value"])
        one = F.array(F.struct(start.alias("start"), end.alias("end"), p["value"].alias("value"), p["gap"]["before"].alias("before"), p["gap"]["after"].alias("after")))
        full = F.size(acc["block"]) >= _BLOCK
        return F.struct(
            end.alias("at"),
            F.when(full, one).otherwise(F.concat(acc["block"], one)).alias("block"),
            F.when(full, F.concat(acc["done"], F.array(acc["block"]))).otherwise(acc["done"]).alias("done"),
        )

    return F.aggregate(paired, zero, step, lambda acc: F.concat(F.flatten(acc["done"]), acc["block"]))


def _if_any(needed: Column, found: Column) -> Column:
    """found where the text has what every match needs, else nothing: most texts have none of it,
    and are spared the pattern's passes."""
    return F.when(needed, found).otherwise(F.array().cast(_MATCHES))


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def _ip_valid(v: Column) -> Column:
    return F.forall(F.split(v, r"\."), lambda p: F.regexp_replace(p, "^0++(?=[0-9])", "").rlike("^(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))


def _card_valid(v: Column) -> Column:
    digits = _digits(v)
    doubled = lambda d: F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 1, doubled(c.cast("int"))).otherwise(c.cast("int")))
    return F.length(digits).between(13, 19) & (F.aggregate(each, F.lit(0), lambda s, x: s + F.coalesce(x, F.lit(0))) % 10 == 0)


def _phone_valid(v: Column) -> Column:
    return F.length(_digits(v)).between(9, 15)


def marked(text: Column) -> Column:
    """The text with \\x01 for each lone blank or hyphen between digits (and \\x02 for any \\x01)."""
    return F.regexp_replace(F.translate(text, "\x01", "\x02"), r"(?<=[0-9])[\x20-](?=[0-9])", "\x01")


def base_spans(text: Column) -> Column:
    """kind (its number), start and end of all base spans, by kind and start."""
    kinds = (
        _if_any(F.contains(text, F.lit("@")), matches(text, EMAIL)),
        F.filter(_if_any(text.rlike(r"[0-9]\.[0-9]"), matches(text, IP)), lambda m: _ip_valid(m["value"])),
        F.filter(_if_any(text.rlike(r"[0-9](?:[\x20-]?[0-9]){12}"), matches(marked(text), CARD)), lambda m: _card_valid(m["value"])),
        F.filter(_if_any(F.contains(text, F.lit("+")), matches(text, PHONE)), lambda m: _phone_valid(m["value"])),
    )

    def numbered(kind: int, found: Column) -> Column:
        return F.transform(found, lambda m: F.struct(F.lit(kind).alias("kind"), m["start"].alias("start"), m["end"].alias("end")))

    return F.concat(*[numbered(n, k) for n, k in enumerate(kinds)])


def instances(text: Column) -> Column:
    """Every identifier-like token or base entity: start, end, value (without the punctuation
    around it), kind (its number among SEEDS, null if none) and keys of its lexical patterns."""

    def words(s: Column) -> Column:
        return F.filter(F.split(F.lower(s), rf"[{_WS}]+"), lambda w: w != "")

    def one(m: Column) -> Column:
        glue = F.regexp_extract(m["value"], r"^[^A-Za-z0-9+]*+", 0)
        value = F.regexp_extract(m["value"], r"^[^A-Za-z0-9+]*+(.*[A-Za-z0-9]|)", 1)
        bound = F.struct((m["start"] + F.length(glue)).alias("start"), glue.alias("glue"), value.alias("value"), words(m["before"]).alias("before"), F.get(words(m["after"]), F.lit(0)).alias("after"))

        def told(x: Column) -> Column:
            last, second = F.try_element_at(x["before"], F.lit(-1)), F.try_element_at(x["before"], F.lit(-2))
            return F.struct(x["start"].alias("start"), (x["start"] + F.length(x["value"])).alias("end"), x["value"].alias("value"), _kind_of(x["value"]).alias("kind"), _patterns(second, last, x["after"], x["glue"]).alias("patterns"))

        return let(bound, told)

    return F.filter(F.transform(_if_any(text.rlike("[0-9@+]"), matches(text, INSTANCE, True)), one), lambda x: F.length(F.regexp_replace(x["value"], "[^A-Za-z0-9]", "")) >= LEAST_LENGTH)


def _patterns(second: Column, last: Column, after: Column, glue: Column) -> Column:
    """Hashes of up to three contexts; ``glue`` is the punctuation just before the value."""
    return F.filter(
        F.array(
            F.when(second.isNotNull(), F.xxhash64(F.lit("two before"), second, last, glue)),
            F.when(last.isNotNull() & after.isNotNull(), F.xxhash64(F.lit("around"), last, glue, after)),
            F.when(last.isNotNull(), F.xxhash64(F.lit("before"), last, glue)),
        ),
        lambda p: p.isNotNull(),
    )


def _kind_of(v: Column) -> Column:
    whole = lambda p: v.rlike(f"^(?:{p})$")
    return (
        F.when(whole(EMAIL), 0)
        .when(whole(IP) & _ip_valid(v), 1)
        .when(whole(r"[0-9](?:[\x20-]?[0-9]){12,18}") & _card_valid(v), 2)
        .when(whole(PHONE) & _phone_valid(v), 3)
        .when(whole(rf"(?=[0-9]*+[A-Za-z])(?=[A-Za-z]*+[0-9])[A-Za-z0-9]{{{SECRET_LENGTH},}}+"), 4)
    )


def _scored_patterns(edges: DataFrame) -> DataFrame:
    """pattern, kind, confidence of patterns with enough support: edges are (pattern, value, doc,
    kind, weight), a kind for entities only. Values count once a pattern, by partial sums."""
    one = edges.groupBy("pattern", "value").agg(F.max("kind").alias("kind"), F.max("doc").alias("doc"), F.max("weight").alias("weight"), F.count("*").alias("rows"))
    sums = [F.sum(F.when(F.col("kind") == k, F.col("weight")).otherwise(0.0)).alias(f"k{k}") for k in range(len(SEEDS))]
    told = one.groupBy("pattern").agg(F.count("*").alias("values"), F.min("doc").alias("lo"), F.max("doc").alias("hi"), F.sum("rows").alias("rows"), *sums)
    best = F.greatest(*[F.col(f"k{k}") for k in range(len(SEEDS))])
    known = sum((F.col(f"k{k}") for k in range(1, len(SEEDS))), F.col("k0"))
    smoothed = known + UNSEEN * (F.col("values") - known) + 1
    kind = F.coalesce(*[F.when(F.col(f"k{k}") == best, F.lit(k)) for k in range(len(SEEDS))])
    sure = told.select("pattern", "values", "lo", "hi", "rows", kind.alias("kind"), best.alias("best"), (best / smoothed).alias("confidence"))
    return sure.where((F.col("best") >= LEAST_VALUES) & (F.col("lo") != F.col("hi")) & (F.col("confidence") >= LEAST_CONFIDENCE)).select(F.col("pattern").alias("__pattern"), F.col("kind").alias("p_kind"), "confidence", F.col("rows").alias("__n"))


def _met(rows: DataFrame, column: str, keyed: DataFrame, key: str, outer: bool) -> DataFrame:
    """The rows with what ``keyed`` (unique in ``key``, with the number of rows __n) has for their column: the most frequent keys
    are broadcast, the others dealt by the key. With ``outer``, rows without a key stay as well."""
    if keyed.count() <= BROADCAST_PATTERNS:  # all of them, also those that one row has
        return rows.join(F.broadcast(keyed.drop("__n")), F.col(column) == F.col(key), "left" if outer else "inner")
    few = frequent(keyed, "__n", key, most=BROADCAST_PATTERNS)
    own = F.broadcast(few.drop("__n"))
    rest = keyed.join(F.broadcast(few.select(key)), key, "left_anti").drop("__n")
    hit = rows.join(own, F.col(column) == F.col(key))
    others = rows.join(F.broadcast(few.select(key)), F.col(column) == F.col(key), "left_anti")
    return hit.unionByName(others.join(rest, F.col(column) == F.col(key), "left" if outer else "inner"))


def discover(seen: DataFrame) -> DataFrame:
    """doc_id, text_key, start, end and kind (its number among SPAN_KINDS) of the identifiers that
    the bootstrap finds.

    seen: doc_id, text_key, start, end, value, kind, patterns: one row an instance.
    """
    rows = seen.select("doc_id", "text_key", "start", "end", F.xxhash64("value").alias("value"), F.xxhash64("doc_id", "text_key").alias("doc"), "kind", F.explode("patterns").alias("pattern"))
    edges = written(rows, "pii-edges")
    scores: DataFrame | None = None
    for step in range(ROUNDS):
        now = edges.withColumn("weight", F.when(F.col("kind").isNotNull(), 1.0).otherwise(0.0))
        if scores is not None:  # what was found counts with its score from now on
            found = scores.select(F.col("value").alias("__value"), F.col("kind").alias("__kind"), F.col("score").alias("__score"), "__n")
            now = _met(now, "value", found, "__value", True)
            now = now.withColumn("weight", F.greatest("weight", F.coalesce("__score", F.lit(0.0)))).withColumn("kind", F.coalesce("kind", "__kind"))
        patterns = written(_scored_patterns(now), "pii-patterns")
        n = patterns.count()
        hits = _met(edges.where(f"kind is null or kind >= {len(KINDS)}"), "pattern", patterns, "__pattern", False)
        if step == ROUNDS - 1 or not n:
            break
        one = hits.groupBy("value", "pattern").agg(F.max("confidence").alias("confidence"), F.max("p_kind").alias("kind"), F.count("*").alias("rows"))
        fresh = one.groupBy("value").agg((1 - F.exp(F.sum(F.ln(1 - F.least("confidence", F.lit(0.999)))))).alias("score"), F.max("kind").alias("kind"), F.max("rows").alias("__n"))
        scores = written(fresh.where(F.col("score") >= LEAST_SCORE), "pii-scores")
    score = (1 - F.exp(F.sum(F.ln(1 - F.least("confidence", F.lit(0.999)))))).alias("score")
    each = hits.groupBy("doc_id", "text_key", "start", "end").agg(score, F.max("p_kind").alias("p_kind")).where(F.col("score") >= LEAST_SCORE)
    return each.select("doc_id", "text_key", "start", "end", F.when(F.col("p_kind") >= len(KINDS), len(SPAN_KINDS) - 1).otherwise(len(KINDS)).alias("kind"))


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in SPAN_KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _each(told: DataFrame) -> DataFrame:
    """One row an instance of the rows' ``seen``; rows that repeat count once."""
    return told.select("doc_id", "text_key", F.explode("seen").alias("s")).select("doc_id", "text_key", "s.*").distinct()


def held_back(docs: DataFrame, one_in: int = 5) -> DataFrame:
    """kind, held and found: seeds of every kind whose hash is divisible by ``one_in``, which are kept from the bootstrap as if
    they were of no kind, and how many of them its contexts find. So it tells how much of what seeds know of is found
    without them."""
    rows = pick(docs, "doc_id long", "text string").withColumn("text", F.coalesce("text", F.lit("")))
    each = written(_each(rows.select("doc_id", F.xxhash64("text").alias("text_key"), instances(F.col("text")).alias("seen"))), "pii-seen")
    held = F.col("kind").isNotNull() & (F.pmod(F.xxhash64("value"), F.lit(one_in)) == 0)
    kept = each.where(held).select("doc_id", "text_key", "start", "end", F.get(F.array(*[F.lit(k) for k in SEEDS]), F.col("kind")).alias("kind"))
    found = discover(each.withColumn("kind", F.when(~held, F.col("kind")))).select("doc_id", "text_key", "start", "end").distinct().withColumn("hit", F.lit(1))
    on = ["text_key", "start", "end"]
    same = [F.col(f"k.{c}") == F.col(f"f.{c}") for c in on] + [F.col("k.doc_id").eqNullSafe(F.col("f.doc_id"))]
    return kept.alias("k").join(found.alias("f"), same, "left").groupBy("kind").agg(F.count("*").alias("held"), F.count("hit").alias("found"))


def find(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, base and all (arrays of kind, start and end; kinds by number in SPAN_KINDS) of every row."""
    rows = pick(docs, "doc_id long", "text string").withColumn("text", F.coalesce("text", F.lit("")))
    text = F.col("text")
    told = written(rows.select("doc_id", F.xxhash64("text").alias("text_key"), base_spans(text).alias("base"), instances(text).alias("seen")), "pii-base")
    more = discover(_each(told)).groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_list(F.struct("kind", "start", "end"))).alias("more"))
    more = more.select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key"), "more")
    on = (F.col("text_key") == F.col("__key")) & F.col("doc_id").eqNullSafe(F.col("__id"))
    joined = told.join(more, on, "left")
    lone = F.filter("more", lambda m: ~F.exists("base", lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"])))
    return joined.select("doc_id", "text_key", "base", F.when(F.col("more").isNull(), F.col("base")).otherwise(F.concat("base", lone)).alias("all"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find(table(spark, sf_dir, "documents"))

    def count(kind: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{KINDS[kind]}")

    return found.select("doc_id", *[count(k) for k in range(len(KINDS))], F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("all")).alias("spans"))


QUERIES = {"op6_pii": op6_pii}
ORACLE: dict[str, str] = {}
