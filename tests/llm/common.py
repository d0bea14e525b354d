"""Documents with every awkward row: nulls, empty and long texts, repeats, clashing columns."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words string, kept string, TEXT string, __row string, copies int"


def words(seed, n):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n))


def awkward_rows():
    base = words(1, 120)
    lines = "\n".join(words(100 + i, 9) for i in range(8))
    rows = [
        (1, base, "en", "s1"),
        (2, base, "en", "s1"),
        (3, base + " tail", "en", None),
        (4, None, "en", "s2"),
        (5, "", None, "s2"),
        (6, " \n\t ", "en", "s2"),
        (7, "one two", "de", "s2"),
        (None, base, None, None),
        (None, None, None, None),
        (9, lines, "en", "s3"),
        (10, "new line before\n" + lines + "\nnew line after", "en", "s3"),
        (11, words(2, 30_000), "en", "s3"),
        (12, "x" * 200_000, "en", "s3"),
        (13, "naïve ÉÀ 🙂 ### $$$ | a@b.co 1.2.3.4", "fr", "s1"),
        (13, "naïve ÉÀ 🙂 ### $$$ | a@b.co 1.2.3.4", "fr", "s1"),
        (14, words(3, 60), "en", "s1"),
    ]
    return [(*r, len(r[1] or ""), "w", "k", "T", "r", 1) for r in rows]


def awkward(spark):
    return spark.createDataFrame(awkward_rows(), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def docs(spark, pairs, source="s"):
    return spark.createDataFrame([(i, t, "en", source) for i, t in pairs], "doc_id long, text string, lang string, source string")
