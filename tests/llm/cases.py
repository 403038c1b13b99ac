"""Odd documents, and plain versions of what operators compute."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def prose(seed, n, vocabulary=400):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" + ("." if r.random() < 0.1 else "") for _ in range(n))


SHARED = prose(99, 60)

#: (doc_id, text, lang, source, n_chars): nulls, empty and long texts, repeated rows, copies, near copies, shared passages.
ROWS = [
    (1, prose(1, 300), "en", "a", 1),
    (2, prose(1, 300), "en", "a", 1),
    (2, prose(1, 300), "en", "a", 1),
    (3, prose(1, 300).replace("w1 ", "zz ", 1), "en", None, 1),
    (4, None, None, None, None),
    (5, "", "en", "b", 0),
    (6, " \n\t ", "en", "b", 4),
    (7, f"{prose(7, 50)} {SHARED} {prose(8, 50)}", "en", "b", 1),
    (8, f"{prose(9, 40)}\n{SHARED}", "de", "b", 1),
    (9, "one two three", "en", "c", 13),
    (10, "one two three", "en", "c", 13),
    (None, prose(1, 300), "en", "c", 1),
    (None, "é ü \U0001f600 <|endoftext|> x", "en", "c", 1),
    (11, prose(11, 9000, 3000), "en", "a", 1),
    (12, prose(12, 40) + " x" * 200, "en", "a", 1),
    (13, "\n".join([prose(13, 12)] * 6), "en", "a", 1),
]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def odd(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def clashing(spark, names):
    """odd() with further columns by names that operators use themselves."""
    from pyspark.sql import functions as F

    return odd(spark).withColumns({n: F.lit("kept") for n in names})
