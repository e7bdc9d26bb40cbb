"""Tables of awkward rows that every document operator must take."""

import random

from pyspark.sql import types as T

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # Names that operators use inside.
        T.StructField("digest", T.StringType()),
        T.StructField("norm", T.IntegerType()),
        T.StructField("shard", T.StringType()),
        T.StructField("length", T.StringType()),
        T.StructField("kept", T.BooleanType()),
        T.StructField("fingerprint", T.StringType()),
        T.StructField("hash", T.StringType()),
    ]
)
EXTRA = ("x", 7, "s", "l", False, "f", "h")


def words(n, seed, vocabulary=400):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}{'.' if r.random() < 0.1 else ''}" for _ in range(n))


def texts():
    long = words(6000, 5)
    base = words(120, 1)
    return [
        (1, None),
        (2, ""),
        (3, "   \n\t "),
        (4, base),
        (5, base.upper()),
        (6, base + " tail"),
        (7, "Äpfel und Öl, ÉTÉ — naïve 漢字かな交じり文 😀😀   x\x1cy"),
        (8, "#*$%&|<> " * 40),
        (9, long),
        (10, long + " " + words(3000, 6)),
        (11, "a" * 5000),
        (12, "same line\nsame line\nother\n\n\nsame line \n" * 3),
        (13, base),
        (14, base),
        (15, "one two three four five " * 30),
        (16, "It's they're I'll <|endoftext|> <|startoftext|> don't"),
        (17, "x"),
        (18, "Ab́c été İstanbul ΣΊΣΥΦΟΣ"),
        (19, "" + words(60, 8)),
        (20, words(60, 9)),
    ]


def table(spark, rows=None):
    rows = texts() if rows is None else rows
    full = [(i, t, "en", "src0", None if t is None else len(t), *EXTRA) for i, t in rows]
    return spark.createDataFrame(full, SCHEMA)


def with_repeats(spark):
    """Also a row without an id, a null text twice and a whole row twice."""
    return table(spark, texts() + [(None, "text of no id"), (21, None), (4, texts()[3][1])])
