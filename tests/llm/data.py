"""Small tables for the operators' tests, and plain versions of what they compute."""

import random
import re
import string

from pyspark.sql import types as T

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SMALL = "/root/testdata/sf0.001"
LOW = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
#: More columns, with names that the operators use inside.
EXTRA = ["_id", "_words", "_row", "_source", "unit", "pack", "keys", "node", "n", "size", "copies"]
EXTRA += ["target", "block", "ahead", "host", "uid", "lines", "score", "x", "spans", "token", "plan"]
SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        *[T.StructField(name, T.StringType()) for name in EXTRA],
    ]
)


def documents(spark, rows):
    """A table of (doc_id, text, lang, source) rows."""
    full = [
        (i, t, lang, source, None if t is None else len(t), *["x"] * len(EXTRA))
        for i, t, lang, source in rows
    ]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


def prose(seed, n, vocabulary=400):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(vocabulary)}{'é' if rng.random() < 0.1 else ''}" for _ in range(n))


def edited(text, seed, every):
    rng = random.Random(seed)
    return " ".join(
        f"z{rng.randrange(10**6)}" if rng.random() < every else w for w in text.split(" ")
    )


def edge_rows():
    """Nulls in any column, empty and blank texts, a very long one, ties and repeated rows."""
    long = prose(1, 60_000)
    return [
        (1, None, None, None),
        (2, "", "en", "a"),
        (3, " \t\r\n\x0b\x0c ", "en", "a"),
        (4, long, "en", "a"),
        (5, long, None, None),
        (6, "One", "en", "b"),
        (6, "One", "en", "b"),
        (7, "one", "fr", "b"),
        (None, "no id, but a text of eight words here", "fr", "c"),
        (None, None, None, "c"),
        (8, "1234 5678 !!", "de", "c"),
        (9, "日本 語の　文 é́ 😀 \x00 x", "de", None),
    ]


def words(text):
    return WORD.findall(text or "")


def shingle_set(text, k=5):
    w = words((text or "").translate(LOW))
    if len(w) < k:
        return frozenset([tuple(w)] if w else [])
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1))


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)
