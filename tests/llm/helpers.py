"""Brute-force statements of the contracts and odd inputs, shared by the tests."""

import re
import zlib

from pyspark.sql import functions as F

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def words(text):
    return WORD.findall(lower(text))


def shingle_set(text, k):
    w = words(text)
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()


def fold(doc_id, parts):
    return zlib.crc32(str(doc_id).encode()) % parts


def odd_documents(spark):
    """Null ids and texts, empty and white texts, one very long text, repeated rows, one id
    with two texts, ties, odd characters, and columns named like internal ones."""
    long = " ".join(f"w{i % 977}" for i in range(30_000))
    rows = [
        (1, "the quick brown fox jumps over the lazy dog", "en", "a"), (1, "the quick brown fox jumps over the lazy dog", "en", "a"),
        (2, None, None, None), (3, "", "en", "a"), (4, " \t\n\x0b\x0c\r ", "de", "b"), (None, "an id that is missing here", "en", "a"), (None, None, None, None),
        (5, long, "en", "a"), (6, long + " tail", "en", "b"), (7, "x", "fr", None), (8, "the quick brown fox jumps over the lazy dog", None, "b"),
        (9, " no break İ \U0001f600 é", "es", "c"), (9, "another text of the same id", "es", "c"), (10, "!!! ??? 123", "de", "c"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    for c in ("key", "n", "row", "label", "score", "leaks", "toxicity", "quality_score", "lang_pred", "tokens", "topic", "probability", "cid", "token", "shard", "owner", "hash", "_id"):
        df = df.withColumn(c, F.lit("x"))
    return df


def empty_documents(spark):
    return odd_documents(spark).limit(0)
