"""Rows that every operator must take: nulls, empty and long texts, ties, repeated rows, clashing column names."""

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SENTENCE = " ".join(f"word{i}" for i in range(70))
ROWS = [
    (1, SENTENCE + ".", "en", "a", 3),
    (1, SENTENCE + ".", "en", "a", 3),  # the same row again
    (1, "another text of the same id " + SENTENCE, "en", "b", None),
    (2, None, None, None, None),
    (3, "", "en", "a", 0),
    (4, " \n\t ", "fr", "b", 4),
    (None, "a text without an id " + SENTENCE, "fr", "c", 1),
    (None, None, None, None, None),
    (5, "one", "en", "a", 3),
    (6, "é ü \u00a0 ß one\x0btwo\x0cthree\rfour", "de", "c", 1),
    (7, " ".join(f"long{i % 977} of" for i in range(30_000)), "en", "a", 9),
    (8, SENTENCE.upper() + "!", "en", "c", 5),
    (-9, "x x x x x x x x x x x x x x x x x x x x x x x x x x x x x x", "en", "b", 5),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = ("_id", "_known", "_print_of", "_null", "_row", "_key", "_words", "row", "own", "k", "rank", "slot", "size", "w", "fp", "key", "side", "a", "b", "doc", "sub", "marks", "rest", "n_words", "cluster", "id", "copies", "_n", "quality", "e", "p")


def odd_docs(spark, rows=ROWS, clashing=True):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return df.selectExpr("*", *[f"'other' AS `{c}`" for c in CLASHING]) if clashing else df


def no_docs(spark):
    return odd_docs(spark, [])


def words(text):
    return WORD.findall(text or "")
