"""Documents of the kinds that every operator must take, and plain models of what they should give."""

from __future__ import annotations

import re

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, row string, size string, kept string, h string, label string, target string"
LONG = " ".join(f"w{i % 977}x{i % 13}" for i in range(120_000))


def documents(spark, rows):
    """From (doc_id, text[, source]); with extra columns whose names operators use inside."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None, "r", "s", "k", "h", "l", "t") for r in rows]
    return spark.createDataFrame(full, SCHEMA)


ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "same text here"), (6, "same text here"), (6, "same text here"), (None, "same text here"), (7, LONG), (8, "é ü ñ 漢字 \U0001f600"), (9, None, None)]
WORD = re.compile("[^\x20\x09-\x0d]+")


def words(text):
    return WORD.findall(text or "")


def lower(text):
    return (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
