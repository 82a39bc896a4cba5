"""Rows that an operator must bear, and helpers to look at results."""

from __future__ import annotations

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Extra columns with names that operators use themselves.
CLASHING = [
    "size", "shard", "slot", "cell", "span", "place", "_words", "_draw", "_bucket", "_source", "_times", "_whole", "_n", "_nll", "_of", "_in", "_limit", "_level", "_accepted",
    "_id", "_trusted", "key_hash", "_key_hash", "_key_crc", "_key_bytes", "class_doc", "class_key_hash", "tid", "a", "b", "label", "hits", "_leaks", "licences", "range", "copy",
    "before", "head", "kind", "start", "stop", "body", "item_id", "quality", "verdict", "rule", "host", "path", "spans", "clean", "_turn", "c0", "x1",
]


def rows_of(df) -> list[tuple]:
    """Rows as tuples, in an order of their own."""
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="session")
def make(spark):
    """A documents table from (doc_id, text[, lang[, source]])."""

    def made(rows):
        full = [(*r, *(["en", "src0", 0][len(r) - 2 :])) for r in rows]
        return spark.createDataFrame(full, SCHEMA)

    return made


@pytest.fixture(scope="session")
def odd(make):
    """Nulls in every column, empty, blank and very long texts, ties and repeated rows."""
    long = " ".join(f"word{k % 977} of{k % 31}" for k in range(60_000))
    return make(
        [
            (1, None), (2, ""), (3, " \n\t "), (4, long), (5, "one two three four five six seven"), (5, "one two three four five six seven"),
            (6, "one two three four five six seven"), (None, "a null id with some words in it"), (None, None), (7, "null language", None), (8, "null source", "en", None),
            (9, "emoji \U0001f600 and  marks  éè", "fr"), (10, "x"), (11, "." * 5000), (-3, "below zero"),
        ]
    )


@pytest.fixture(scope="session")
def clash():
    """A table with extra columns of clashing names."""

    def widened(df):
        from pyspark.sql import functions as F

        return df.select("*", *[F.lit(f"extra {c}").alias(c) for c in CLASHING if c not in df.columns])

    return widened
