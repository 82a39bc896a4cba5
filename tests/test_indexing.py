"""Small cases of index documents, spans and text functions, with nulls, ties and empty tables."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import indexing as I

FIELDS = "chunk_id string, user_id long, dataset_id long, doc_id long, task_id string, chunk_index long, coarse_tokens string, fine_tokens string, error_of string"


def estimate(text: str) -> int:
    other = sum(ord(c) > 127 for c in text)
    return int(2.0 * other + 0.25 * (len(text) - other))


def longest_end(text: str, most: int) -> str:
    bare = text.strip()
    if estimate(bare) <= most:
        return bare
    fits = [bare[i:].lstrip() for i in range(len(bare)) if estimate(bare[i:].lstrip()) <= most]
    return fits[0] if fits else bare[-1]


def test_last_tokens_is_the_longest_end(spark):
    draw = random.Random(7)
    texts = ["", " \n ", "漢", "a" * 40, "漢字 and words\n" * 9] + ["".join(draw.choice("ab 漢é\n😀 ") for _ in range(draw.randint(1, 120))) for _ in range(200)]
    for most in (1, 3, 10):
        got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.last_tokens(F.col("t"), most).alias("e")).collect()
        assert [(r.t, r.e) for r in got] == [(t, longest_end(t, most)) for t in texts]


def test_index_documents_name_the_first_broken_rule(spark):
    rows = [
        ("a", 1, 2, 3, None, 0, "x", "x", None), (None, 1, 2, 3, "t", 0, "x", "x", None), ("b", None, 2, 3, "t", -1, "x", "x", None),
        ("c", 1, 2, 3, "t", 0, " 　", "x", None), ("d", 1, 2, 3, "t", 0, "x", None, None), ("e", 1, 2, 3, "t", 0, "x" * 300, "x", None),
    ]
    got = I.index_documents(spark.createDataFrame(rows, FIELDS), 300).orderBy("chunk_id").collect()
    assert [r.error and r.error.split(":")[0] for r in got] == ["chunk_id is required", None, "chunk_index must be non-negative", "coarse_tokens must be non-empty text", "fine_tokens must be non-empty text", "document too large"]
    assert I.index_documents(spark.createDataFrame([], FIELDS)).count() == 0


def test_spans_find_the_text_again(spark):
    rows = [(1, 0, "ab"), (1, 1, None), (1, 2, "漢😀"), (2, 0, "")]
    whole = {1: "ab\n\n\n\n漢😀", 2: ""}
    for r in I.view_spans(spark.createDataFrame(rows, "k long, i long, text string"), "k", "i", "text").collect():
        assert whole[r.k][r.char_start : r.char_end] == (r.text or "")


def test_a_large_image_ends_the_budget(spark):
    rows = [(1, 0, 5), (1, 1, 90), (1, 2, 6), (1, 3, 1), (2, 0, None)]
    got = I.within_budget(spark.createDataFrame(rows, "k long, i long, n long"), "k", "i", "n", 3, 100).select("k", "i").collect()
    assert sorted(map(tuple, got)) == [(1, 0), (1, 1), (2, 0)]


def test_text_functions(spark):
    made = spark.range(1).select(
        T.without_picture_text(F.lit("a\n\n**----- Start of picture text -----**<br>\nx\n**----- END of picture text -----**<br>\n\nb")).alias("clean"),
        T.heading_like(F.lit("第 一章")).alias("begins"), T.heading_like(F.lit("我们的方案")).alias("ends"), T.heading_like(F.lit("方案是好的")).alias("within"), T.heading_like(F.lit("")).alias("none"), T.heading_like(F.lit("第" * 31)).alias("long"),
        T.masked_key(F.lit("12345678")).alias("short"), T.opened(T.sealed(F.lit("x"), F.lit("0123456789abcdef")), F.lit("0123456789abcdeX")).alias("wrong"),
        T.canonical_name(F.lit(None).cast("string"), {"a": "b"}, "A").alias("alias"), T.first_line(F.lit(" \r\n  z \n")).alias("line"), T.image_key(F.lit("dir/.doc"), F.lit("i.png")).alias("key"), T.image_key(F.lit("doc.md"), F.lit("i.png")).alias("bare"),
    ).first()
    assert made.asDict() == {"clean": "a\n\nb", "begins": True, "ends": True, "within": False, "none": False, "long": False, "short": "****", "wrong": None, "alias": "b", "line": "z", "key": "dir/image/.doc/i.png", "bare": "image/doc/i.png"}


def test_write_results_of_missing_and_repeated_responses(spark):
    actions = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (1, 2, "c"), (2, 0, "d")], "batch long, position long, chunk_id string")
    told = spark.createDataFrame([(1, 0, 200, None), (1, 1, 429, "full"), (1, 1, 200, None), (1, 2, None, "")], "batch long, position long, status int, reason string")
    got = {r.chunk_id: r.error for r in I.write_results(actions, told).collect()}
    assert got == {"a": None, "b": "es_bulk: full", "c": "es_bulk: unknown error", "d": "es_bulk: bulk response missing item result"}
