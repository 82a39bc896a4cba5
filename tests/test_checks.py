"""Carried overlap, chunk faults, tenant buckets, described blocks and encoder time against plain Python."""

from __future__ import annotations

import random
import time
import zlib
from collections import Counter

from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import batching, markdown, overlap, page_tables, retrieval, validator
from tessera.plans import checks, tables
from tessera.session import table


def rows(df) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_overlap_is_that_of_a_plain_loop(spark):
    r = random.Random(3)
    atoms = [(d, k, "".join(r.choice("ab é日 \n") for _ in range(r.choice([0, 3, 40, 300])))) for d in (1, 2, None) for k in range(40)] + [(5, 0, None), (5, 1, "x")]
    got = {(x.doc_id, x.position): x.content for x in overlap.carried(spark.createDataFrame(atoms, "doc_id long, position long, text string"), 12, 60).collect()}
    before = {}
    for d, k, x in atoms:
        x = x or ""
        room = min(12, max(0, 60 - overlap.tokens(x))) if d in before else 0
        tail = before.get(d, "").strip()
        while tail and overlap.tokens(tail) > room:  # the longest end that fits
            tail = tail[1:]
        tail = tail.lstrip()
        want = f"{tail}\n\n{x}".strip() if tail and room else x
        assert got[d, k] == want, (d, k)
        before[d] = want
        assert overlap.tokens(want) <= max(60, overlap.tokens(x)) + 1
    assert overlap.carried(spark.createDataFrame([], "doc_id long, position long, text string")).count() == 0


def test_estimate_is_the_one_of_columns(spark):
    texts = ["", "abc", "é日本", "a" * 99 + "ü", " \n"]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(texts)], "k long, x string")
    assert [r.n for r in df.select("k", T.estimate_tokens(F.col("x")).alias("n")).orderBy("k").collect()] == [overlap.tokens(x) for x in texts]


def test_every_fault_is_found_and_no_other(spark):
    elements = [(1, k, f"block {k}") for k in range(5)]
    whole = "block 0\n\nblock 1"
    chunks = [
        (1, "a", "mixed", whole, None, None), (1, "b", "mixed", "block 2", None, None), (1, "c", "mixed", " ", None, None), (1, "b2", "odd", "x", None, None), (1, "t", "derived", "about 1", "a", 1),
        (1, "u", "derived", "about 2", "a", 2), (1, "v", "derived", "about", "zz", 0), (1, "r", "derived", "r", "a", 0), (1, "r", "derived", "r", "a", 0),
    ]
    views = [(1, "a", 0, 0, 7), (1, "a", 1, 9, 16), (1, "b", 2, 0, 9), (1, "b", 3, 2, 7), (1, "nowhere", 1, 0, 2), (1, "a", 77, 18, 16)]
    ranges = [(1, "a", 1, "table", 3, 4), (1, "a", 0, " ", 0, 1), (1, "b", 2, "code", 5, 4), (1, "a", 3, "table", 1, 2)]
    got = validator.faults(
        spark.createDataFrame(elements, "doc_id long, element_index long, content string"), spark.createDataFrame(chunks, "doc_id long, chunk_id string, kind string, content string, source_id string, element_index long"),
        spark.createDataFrame(views, "doc_id long, chunk_id string, element_index long, start long, stop long"), spark.createDataFrame(ranges, "doc_id long, chunk_id string, element_index long, kind string, start_line int, end_line int"),
    )
    assert rows(got) == sorted(
        [
            (1, None, "block in no chunk"), (1, None, "block in several chunks"), (1, "c", "blank content"), (1, "c", "no views"), (1, "b2", "unknown kind"), (1, "b", "view beyond the content"), (1, "b", "view isn't its block"),
            (1, "b", "views out of place"), (1, "nowhere", "view of no mixed chunk"), (1, "a", "view of no block"), (1, "a", "view beyond the content"), (1, "a", "range without kind"), (1, "b", "range lines"), (1, "a", "range of no viewed block"),
            (1, "u", "derived block not in source"), (1, "v", "derived without source"), (1, "r", "repeated id"),
        ],
        key=repr,
    )


def test_user_buckets_are_those_of_zlib(spark, data):
    users = {r.user_id for r in table(spark, data, "events").select("user_id").distinct().collect()}
    want = Counter(zlib.crc32(str(u).encode()) % 128 for u in users)
    assert {r.bucket: r.users for r in tables.user_buckets(spark, data).collect()} == dict(want)


def test_descriptions_are_laid_beside_their_blocks(spark):
    found = spark.createDataFrame([(1, 0, "para", 0, 2), (1, 1, "other", 4, 300), (2, 0, "far", 0, 9)], "doc_id long, element_index int, content string, start_line int, end_line int")
    refs = spark.createDataFrame([(1, 2, "u"), (1, 200, "v"), (1, 3, "u"), (2, 10, "u")], "doc_id long, line int, url string")
    told = spark.createDataFrame([("u", "a cat"), ("v", "a dog")], "url string, description string")
    got = {(r.doc_id, r.element_index): r.content for r in markdown.described(found, refs, told).collect()}
    assert "a cat" in got[1, 0] and "a dog" in got[1, 1] and "a cat" not in got[1, 1] and got[2, 0] == "far"


def test_pages_of_ids(spark):
    df = spark.createDataFrame([("x", k) for k in range(25)] + [("y", 3), (None, 4)], "reason string, id long")
    got = {(r.reason, r.page): r.ids for r in batching.pages(df, "reason", "id", 10).collect()}
    assert got == {("x", 0): list(range(10)), ("x", 1): list(range(10, 20)), ("x", 2): list(range(20, 25)), ("y", 0): [3], (None, 0): [4]}


def test_encoder_takes_time_in_proportion_to_a_text(spark):
    def took(n):
        df = spark.createDataFrame([(1, " ".join(f"w{k % 977}" for k in range(n)))], "doc_id long, text string")
        start = time.time()
        assert retrieval.lexical_vectors(df, "doc_id").count() == 977
        return time.time() - start

    took(20_000)
    assert took(400_000) < 3 * took(200_000) + 2


def test_carried_overlap_is_registered_with_all_turns(spark, data):
    got = checks.carried_overlap(spark, data)
    assert got.count() == table(spark, data, "conversations").count()


def test_tables_cut_by_pages_are_joined(spark):
    texts = {
        1: ["a", "| x | y |", "|---|---|", "| 1 | 2 |", "", " ", "|x|y<br>|", "|:---|---:|", "| 3 | 4 |", "", "end"],
        2: ["| x | y |", "|---|---|", "| 1 | 2 |", "text", "| x | y |", "|---|---|", "| 3 | 4 |"],
        3: ["| x | y |", "|---|---|", "| 1 | 2 |", "", "| z | y |", "|---|---|", "| 3 | 4 |", "", "| z | y |", "|---|---|", "", "| z | y |", "|---|---|", "| 5 | 6 |"],
        4: ["| x | y |", "| no | rule |", "", "| x | y |", "|---|---|", "| 3 | 4 |", None],
        5: ["| odd | row |", "| x | y |", "|---|---|", "| 1 | 1 |", "", "| x | y |", "|---|---|", "| 2 | 2 |"],
    }
    gone = {1: [4, 5, 6, 7], 2: [], 3: [7, 8, 9, 10, 11, 12], 4: [], 5: [4, 5, 6]}
    df = spark.createDataFrame([(d, k, x) for d, t in texts.items() for k, x in enumerate(t)], "doc_id long, line long, content string")
    got = page_tables.merged(df).collect()
    for d, t in texts.items():
        assert sorted(r.line for r in got if r.doc_id == d) == [k for k in range(len(t)) if k not in gone[d]], d


def test_images_are_matched_as_in_turns(spark):
    from tessera.operators import matching

    r = random.Random(9)
    places, images = [], []
    for d in range(8):
        for k in range(r.randint(0, 9)):
            kind = r.choice("spn")
            places.append((d, k, r.choice([40, 100, 200, 300]) if kind == "s" else None, r.choice([100, 150, 200]) if kind == "s" else None, r.randint(1, 3) if kind == "p" else None))
        for k in range(r.randint(0, 8)):
            images.append((d, k, r.choice([0, 90, 100, 250, 400]), r.choice([80, 100, 200]), r.randint(1, 3)))
    want = []
    for d in range(8):
        remaining = [i for i in images if i[0] == d]
        for _, k, w, h, page in (p for p in places if p[0] == d):
            best = None
            if w and h:
                sized = [(abs(i[2] / i[3] - w / h) / (w / h), i) for i in remaining if i[2] and i[3]]
                if w >= 64 and h >= 64 and sized:
                    off, found = min(sized, key=lambda x: x[0])
                    best = found if off <= 0.35 else None
            elif page:
                best = next((i for i in remaining if i[4] == page), None)
            else:
                best = remaining[0] if remaining else None
            if best:
                remaining.remove(best)
                want.append((d, k, best[1]))
    got = matching.matched(matching.preferences(spark.createDataFrame(places, "doc_id long, place long, width long, height long, page long"), spark.createDataFrame(images, "doc_id long, image long, width long, height long, page long")))
    assert rows(got) == sorted(want, key=repr)
