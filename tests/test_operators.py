"""Operators on small cases with known results."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tessera.operators import chunking, html, markdown, rerank, retrieval
from tessera.plans import retrieval as R

HIT = "query_id string, source string, source_rank int, chunk_id string, doc_id long, dataset_id long, score double"
SOURCES = ["dense", "sparse", "bm25"]


def test_fusion_adds_reciprocal_ranks(spark):
    hits = spark.createDataFrame([("q", "dense", 1, "cA", 1, 1, 0.9), ("q", "dense", 2, "cB", 2, 1, 0.8), ("q", "sparse", 1, "cA", 1, 1, 7.0), ("q", "sparse", 2, "cC", 3, 1, 6.0)], HIT)
    got = {r.chunk_id: r for r in retrieval.fuse(hits, SOURCES).collect()}
    assert {k: r.fused_score for k, r in got.items()} == pytest.approx({"cA": 2 / 61, "cB": 1 / 62, "cC": 1 / 62})
    assert [c for c, _ in sorted(got.items(), key=lambda x: x[1].rrf_rank)] == ["cA", "cB", "cC"]
    assert got["cB"].scores == {"dense": 0.8, "sparse": None, "bm25": None}
    assert retrieval.fuse(hits.limit(0), SOURCES).count() == 0


def test_recall_policies(spark):
    hits = spark.createDataFrame([("q", 1, "cA", 1, 1, 0.9)], "query_id string, source_rank int, chunk_id string, doc_id long, dataset_id long, score double")

    def broken():
        raise OSError("down")

    found, _, failed = retrieval.recall({"dense": lambda: hits, "bm25": broken}, ["dense", "bm25"])
    assert failed == ["bm25"] and found.count() == 1
    with pytest.raises(retrieval.RecallFailed):
        retrieval.recall({"dense": lambda: hits, "bm25": broken}, ["dense", "bm25"], policy="strict")
    with pytest.raises(retrieval.RecallFailed):
        retrieval.recall({"bm25": broken}, ["bm25"])
    with pytest.raises(retrieval.BadRequest):
        retrieval.recall({"dense": lambda: hits}, ["dense"], top_k=0)
    with pytest.raises(retrieval.BadRequest):
        retrieval.scope([1, 9], [1, 2])
    assert retrieval.scope([], [1, 2]) == [1, 2]


@pytest.mark.parametrize("source", ["bm25", "sparse", "dense"])
@pytest.mark.parametrize("early", [True, False])
def test_hybrid_recall_has_no_result_without_a_source(spark, data, monkeypatch, source, early):
    """A source whose plan can't be made, or can't be run."""
    hits = spark.createDataFrame([(1, 1, "cA", 1, 1, 0.9)], "query_id long, source_rank int, chunk_id string, doc_id long, dataset_id long, score double")
    for s in ("bm25", "sparse", "dense"):
        monkeypatch.setattr(retrieval, s, lambda *a: hits)
    assert R.hybrid_recall(spark, data).count() == 1

    def broken(*a):
        if early:
            raise OSError("down")
        return hits.withColumn("score", F.raise_error("down").cast("double"))

    monkeypatch.setattr(retrieval, source, broken)
    with pytest.raises(retrieval.RecallFailed, match=source):
        R.hybrid_recall(spark, data)


def test_dense_against_brute_force(spark):
    rows = [(str(k), k, k % 3, [float(k % 5) - 2, float(k % 7) - 3, 1.0]) for k in range(60)]
    index = spark.createDataFrame(rows, "chunk_id string, doc_id long, dataset_id long, vector array<double>")
    queries = index.where("doc_id < 4").select(F.col("doc_id").alias("query_id"), "vector")
    got = {}
    for r in retrieval.dense(queries, index, 5).collect():
        got.setdefault(r.query_id, []).append((r.source_rank, r.chunk_id))
    length = lambda v: sum(x * x for x in v) ** 0.5
    for q in range(4):
        v = rows[q][3]
        scored = sorted((-round(sum(a * b for a, b in zip(v, w, strict=True)) / length(v) / length(w), 9), c) for c, _, _, w in rows)
        want = [c for s, c in scored if s <= 0][:5]
        assert [c for _, c in sorted(got[q])] == want


@pytest.mark.parametrize(("indices", "order"), [([0, 5, 2], ["c1", "c3", "c2"]), ([0, 0, 1], ["c1", "c2", "c3"]), ([], ["c1", "c2", "c3"])])
def test_rerank_mapping(spark, indices, order):
    hits = spark.createDataFrame([("q", f"c{k}", k) for k in (1, 2, 3)], "query_id string, chunk_id string, rrf_rank int")
    scores = spark.createDataFrame([("q", i, p, 1.0 - p / 10) for p, i in enumerate(indices)], "query_id string, doc_index int, position int, score double")
    got = sorted(rerank.map_results(hits, scores).collect(), key=lambda r: (r.rerank_rank or r.rrf_rank, r.rrf_rank))
    assert [r.chunk_id for r in got] == order
    assert all(r.rerank_score is None for r in got) == (not indices)


def test_context_keeps_the_first_and_what_fits(spark):
    hits = spark.createDataFrame([("q", f"c{k}", k) for k in range(1, 6)], "query_id string, chunk_id string, rank int")
    contents = spark.createDataFrame([("c1", "a" * 400), ("c2", None), ("c3", "  "), ("c4", "b" * 40), ("c5", "c" * 400)], "chunk_id string, content string")
    (all_fit,) = rerank.context(hits, contents, 10_000).collect()
    assert all_fit.blocks == 3
    (one,) = rerank.context(hits, contents, 1).collect()
    assert one.blocks == 1 and "a" * 400 in one.context


TEXT = """---
title: x
---
# Top

Some prose
on two lines.

## Part

- one
- two

| a | b |
|---|---|
| 1 | 2 |

```py
# no heading
```

> quoted

![pic](http://x/y.png)

---

$$
x
$$
"""


def test_markdown_blocks(spark):
    docs = spark.createDataFrame([(1, TEXT), (2, None), (3, "")], "doc_id long, text string")
    got = sorted((r for r in markdown.scan(docs).collect() if r.doc_id == 1), key=lambda r: r.element_index)
    assert [r.type for r in got] == ["front_matter", "heading", "paragraph", "heading", "list", "table", "code_block", "blockquote", "image", "hr", "math_block"]
    assert [(r.heading_level, r.heading_text) for r in got if r.type == "heading"] == [(1, "Top"), (2, "Part")]


def test_chunks_hold_every_block(spark):
    long = "word " * 200
    docs = spark.createDataFrame([(1, f"# A\n\n{long}\n\n## B\n\n{long}\n\n# C\n\nshort\n\n# Only\n"), (2, "no heading")], "doc_id long, text string")
    found = markdown.scan(docs)
    chunks = chunking.mixed_chunks(chunking.assign(found))
    assert chunking.uncovered(found, chunks).count() == 0
    assert [r.chunk_index for r in chunks.where("doc_id = 1").orderBy("chunk_index").collect()] == [0, 1, 2]
    assert chunks.where("doc_id = 2").count() == 1


def test_html_tables_and_noise(spark):
    body = f"<article><h1>T</h1><p>{'prose ' * 40}</p><nav>menu</nav><table><tr><th>a</th><th>b</th></tr><tr><td rowspan=2>1</td><td>2</td></tr><tr><td>3</td></tr></table><script>x()</script></article>"
    pages = spark.createDataFrame([(1, "http://h/p", f"<html><body>{body}</body></html>"), (2, "http://h/q", None), (3, None, "<p>short</p>")], "page_id long, url string, html string")
    got = {r.page_id: r for r in html.pages_to_markdown(pages).collect()}
    assert "# T" in got[1].markdown and "x()" not in got[1].markdown and "menu" not in got[1].markdown
    assert "| 1 | 2 |" in got[1].markdown and "| 1 | 3 |" in got[1].markdown
    assert got[2].error and got[3].error
