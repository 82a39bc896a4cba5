"""Steps whose work must follow the rows of their input: what a task holds and hands on, and what isn't made at all."""

from __future__ import annotations

import collections
import random

import numpy as np
import pandas as pd
import pyarrow as pa

from tessera.functions import text
from tessera.operators import boxes, evaluate, markdown, page_tables, retrieval


def test_a_task_keeps_the_best_of_each_query_only():
    """Copies and ties beyond top_k go, the least chunk_ids stay, and what is held meanwhile is bounded."""
    best = retrieval.Best(pa.array([7, 8]), 3)
    r = np.random.default_rng(1)
    rows = []
    for part in range(60):
        scores = np.round(r.random((1000, 2)), 3)
        ids = [f"{part * 1000 + k:06d}" for k in range(1000)]
        rows += [(q, i, s) for i, pair in zip(ids, scores, strict=True) for q, s in zip((7, 8), pair, strict=True)]
        best.add([pa.array(ids), pa.array(range(1000)), pa.array([1] * 1000)], scores, scores >= 0)
        assert best.held <= 4 * 3 * 2 + (1 << 16)
    got = sorted((q, i, s) for b in best.rows() for q, i, s in zip(*(b.column(c).to_pylist() for c in ("query_id", "chunk_id", "score")), strict=True))
    assert got == sorted(x for q in (7, 8) for x in sorted((y for y in rows if y[0] == q), key=lambda y: (-y[2], y[1]))[:3])


def test_scores_do_not_leave_their_task(spark):
    """Of copies that every query finds, top_k a query and task are handed on: chunks times queries rows were, before."""
    index = spark.range(0, 4000, 1, 4).selectExpr("cast(id as string) chunk_id", "id doc_id", "id % 5 dataset_id", "array(1D, 2D) vector", "'a b c' text")
    asked = spark.createDataFrame([(k, ["a", "b", "b"]) for k in range(6)], "query_id long, terms array<string>")
    handed = []
    plain = retrieval.merged_top
    retrieval.merged_top = lambda df, *a: handed.append(df.count()) or plain(df, *a)
    try:
        found = [
            retrieval.bm25(asked, index, {"x": retrieval.F.split("text", " ")}, {"x": 1.0}, 5),
            retrieval.sparse(asked.selectExpr("query_id", "explode(terms) token_id", "1D weight"), index.selectExpr("chunk_id", "doc_id", "dataset_id", "'a' token_id", "2D weight"), 5),
            retrieval.dense(asked.selectExpr("query_id", "array(1D, 2D) vector"), index, 5),
        ]
        want = sorted(map(str, range(4000)))[:5]
        for f in found:
            hits = f.collect()
            assert len(hits) == 30 and all([r.chunk_id for r in sorted(hits, key=lambda r: r.source_rank) if r.query_id == k] == want for k in range(6))
    finally:
        retrieval.merged_top = plain
    assert max(handed) <= 6 * 5 * 8


def test_a_posting_meets_only_the_weights_of_its_term(spark, monkeypatch):
    """Against plain sums over two fields, in blocks of queries and strips of postings."""
    r = random.Random(11)
    chunks = [(f"c{k}", k, k % 2, [(r.randrange(2), t, 1.0 + r.randrange(4), 9) for t in r.sample(range(60), r.randrange(1, 25))]) for k in range(150)]
    weights = [(q, f, t, r.choice([0.5, 1.0, -0.25])) for q in range(30) for f in (0, 1) for t in r.sample(range(0, 64, 2), 4)]
    listed = spark.createDataFrame(chunks, "chunk_id string, doc_id long, dataset_id long, p array<struct<f: int, t: long, v: double, len: int>>")
    asked = spark.createDataFrame(weights, "query_id long, f int, t long, w double")
    want = []
    for q in range(30):
        for c, _, _, p in chunks:
            sums = [sum(w * v / n for x, f, t, w in weights if x == q and f == g for h, u, v, n in p if h == g and u == t) for g in (0, 1)]
            best = max([s * b for s, b in zip(sums, (2.0, 1.0), strict=True) if s > 1e-12], default=None)
            want += [(q, c, round(best, 6))] if best else []
    monkeypatch.setattr(retrieval, "QUERIES", 7)
    monkeypatch.setattr(retrieval, "POSTINGS", 100)
    got = retrieval.matched(listed, asked, [2.0, 1.0], lambda f, v, n: v / n, 1000)
    assert sorted((x.query_id, x.chunk_id, round(x.score, 6)) for x in got.collect()) == sorted(want)


def test_labels_give_the_metrics_of_all_relevant_pairs(spark):
    r = random.Random(5)
    asked = [(k, r.choice([1, 2, 3, None])) for k in range(12)]
    items = [(f"c{k}", r.choice([1, 2, 4, None])) for k in range(40)]
    ranked = spark.createDataFrame([(q, c, k + 1) for q, _ in asked for k, (c, _) in enumerate(r.sample(items, 15))], "query_id long, chunk_id string, rank int")
    pairs = spark.createDataFrame([(q, c) for q, a in asked for c, b in items if a is not None and a == b], "query_id long, chunk_id string")
    left = spark.createDataFrame(asked, "query_id long, label long"), spark.createDataFrame(items, "chunk_id string, label long")
    rounded = [sorted(tuple(round(v, 9) for v in row) for row in df.collect()) for df in (evaluate.per_label(ranked, *left, 10), evaluate.per_query(ranked, pairs, 10))]
    assert rounded[0] == rounded[1]


def test_boxes_of_small_pages_need_no_rounds(spark, monkeypatch):
    r = random.Random(9)
    made = [(page, k, x := r.randrange(900), y := r.randrange(900), x + r.randrange(120), y + 60) for page in range(30) for k in range(3 * page + 1)]
    table = spark.createDataFrame(made, "page long, id long, x0 long, y0 long, x1 long, y1 long")
    want = sorted(boxes.in_rounds(table, 24, 100).collect())
    assert sorted(boxes.merged(table, 24, 100).collect()) == want
    monkeypatch.setattr(boxes, "touching", lambda a, b, *_: a.limit(0).selectExpr("page", "id a", "id b"))
    monkeypatch.setattr(boxes, "FEW", 1000)
    assert sorted(boxes.merged(table, 24, 100).collect()) == want


def test_pages_are_worked_on_in_portions():
    frames = [pd.DataFrame({"k": range(n)}) for n in (0, 5, 1000)]
    got = list(markdown.portions(iter(frames)))
    assert max(map(len, got)) <= markdown.ROWS and [k for f in got for k in f["k"]] == [k for f in frames for k in f["k"]]


def test_lines_of_cut_tables_are_sorted_once(spark):
    """No join, no second sort; against a plain walk over the lines of each document."""
    r = random.Random(3)
    kinds = ["| a | b |", "|a<br>|b|", "| c | d |", "|---|---|", "|---|", "| x | 1 |", "| x | 1 |", "", " ", None, "text"]
    docs = {k: [r.choice(kinds) for _ in range(r.randrange(1, 40))] for k in range(300)}
    lines = spark.createDataFrame([(k, n, c) for k, d in docs.items() for n, c in enumerate(d)], "doc_id long, line long, content string")
    row, rule = (lambda c: (c or "").count("|") > 2), (lambda c: (c or "").startswith("|--"))
    want = []
    for k, d in docs.items():
        gone, at, above = set(), 0, None  # above: the last line, header and size of the table before
        while at < len(d):
            if not (row(d[at]) and at + 1 < len(d) and rule(d[at + 1])):
                at += 1
                continue
            end = at
            while end < len(d) and row(d[end]):
                end += 1
            head = d[at].strip("|").replace("<br>", "").replace(" ", "")
            blank = at
            while blank and not (d[blank - 1] or "").strip():
                blank -= 1
            if above and above[0] == blank - 1 and above[1] == head and above[2] >= 2 and end - at >= 2:
                gone |= {*range(blank, at + 2)}
            above, at = (end - 1, head, end - at), end
        want += [(k, n, c) for n, c in enumerate(d) if n not in gone]
    kept = page_tables.merged(lines)
    assert sorted(map(tuple, kept.collect()), key=repr) == sorted(want, key=repr) and len(want) < lines.count()
    plan = kept._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert "Join" not in plan and plan.count("Sort ") == 1


def test_terms_are_counted_in_portions(spark, monkeypatch):
    """No table of all terms of a task; a row hands on its heaviest terms only, the same as a window over all would keep."""
    r = random.Random(2)
    texts = [(k, " ".join(f"w{int(r.random() ** 3 * 60)}" for _ in range(r.randrange(0, 120)))) for k in range(200)] + [(7, "a a b"), (8, None), (9, "")]
    df = spark.createDataFrame(texts, "doc_id long, text string").coalesce(2)
    want = []
    for k, t in texts:
        n = collections.Counter((t or "").split())
        size = sum(v * v for v in n.values()) ** 0.5
        want.append((k, sorted(((-v, w, v / size) for w, v in n.items()))))
    monkeypatch.setattr(retrieval, "PORTION", 300)
    for top in (None, 5):
        v = retrieval.lexical_vectors(df, "doc_id", top=top)
        assert "Aggregate" not in v._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(tuple, v.collect())) == sorted((k, w, s) for k, ws in want for _, w, s in ws[:top])
    batch = pa.RecordBatch.from_arrays([pa.array([["a"] * n for n in (3, 0, 500, 200, 90, 20)])], ["t"])
    assert [p.num_rows for p in retrieval.portions(batch)] == [2, 1, 2, 1]


def test_grams_are_no_arrays_of_strings(spark):
    """Blanks of all kinds, characters beyond the first plane, short, empty and null texts, against plain Python."""
    r = random.Random(4)
    texts = ["".join(r.choice("ab 　\n\U0001f600") for _ in range(n)) for n in (0, 1, 5, 11, 12, 13, 40, 300)] + [" \n"]
    pairs = [(a, b) for a in [*texts, None] for b in [*texts, None]]
    df = spark.createDataFrame(pairs, "a string, b string").select("a", "b", text.kgram_coverage(retrieval.F.col("a"), retrieval.F.col("b")).alias("c"))

    def grams(t):
        t = "".join(t.split())
        return {t[i : i + 12] for i in range(max(1, len(t) - 11))} if t else set()

    for a, b, c in df.collect():
        want = None if a is None else 0.0 if not grams(a) else None if b is None else len(grams(a) & grams(b)) / len(grams(a))
        assert c == want
    assert "array_distinct" not in df._jdf.queryExecution().executedPlan().toString()
