"""Kept indexes, replaced documents, batches, intervals, boxes and streamed state against plain Python."""

from __future__ import annotations

import glob
import os
import random
import shutil

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import batching, boxes, intervals, lexical_index, replace, retrieval, state, vector_index
from tessera.plans import retrieval as R
from tessera.session import fresh_folder
from tessera.streaming.stages import task_states



def fields():
    return {"coarse": R.coarse(F.col("text")), "fine": T.lexical_terms(F.coalesce("text", F.lit("")))}


def rows(df) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=repr)


BOOSTS = {"coarse": 2.0, "fine": 1.0}


def test_index_with_appends_is_a_rebuilt_one_and_reads_asked_buckets_only(spark, data):
    chunks, whole, grown = R._chunks(spark, data), fresh_folder(spark), fresh_folder(spark)
    lexical_index.append(whole, chunks, fields(), "all")
    lexical_index.append(grown, chunks.where("doc_id % 10 <> 0"), fields(), "a")
    lexical_index.append(grown, chunks.where("doc_id % 10 = 0"), fields(), "b")
    lexical_index.append(grown, chunks.where("doc_id % 10 = 0"), fields(), "b")  # done again, as after a crash
    lexical_index.append(f"{grown}", chunks.where("doc_id < 5"), fields(), "broken")
    shutil.rmtree(f"{grown.removeprefix('file://')}/batches/batch=broken")  # its last step never came: it counts for nothing
    asked = R._asked(spark, data).select("query_id", R.coarse(F.col("text")).alias("terms"))
    want = rows(R._rounded(retrieval.bm25(asked, chunks, fields(), BOOSTS, 20)))
    assert rows(R._rounded(lexical_index.search(spark, whole, asked, BOOSTS, 20))) == want
    assert rows(R._rounded(lexical_index.search(spark, grown, asked, BOOSTS, 20))) == want
    one = spark.createDataFrame([(1, ["zzzznever"])], "query_id long, terms array<string>")
    assert lexical_index.search(spark, grown, one, BOOSTS, 5).count() == 0
    plan = lexical_index._read(spark, grown, "postings", ["a", "b"], [3, 5])._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_index_in_scope_keeps_the_whole_statistics(spark, data):
    chunks, path = R._chunks(spark, data), fresh_folder(spark)
    lexical_index.append(path, chunks, fields(), "all")
    asked = R._asked(spark, data).select("query_id", R.coarse(F.col("text")).alias("terms"))
    full = lexical_index.search(spark, path, asked, BOOSTS, 10_000)
    scoped = lexical_index.search(spark, path, asked, BOOSTS, 10_000, dataset_ids=[1, 2])
    assert rows(R._rounded(scoped).drop("source_rank")) == rows(R._rounded(full.where("dataset_id IN (1, 2)")).drop("source_rank"))
    assert lexical_index.search(spark, path, asked, BOOSTS, 5, dataset_ids=[]).count() == 0


def test_append_makes_a_text_into_terms_once_and_packs_postings(spark, monkeypatch):
    """Null, empty and repeated texts, repeated chunks, null terms, in parts of some chunks; as the scan of all chunks finds them."""
    r = random.Random(7)
    texts = [" ".join(f"w{int(r.random() ** 2 * 40)}" for _ in range(r.randrange(0, 60))) for _ in range(300)] + [None, "", "w1", "w1", "w1 w1 w2"]
    made = [(k % 3 if k % 7 else None, k, f"c{k % 302}", t) for k, t in enumerate(texts)]
    chunks = spark.createDataFrame(made, "dataset_id long, doc_id long, chunk_id string, text string").coalesce(2)
    calls = spark.sparkContext.accumulator(0)

    def words(t):
        calls.add(1)
        return None if t is None else t.split()

    counted = {"coarse": F.udf(words, "array<string>")("text"), "fine": F.when(F.col("text") != "", F.split("text", "[ 3]"))}
    monkeypatch.setattr(lexical_index, "PART", 500)
    path = fresh_folder(spark)
    lexical_index.append(path, chunks, counted, "all")
    assert calls.value == len(texts)
    kept = lexical_index._read(spark, path, "postings", ["all"], list(range(lexical_index.BUCKETS)))
    sizes = kept.selectExpr("sum(size(at)) n", "count(*) packed", "count(distinct part) parts", "max(size(at)) most").first()
    assert sizes.packed < sizes.n / 2 and sizes.parts > 10 and sizes.most < 50
    asked = spark.createDataFrame([(k, [f"w{r.randrange(45)}" for _ in range(9)] + ["w1", None]) for k in range(8)], "query_id long, terms array<string>")
    plain = {"coarse": F.split("text", " +"), "fine": counted["fine"]}
    plain["coarse"] = F.filter(plain["coarse"], lambda w: w != "")
    want = rows(R._rounded(retrieval.bm25(asked, chunks, plain, BOOSTS, 400)))
    assert rows(R._rounded(lexical_index.search(spark, path, asked, BOOSTS, 400))) == want and len(want) > 1000
    swapped = dict(reversed(BOOSTS.items()))
    assert rows(R._rounded(lexical_index.search(spark, path, asked, swapped, 400))) == want


def test_dense_index_finds_nearly_all_and_all_with_every_list(spark, data):
    index, path = R._vectors(spark, "/root/testdata/sf0.01"), fresh_folder(spark)
    vector_index.build(path, index)
    queries = index.where("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), "vector")
    exact = {(r.query_id, r.chunk_id) for r in retrieval.dense(queries, index, 20).collect()}
    found = {(r.query_id, r.chunk_id) for r in vector_index.search(spark, path, queries, 20).collect()}
    assert len(exact & found) >= 0.95 * len(exact)
    every = vector_index.search(spark, path, queries, 20, probes=10**6)
    assert rows(R._rounded(every)) == rows(R._rounded(retrieval.dense(queries, index, 20)))
    few = vector_index.search(spark, path, queries, 20, dataset_ids=[1])
    assert rows(R._rounded(few)) == rows(R._rounded(retrieval.dense(queries, index.where("dataset_id = 1"), 20)))
    assert spark.read.parquet(f"{path}/vectors").count() == index.count()


def test_empty_indexes_have_no_hits(spark, data):
    index, chunks = R._vectors(spark, data), R._chunks(spark, data)
    dense, lexical = fresh_folder(spark), fresh_folder(spark)
    vector_index.build(dense, index.limit(0))
    queries = index.limit(3).select(F.col("doc_id").alias("query_id"), "vector")
    assert vector_index.search(spark, dense, queries, 5).count() == 0
    lexical_index.append(lexical, chunks.limit(0), fields(), "01")
    asked = R._asked(spark, data).select("query_id", R.coarse(F.col("text")).alias("terms"))
    assert lexical_index.search(spark, lexical, asked, BOOSTS, 5).count() == 0
    lexical_index.append(lexical, chunks.limit(50), fields(), "02")
    assert lexical_index.search(spark, lexical, asked, BOOSTS, 5).count() > 0


def test_replacement_leaves_other_partitions_alone(spark):
    path = fresh_folder(spark)
    old = spark.createDataFrame([(d, k, f"old {d} {k}", d % 4) for d in range(40) for k in range(3)], "doc_id long, chunk_index long, content string, bucket_id long")
    replace.create(path, old)

    def files(b):
        return sorted(os.path.basename(f) for f in glob.glob(f"{path.removeprefix('file://')}/bucket_id={b}/*.parquet"))

    before = {b: files(b) for b in range(4)}
    fresh = spark.createDataFrame([(5, 0, "new", 1), (9, 0, "new", 1), (9, 0, "new", 1), (77, 0, "first", 1)], old.schema)
    for _ in range(2):  # again, as after a crash
        replace.replace_documents(path, fresh)
    assert {b: files(b) for b in (0, 2, 3)} == {b: before[b] for b in (0, 2, 3)} and files(1) != before[1]
    want = [tuple(r) for r in old.collect() if r.doc_id not in (5, 9)] + [tuple(r) for r in fresh.collect()]
    assert rows(spark.read.parquet(path).select(old.columns)) == sorted(want, key=repr)
    replace.replace_documents(path, fresh.limit(0))
    assert spark.read.parquet(path).count() == len(want)


def test_batches_are_those_of_a_plain_loop(spark, monkeypatch):
    monkeypatch.setattr(batching, "CELL", 8)
    r = random.Random(4)
    docs = [(d, k, r.choice([0, 0, 1, 5, 40, 200])) for d in (1, 2, 3, None) for k in range(r.randint(1, 120))] + [(9, 0, None)]
    got = batching.batches(spark.createDataFrame(docs, "d long, k long, s long"), "d", "k", F.col("s"), 100, 7)
    want, at = [], {}
    for d, k, s in docs:
        batch, n, held = at.get(d, (0, 0, 0))
        if n and (n >= 7 or held + (s or 0) > 100):
            batch, n, held = batch + 1, 0, 0
        at[d] = (batch, n + 1, held + (s or 0))
        want.append((d, k, batch))
    assert rows(got) == sorted(want, key=repr)
    assert batching.batches(spark.createDataFrame([], "d long, k long, s long"), "d", "k", F.col("s")).count() == 0


def test_points_in_spans(spark):
    r = random.Random(2)
    points = [(d, r.randint(0, 400), k) for k, d in enumerate([1, 1, 2, 3] * 40)] + [(1, None, -1)]
    spans = [(d, low, low + r.randint(-2, 90), k) for k, d in enumerate([1, 2, 2] * 25) for low in [r.randint(0, 380)]]
    got = intervals.within(spark.createDataFrame(points, "d long, at long, p long"), spark.createDataFrame(spans, "d long, low long, high long, s long"), "d", "at", "low", "high", 16)
    want = [(p, s) for d, at, p in points for e, low, high, s in spans if d == e and at is not None and low <= at <= high]
    assert rows(got.select("p", "s")) == sorted(want, key=repr)


def plain_merge(found: list[tuple], gap: int) -> list[tuple]:
    left = [(*b, 1) for b in found]
    while True:
        for i, a in enumerate(left):
            j = next((j for j, b in enumerate(left) if j != i and a[0] - gap <= b[2] and b[0] - gap <= a[2] and a[1] - gap <= b[3] and b[1] - gap <= a[3]), None)
            if j is not None:
                b = left[j]
                left = [x for k, x in enumerate(left) if k not in (i, j)] + [(min(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2]), max(a[3], b[3]), a[4] + b[4])]
                break
        else:
            return sorted(left)


@pytest.mark.parametrize("gap", [0, 24])
def test_boxes_are_merged_to_a_fixpoint(spark, gap):
    r = random.Random(gap)
    made = [(p, k, x, y, x + r.randint(0, 120), y + r.randint(0, 90)) for p in range(6) for k in range(4 * p + 1) for x, y in [(r.randint(-50, 1500), r.randint(0, 1500))]]
    got = boxes.merged(spark.createDataFrame(made, "page long, id long, x0 long, y0 long, x1 long, y1 long"), gap, 100).collect()
    for p in range(6):
        assert sorted((r.x0, r.y0, r.x1, r.y1, r.parts) for r in got if r.page == p) == plain_merge([b[2:] for b in made if b[0] == p], gap)


def test_boxes_covered_by_others(spark):
    r = random.Random(8)

    def some(n):
        return [(p, k, x, y, x + r.randint(0, 200), y + r.randint(0, 200)) for p in range(3) for k in range(n) for x, y in [(r.randint(0, 500), r.randint(0, 500))]]

    regions, others, schema = some(15), some(10), "page long, id long, x0 long, y0 long, x1 long, y1 long"
    got = boxes.excluded(spark.createDataFrame(regions, schema), spark.createDataFrame(others, schema), cell=64)
    want = set()
    for p, k, x0, y0, x1, y1 in regions:
        for q, _, u0, v0, u1, v1 in others:
            wide, high = min(x1, u1) - max(x0, u0), min(y1, v1) - max(y0, v0)
            if p == q and wide > 0 and high > 0 and (wide * high / ((x1 - x0) * (y1 - y0)) >= 0.35 or wide * high / ((u1 - u0) * (v1 - v0)) >= 0.55):
                want.add((p, k))
    assert {(r.page, r.id) for r in got.collect()} == want


def test_streamed_state_is_that_of_the_whole_log(spark, tmp_path):
    """Late and repeated events, and a restart from the checkpoint between files."""
    r = random.Random(6)
    base = 1_700_000_000
    events = [(t, r.choice(state.STAGES), r.choice(["PROCESSING", "SUCCESS", "SUCCESS", "FAILED"]), base + 10 * n + r.randint(-300, 0), n) for n, t in enumerate(r.choices(range(12), k=240))]
    events += [(99, s, "SUCCESS", base + k, 1000 + k) for k, s in enumerate(state.STAGES)]
    schema = "task_id long, stage string, status string, ts timestamp, seq long"
    table = spark.createDataFrame([(t, s, x, at, n) for t, s, x, at, n in events], "task_id long, stage string, status string, at long, seq long").select("task_id", "stage", "status", F.timestamp_seconds("at").alias("ts"), "seq")
    source, out, kept = (str(tmp_path / n) for n in ("in", "out", "kept"))
    for part in range(2):
        table.where(f"seq % 2 = {part}").unionByName(table.where("seq % 7 = 0")).coalesce(1).write.mode("append").parquet(source)
        stream = task_states(spark.readStream.schema(schema).parquet(source), "1 day").writeStream.format("parquet").option("path", out).option("checkpointLocation", kept).trigger(availableNow=True).start()
        stream.awaitTermination(120)
    late = spark.createDataFrame([(500, "cleaning", "PROCESSING", base + 400_000, 5000)], "task_id long, stage string, status string, at long, seq long").select("task_id", "stage", "status", F.timestamp_seconds("at").alias("ts"), "seq")
    late.coalesce(1).write.mode("append").parquet(source)
    task_states(spark.readStream.schema(schema).parquet(source), "1 day").writeStream.format("parquet").option("path", out).option("checkpointLocation", kept).trigger(availableNow=True).start().awaitTermination(120)
    told = spark.read.parquet(out).collect()
    want = {r.task_id: r for r in state.task_row(state.fold_stages(table)).collect()}
    for task, row in want.items():
        mine = [x for x in told if x.task_id == task]
        final = max(mine, key=lambda x: (x.updated, x.events, x.status == "STALE"))
        assert (final.failed_stage, final.recover_from_stage) == (row.failed_stage, row.recover_from_stage)
        assert ("STALE" in {x.status for x in mine}) == (row.recover_from_stage is not None)
    assert {x.status for x in told if x.task_id == 99} >= {"COMPLETE"}
