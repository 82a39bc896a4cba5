"""The corpus pipeline stage by stage, on each stage's own input."""

from __future__ import annotations

from collections import Counter

import __spark_entry__
import corpus_pipeline
import pytest
from conftest import CLASHING

from tessera.llm import decontamination, mixing, neardup, quality
from tessera.llm.common import cut_lineage, read


@pytest.fixture(scope="module")
def steps(spark, data):
    """What each stage got and gave."""
    docs, out = read(spark, data, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        made = cut_lineage(stage(spark, docs, data))
        out.append((name, docs, made))
        docs = made
    return out


def test_stages_keep_the_columns(steps):
    for _, given, made in steps[:-1]:
        assert made.columns == given.columns


def test_each_stage_does_its_work(spark, data, steps):
    (_, d0, d1), (_, _, d2), (_, _, d3), (_, _, d4), (_, _, d5) = steps
    judged = {r.doc_id: r.accepted for r in quality.quality(d0, read(spark, data, "labels")).collect()}
    assert Counter(r.doc_id for r in d1.collect()) == Counter(k for k, v in judged.items() if v)
    classes = {r.class_id for r in neardup.near_duplicates(d1).collect()}
    assert sorted(r.doc_id for r in d2.collect()) == sorted(classes)
    leaking = {r.doc_id for r in decontamination.leaks(d2, read(spark, data, "benchmark")).where("size(hits) > 0").collect()}
    assert {r.doc_id for r in d2.collect()} - {r.doc_id for r in d3.collect()} == leaking
    times = Counter({r.doc_id: r.times for r in mixing.mix(d3).collect() if r.times})
    assert Counter(r.doc_id for r in d4.collect()) == times
    assert Counter(r.doc_id for r in d5.collect()) == times
    slots = {}
    for r in d5.collect():
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_run_is_the_stages(spark, data, steps):
    assert Counter(r.doc_id for r in corpus_pipeline.run(spark, data).collect()) == Counter(r.doc_id for r in steps[-1][2].collect())


def test_stages_bear_odd_and_empty_tables(spark, data, odd, clash):
    wide = clash(odd)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        made = stage(spark, wide, data)
        assert made.columns == wide.columns, name
        assert all(r[c] == f"extra {c}" for r in made.collect() for c in CLASHING), name
        assert stage(spark, odd.limit(0), data).count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, wide, data).count() == odd.count()


def test_entry_registers_all():
    names = __spark_entry__.queries()
    assert "pipeline" in names and {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{k}" for k in range(1, 11)}
