"""Semantic chunking of atoms with vectors: adjacent distances, a percentile threshold, and greedy grouping."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.functions.text import cosine, estimate_tokens


def atoms(text: Column, most: int) -> Column:
    """Paragraphs of a text; one over `most` tokens gives its lines, and a line over it its sentences."""
    sentence = r"(?<=[。！？；])|(?<=[.?!;])\s+"

    def parts(whole: Column, pattern: str) -> Column:
        return F.filter(F.transform(F.split(whole, pattern, -1), F.trim), lambda x: x != "")

    def deeper(x: Column) -> Column:
        lines = F.flatten(F.transform(parts(x, "\n"), lambda y: F.when(estimate_tokens(y) > most, parts(y, sentence)).otherwise(F.array(y))))
        return F.when(estimate_tokens(x) > most, lines).otherwise(F.array(x))

    return F.flatten(F.transform(parts(text, r"\n{2,}"), deeper))


def distances(vectors: DataFrame) -> DataFrame:
    """(doc_id, position, distance): cosine distance of each vector (doc_id, position, vector) to the one before it."""
    before = F.lag("vector").over(W.partitionBy("doc_id").orderBy("position"))
    return vectors.withColumn("_b", before).where("_b is not null").select("doc_id", "position", (1 - cosine(F.col("vector"), F.col("_b"))).alias("distance"))


def groups(atoms: DataFrame, gate: float, least: int, most: int) -> DataFrame:
    """All columns of atoms (doc_id, position, cost, gap, threshold) and `chunk`, the group of each in its document.

    A new one begins where the group would go over `most` tokens, or where the gap before the atom is above threshold and
    gate and the group has `least` tokens. A null gap never parts. A group depends on the one before it, so documents are
    dealt out, sorted and streamed: a task holds the last group's size alone.
    """
    names = atoms.columns
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in atoms.schema)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, group, size = None, 0, 0
        for f in frames:
            out = []
            for doc, cost, gap, threshold in zip(f["doc_id"], f["cost"], f["gap"], f["threshold"], strict=True):
                mark = (None if pd.isna(doc) else doc,)
                far = pd.notna(gap) and pd.notna(threshold) and gap > max(threshold, gate) and size >= least
                if mark != at:
                    at, group, size = mark, 0, 0
                elif size + cost > most or far:
                    group, size = group + 1, 0
                size += cost
                out.append(group)
            yield f[names].assign(chunk=out)

    return atoms.repartition("doc_id").sortWithinPartitions("doc_id", "position").mapInPandas(run, f"{kinds}, chunk long")


def chunks(texts: DataFrame, percentile: float = 0.95, gate: float = 0.25, least: int = 1, most: int = 512) -> DataFrame:
    """(doc_id, chunk, atoms, content) of atoms (doc_id, position, text, vector) in groups of like meaning.

    A document one of whose vectors is missing is grouped by length alone. Null texts count as empty.
    """
    before = F.lag("vector").over(W.partitionBy("doc_id").orderBy("position"))
    rows = texts.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("gap", F.when(before.isNotNull(), 1 - cosine(F.col("vector"), before)))
    edge = rows.groupBy(F.col("doc_id").alias("_d")).agg(F.percentile("gap", F.lit(percentile)).alias("_t"), F.max(F.col("vector").isNull()).alias("_broken"))
    rows = rows.join(edge, F.col("doc_id").eqNullSafe(F.col("_d"))).withColumn("threshold", F.when(~F.col("_broken"), F.col("_t")))
    grouped = groups(rows.select("doc_id", "position", "text", estimate_tokens(F.col("text")).alias("cost"), "gap", "threshold"), gate, least, most)
    listed = F.array_sort(F.collect_list(F.struct("position", "text")))  # of one chunk, `most` tokens or one atom
    return grouped.groupBy("doc_id", "chunk").agg(F.count("*").alias("atoms"), F.array_join(F.transform(listed, lambda x: x["text"]), "\n\n").alias("content"))
