"""Joins of points with the intervals that hold them, and what rests on them: texts of images laid beside paragraphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Places in a bin.
BIN = 64


def within(points: DataFrame, spans: DataFrame, by: str, at: str, low: str, high: str, width: int = BIN) -> DataFrame:
    """All columns of `points` and `spans` (but for its `by`) where the point's `at` lies from `low` to `high` of the same `by`.

    A span is dealt to the bins that it covers and a point to its own, so that a document of many lines is no product of
    its points and spans; each pair meets in the point's bin alone. Null places and spans that end before they begin hold nothing.
    """
    bins = F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width)))
    dealt = spans.where(F.col(low) <= F.col(high)).withColumnRenamed(by, "_by").withColumn("_bin", bins)
    placed = points.withColumn("_of", F.floor(F.col(at) / width))
    met = placed.join(dealt, (F.col(by) == F.col("_by")) & (F.col("_of") == F.col("_bin")) & F.col(at).between(F.col(low), F.col(high)))
    return met.drop("_by", "_bin", "_of")


def lines(docs: DataFrame, by: str = "doc_id", text: str = "text") -> DataFrame:
    """by, line (from 0), content of every line of a text; null text: one empty line."""
    return docs.select(by, F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)).alias("line", "content"))


def blocks(rows: DataFrame, by: str = "doc_id", inside: Column | None = None) -> DataFrame:
    """by, start, stop of the runs of lines (by, line, content) that follow each other and are `inside`: not blank, if it isn't given."""
    kept = rows.where(F.col("content").rlike(r"(?U)\S") if inside is None else inside)
    run = F.col("line") - F.row_number().over(W.partitionBy(by).orderBy("line"))
    return kept.withColumn("_run", run).groupBy(by, "_run").agg(F.min("line").alias("start"), F.max("line").alias("stop")).drop("_run")


def described_blocks(images: DataFrame, spans: DataFrame, descriptions: DataFrame, by: str = "doc_id") -> DataFrame:
    """by, start, stop, descriptions: the distinct descriptions (url, description) of the images (by, line, url) in each span, in their order.

    Spans without a described image are left out. Blank and null descriptions are none.
    """
    told = descriptions.where(F.trim("description") != "").groupBy("url").agg(F.first("description").alias("description"))
    met = within(images, spans, by, "line", "start", "stop").join(told, "url")
    first = met.groupBy(by, "start", "stop", "description").agg(F.min(F.struct("line", "url")).alias("f"))
    ordered = F.array_sort(F.collect_list(F.struct("f", "description")))  # those of one block
    return first.groupBy(by, "start", "stop").agg(F.transform(ordered, lambda x: x["description"]).alias("descriptions"))
