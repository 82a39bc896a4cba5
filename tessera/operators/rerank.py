"""Reranking of fused hits, context packing and prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.functions.text import estimate_tokens

PROMPT = "{context}\n\n{query}"


def with_contents(hits: DataFrame, contents: DataFrame) -> DataFrame:
    """Hits whose chunk has a content that isn't blank, with it."""
    named = contents.where(F.trim("content") != "").select("chunk_id", "content")
    return hits.join(named, "chunk_id")


def map_results(hits: DataFrame, scores: DataFrame, top_n: int = 8) -> DataFrame:
    """Hits (query_id, chunk_id, rrf_rank) in the order of a reranker's scores (query_id, doc_index, position, score).

    doc_index counts a query's hits from 0 in RRF order. Indices out of range are ignored, of repeated ones the first
    counts. Scored hits come first by falling score, then the others in RRF order with a null score. A query without any
    usable score keeps its RRF order.
    """
    first = scores.withColumn("_n", F.row_number().over(W.partitionBy("query_id", "doc_index").orderBy("position"))).where("_n = 1")
    indexed = hits.withColumn("doc_index", F.row_number().over(W.partitionBy("query_id").orderBy("rrf_rank")) - 1)
    joined = indexed.join(first.select("query_id", "doc_index", F.col("score").alias("rerank_score")), ["query_id", "doc_index"], "left")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("rerank_score").desc_nulls_last(), "rrf_rank"))
    scored = F.max(F.col("rerank_score").isNotNull()).over(W.partitionBy("query_id"))
    out = joined.withColumn("_rank", rank).withColumn("rerank_rank", F.when(scored, F.col("_rank"))).where(F.col("_rank") <= top_n)
    return out.drop("doc_index", "_rank")


def rrf_order(hits: DataFrame, top_n: int = 8) -> DataFrame:
    """What a failed reranker leaves: the first `top_n` of each query in RRF order, without scores."""
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("rrf_rank"))
    return hits.withColumn("_r", rank).where(F.col("_r") <= top_n).drop("_r").withColumns({"rerank_score": F.lit(None).cast("double"), "rerank_rank": F.lit(None).cast("int")})


def packed(costs: Column, budget: int) -> Column:
    """Of an array of token costs, which are taken: the first always, another if it still fits; what doesn't is skipped."""
    zero = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<boolean>").alias("taken"))

    def step(a: Column, cost: Column) -> Column:
        fits = (F.size(a["taken"]) == 0) | (a["used"] + cost <= budget)
        return F.struct((a["used"] + F.when(fits, cost).otherwise(0)).alias("used"), F.concat(a["taken"], F.array(fits)).alias("taken"))

    return F.aggregate(costs, zero, step)["taken"]


def context(hits: DataFrame, contents: DataFrame, budget: int = 4000, label: str = "片段", most: int = 1000) -> DataFrame:
    """One row a query: the numbered blocks that fit the budget, in rank order, how many, and their tokens.

    `hits` (query_id, chunk_id, rank) holds at most `most` hits of a query: what a top-k left.
    """
    found = with_contents(hits.where(F.col("rank") <= most), contents).withColumn("cost", estimate_tokens(F.col("content")))
    listed = found.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "content", "cost"))).alias("h"))
    flagged = listed.withColumn("taken", packed(F.col("h.cost"), budget))
    kept = flagged.withColumn("kept", F.filter(F.arrays_zip("h", "taken"), lambda x: x["taken"]))
    blocks = F.transform("kept", lambda x, i: F.concat(F.lit(f"[{label}"), (i + 1).cast("string"), F.lit("]\n"), x["h"]["content"]))
    return kept.select(
        "query_id",
        F.size("kept").alias("blocks"),
        F.aggregate("kept", F.lit(0).cast("long"), lambda s, x: s + x["h"]["cost"]).alias("tokens"),
        F.array_join(blocks, "\n\n").alias("context"),
    )


def prompt(context_text: Column, query: Column, template: str = PROMPT) -> Column:
    """The user prompt of an answer."""
    before, _, rest = template.partition("{context}")
    between, _, after = rest.partition("{query}")
    return F.concat(F.lit(before), context_text, F.lit(between), query, F.lit(after))


def serialised(hits: DataFrame, columns: list[str]) -> DataFrame:
    """Hits as one JSON object each."""
    return hits.select("query_id", F.to_json(F.struct(*columns)).alias("json"))
