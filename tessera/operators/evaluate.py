"""Retrieval quality: top1, recall, reciprocal rank and nDCG at k, averaged over queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def per_query(ranked: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """Metrics of each query from ranked (query_id, chunk_id, rank) and relevant (query_id, chunk_id).

    A query with nothing relevant counts as 0 in all.
    """
    gold = relevant.select("query_id", "chunk_id").distinct()
    return _judged(ranked, gold, gold.groupBy("query_id").agg(F.count("*").alias("n")), k)


def per_label(ranked: DataFrame, asked: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """Metrics of each query where all items of its label are relevant: `asked` (query_id, label), `items` (chunk_id, label), one label each.

    Relevant pairs, of which there are queries times items, aren't made: hits are looked up, and a label's items counted.
    """
    labels, items = asked.select("query_id", "label").distinct(), items.select("chunk_id", "label").distinct()
    gold = ranked.where(F.col("rank") <= k).select("query_id", "chunk_id").distinct().join(labels, "query_id").join(items, ["chunk_id", "label"], "left_semi")
    sizes = labels.join(items.groupBy("label").agg(F.count("*").alias("n")), "label").select("query_id", "n")
    return _judged(ranked, gold.select("query_id", "chunk_id"), sizes, k)


def _judged(ranked: DataFrame, gold: DataFrame, sizes: DataFrame, k: int) -> DataFrame:
    """Metrics of each query from the relevant pairs that matter and how many relevant ones each query has (query_id, n)."""
    gold = gold.withColumn("hit", F.lit(1))
    judged = ranked.where(F.col("rank") <= k).join(gold, ["query_id", "chunk_id"], "left")
    found = judged.groupBy("query_id").agg(
        F.coalesce(F.max(F.when(F.col("rank") == 1, F.col("hit"))), F.lit(0)).cast("double").alias("top1"),
        F.coalesce(F.sum("hit"), F.lit(0)).alias("found"),
        F.coalesce(1.0 / F.min(F.when(F.col("hit") == 1, F.col("rank"))), F.lit(0.0)).alias("mrr"),
        F.coalesce(F.sum(F.when(F.col("hit") == 1, 1.0 / F.log2(F.col("rank") + 1.0))), F.lit(0.0)).alias("dcg"),
    )
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.col("n"), F.lit(k))).cast("int")), F.lit(0.0), lambda s, r: s + 1.0 / F.log2(r + 1.0))
    joined = ranked.select("query_id").distinct().join(found, "query_id", "left").join(sizes, "query_id", "left")
    none = F.col("n").isNull()
    return joined.select(
        "query_id",
        F.coalesce("top1", F.lit(0.0)).alias("top1"),
        F.when(none, 0.0).otherwise(F.coalesce("found", F.lit(0)) / F.col("n")).alias("recall"),
        F.coalesce("mrr", F.lit(0.0)).alias("mrr"),
        F.when(none, 0.0).otherwise(F.coalesce("dcg", F.lit(0.0)) / ideal).alias("ndcg"),
    )


def metrics(ranked: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """One row: the queries and the mean of each metric."""
    return means(per_query(ranked, relevant, k))


def means(each: DataFrame) -> DataFrame:
    """One row from each query's metrics: the queries and the mean of each metric."""
    return each.agg(F.count("*").alias("queries"), *[F.avg(m).alias(m) for m in ("top1", "recall", "mrr", "ndcg")])


def median_round(rounds: DataFrame) -> DataFrame:
    """Of timed rounds (name, round, ms) the one of each name that is nearest to the median, the earliest of equals."""
    mid = rounds.groupBy("name").agg(F.percentile("ms", F.lit(0.5)).alias("median"))
    return rounds.join(mid, "name").groupBy("name").agg(F.min_by(F.struct("round", "ms"), F.struct(F.round(F.abs(F.col("ms") - F.col("median")), 6), "round")).alias("b"), F.first("median").alias("median")).select("name", "b.round", "b.ms", "median")
