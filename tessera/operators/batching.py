"""Greedy bulk batches of ordered rows, found without gathering a document in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.session import written

#: Rows of a document that are looked at together, at least.
CELL = 4096


def numbered(rows: DataFrame) -> DataFrame:
    """Rows (k, o, s) in the order of o within each k, with at (place in its `by`, from 0) and before (sizes before it), by range partitions and their totals."""
    dealt = written(rows.repartitionByRange("k", "o").withColumn("_task", F.spark_partition_id()))
    inner = W.partitionBy("k", "_task").orderBy("o").rowsBetween(W.unboundedPreceding, W.currentRow)
    near = dealt.withColumn("at", F.count("*").over(inner) - 1).withColumn("before", F.sum("s").over(inner) - F.col("s"))
    outer = W.partitionBy("_k").orderBy("_of").rowsBetween(W.unboundedPreceding, -1)
    totals = dealt.groupBy(F.col("k").alias("_k"), F.col("_task").alias("_of")).agg(F.count("*").alias("_n"), F.sum("s").alias("_s"))
    totals = totals.select("_k", "_of", F.coalesce(F.sum("_n").over(outer), F.lit(0)).alias("_n0"), F.coalesce(F.sum("_s").over(outer), F.lit(0)).alias("_s0"))
    both = near.join(totals, F.col("k").eqNullSafe(F.col("_k")) & (F.col("_task") == F.col("_of")))
    return written(both.select("k", "o", "s", (F.col("at") + F.col("_n0")).alias("at"), (F.col("before") + F.col("_s0")).alias("before")))


def batches(docs: DataFrame, by: str, order: str, size: Column, max_bytes: int = 5 << 20, max_docs: int = 500) -> DataFrame:
    """by, order and batch of every row: within a `by`, in order, a batch is cut when it is full or would go over `max_bytes`.

    A row larger than that is a batch of its own. Prefix sums give, for a batch that began at any row, where the next one
    would: a bounded frame, within cells of a document and the one after. The batches there are begin at row 0 and lead
    from one to the next; pointers are doubled, so that chains of 2^k batches are followed in k rounds. So a document of
    any length is the work of many tasks. Null `by`: one group; null sizes count as 0; empty input: empty result.
    """
    rows = numbered(docs.select(F.col(by).alias("k"), F.col(order).alias("o"), F.coalesce(size, F.lit(0)).cast("long").alias("s")))
    width = max(CELL, max_docs)
    cell = F.floor(F.col("at") / width)
    copied = rows.withColumn("cell", F.explode(F.when(cell > 0, F.array(cell, cell - 1)).otherwise(F.array(cell))))
    reach = F.max(F.struct("at", (F.col("before") + F.col("s")).alias("end"))).over(W.partitionBy("k", "cell").orderBy("before").rangeBetween(0, max_bytes))
    last = F.when(reach["end"] <= F.col("before") + max_bytes, reach["at"] + 1).otherwise(reach["at"])
    cut = F.greatest(F.col("at") + 1, F.least(last, F.col("at") + max_docs))
    starts = copied.withColumn("next", cut).where(cell == F.col("cell")).select("k", "at", "next")
    steps = jump = written(starts)
    reached = written(starts.where("at = 0").select("k", "at", F.lit(0).cast("long").alias("batch")))
    span = 1
    while True:
        to = jump.select(F.col("k").alias("_k"), F.col("at").alias("_at"), F.col("next").alias("_next"))
        moved = reached.join(to, reached["k"].eqNullSafe(to["_k"]) & (reached["at"] == to["_at"])).select("k", F.col("_next").alias("at"), (F.col("batch") + span).alias("batch"))
        moved = written(moved.join(steps.select(F.col("k").alias("_k"), F.col("at").alias("_at")), F.col("k").eqNullSafe(F.col("_k")) & (F.col("at") == F.col("_at")), "left_semi"))
        if moved.isEmpty():
            break
        reached = reached.unionByName(moved)
        jump = written(jump.join(to, jump["k"].eqNullSafe(to["_k"]) & (jump["next"] == to["_at"])).select("k", "at", F.col("_next").alias("next")))
        span *= 2
    members = reached.join(steps.select(F.col("k").alias("_k"), F.col("at").alias("_at"), "next"), F.col("k").eqNullSafe(F.col("_k")) & (F.col("at") == F.col("_at")))
    members = members.select(F.col("k").alias("_k"), "batch", F.explode(F.sequence(F.col("at"), F.col("next") - 1)).alias("_in"))  # max_docs at most
    found = rows.join(members, F.col("k").eqNullSafe(F.col("_k")) & (F.col("at") == F.col("_in")))
    return found.select(F.col("k").alias(by), F.col("o").alias(order), "batch")


def pages(rows: DataFrame, by: str, item: str, most: int = 1000) -> DataFrame:
    """by, page, ids: the items of each `by` in order, in lists of at most `most`, so that no reason's list is unbounded."""
    placed = numbered(rows.select(F.col(by).alias("k"), F.col(item).alias("o"), F.lit(0).cast("long").alias("s")))
    paged = placed.groupBy("k", F.floor(F.col("at") / most).alias("page")).agg(F.sort_array(F.collect_list("o")).alias("ids"))
    return paged.select(F.col("k").alias(by), "page", "ids")
