"""Contiguous shards of equal byte size, from global prefix sums of per-partition totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.llm.common import cut_lineage, text_key

#: The line of documents is laid out in so many cells, by the hash of the text.
CELLS = 4096
KEY = ["key_hash", "key_crc", "key_bytes"]


def placed(docs: DataFrame, shards: int, cells: int = CELLS) -> DataFrame:
    """_row, doc_id, size, text_crc32, shard, slot of each row of `docs`, where _row is its monotonically_increasing_id.

    All rows lie on one line, in the order of cell, text, partition of `docs` that holds them, and place in it. Equal
    texts of one partition are a run. The totals of runs, summed within each cell, and of cells, summed over all, are
    global prefix sums of bytes, and the line is cut at equal targets, whatever its size. A group of equal texts goes
    whole to the shard in which its middle lies. Where a cut falls into one, what follows it on the line is moved before
    it, so that it begins at the cut: there is one at each cut at most. Only a group larger than a shard is parted: these
    come first on the line, and their rows go each to the shard in which its own middle lies. So a shard is off its
    target by no more than the groups (or documents) that end it. A group of copies, however large, is a run for each
    partition, so it never meets in one task.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    base = cut_lineage(
        docs.select("doc_id", F.monotonically_increasing_id().alias("_row"), F.crc32(text).alias("text_crc32"), (F.octet_length(text) + 8).cast("long").alias("size"), *text_key("text"))
    ).withColumn("part", F.shiftright("_row", 33))
    runs = cut_lineage(base.groupBy(*KEY, "part").agg(F.count("*").alias("n"), F.first("size").alias("size")))
    target = max(runs.agg(F.coalesce(F.sum(F.col("n") * F.col("size")), F.lit(0))).first()[0], 1) / shards
    cell = F.pmod("key_hash", F.lit(cells))
    sized = runs.withColumn("bytes", F.sum(F.col("n") * F.col("size")).over(W.partitionBy(*KEY)))
    sized = cut_lineage(sized.withColumn("cell", F.when(F.col("bytes") > target, cell - cells).otherwise(cell)))
    line = (
        _offset(sized, "at", F.col("n") * F.col("size"), ["cell"], W.partitionBy("cell").orderBy(*KEY, "part"))
        .withColumn("low", F.min("at").over(W.partitionBy("cell", *KEY)))
        .withColumn("middle", F.col("low") + F.col("bytes") / 2)
    )
    line = cut_lineage(line)
    whole = F.col("bytes") <= target
    cut = F.ceil(F.col("low") / target) * target
    parted = line.where(whole & (F.col("at") == F.col("low")) & (cut > F.col("low")) & (cut < F.col("low") + F.col("bytes")))
    moved = F.col("middle")
    for r in parted.select("low", "bytes", (cut - F.col("low")).alias("by")).collect():  # one for each cut at most
        after = r.low + r.bytes
        moved = F.when(F.col("low") == r.low, F.col("middle") + r.by).when((F.col("middle") >= after) & (F.col("middle") < after + r.by), F.col("middle") - r.bytes).otherwise(moved)
    own = lambda turn: F.col("at") + (turn + 0.5) * F.col("size")
    spread = F.transform(F.sequence(_shard(own(F.lit(0)), target, shards), _shard(own(F.col("n") - 1), target, shards)), lambda s: F.struct(F.greatest(F.lit(0), F.ceil((s * target - F.col("at")) / F.col("size") - 0.5)).cast("long").alias("first"), s.alias("shard")))
    alone = F.array(F.struct(F.lit(0).cast("long").alias("first"), _shard(moved, target, shards).alias("shard")))
    pieces = line.withColumn("e", F.explode(F.when(whole, alone).otherwise(spread))).select(*KEY, "part", "cell", "n", "e.shard", "e.first")
    later = F.lead("first").over(W.partitionBy(*KEY, "part").orderBy("first", "shard"))
    pieces = cut_lineage(pieces.withColumn("count", F.coalesce(later, F.col("n")) - F.col("first")).where("count > 0"))
    slots = _offset(pieces, "slot", F.col("count"), ["shard", "cell"], W.partitionBy("shard", "cell").orderBy(*KEY, "part"))
    starts = slots.groupBy(*KEY, "part").agg(F.array_sort(F.collect_list(F.struct("first", "shard", "slot"))).alias("pieces"))  # one for each shard at most
    turn = F.row_number().over(W.partitionBy(*KEY, "part").orderBy("_row")) - 1
    rows = base.withColumn("turn", turn).join(starts, [*KEY, "part"]).withColumn("mine", F.element_at(F.filter("pieces", lambda e: e["first"] <= F.col("turn")), -1))
    return rows.select("_row", "doc_id", "size", "text_crc32", "mine.shard", (F.col("mine.slot") + F.col("turn") - F.col("mine.first")).alias("slot"))


def _offset(df: DataFrame, name: str, amount: Column, by: list[str], order) -> DataFrame:
    """`df` with the sum of `amount` over all rows before: within a cell by a window, between cells by their totals.

    With a shard before the cell in `by`, the sums begin anew in each shard.
    """
    totals = df.groupBy(*by).agg(F.sum(amount).alias("all")).orderBy(*by).collect()  # a row for each cell, in all few shards
    offsets, sums = [], {}
    for r in totals:
        before = sums.get(r[:-2], 0)
        offsets.append((*r[:-1], before))
        sums[r[:-2]] = before + r[-1]
    kinds = ", ".join(f"`_{c}` {df.schema[c].dataType.simpleString()}" for c in by)
    before = df.sparkSession.createDataFrame(offsets, f"{kinds}, before long")
    same = F.lit(True)
    for c in by:
        same = same & (F.col(c) == F.col(f"_{c}"))
    rows = df.join(F.broadcast(before), same)
    return rows.withColumn(name, F.col("before") + F.sum(amount).over(order.rowsBetween(W.unboundedPreceding, W.currentRow)) - amount).drop("before", *[f"_{c}" for c in by])


def _shard(middle: Column, target: float, shards: int) -> Column:
    return F.least(F.floor(middle / target), F.lit(shards - 1)).cast("int")


def shard_by_bytes(docs: DataFrame, shards: int = 24, cells: int = CELLS) -> DataFrame:
    """Every row of `docs` with its shard and its place there: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Size is the UTF-8 length of the text plus 8; `placed` tells how the line of documents is cut.

    Null text: no bytes, size 8, crc of the empty text; it is in one group with empty texts. Null and repeated doc_ids
    are ordinary rows. A document larger than a shard lies in one shard and leaves its neighbours empty. Empty input:
    empty result. Further columns of `docs` are ignored.
    """
    law = [F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")]
    return placed(docs.select("doc_id", "text"), shards, cells).select("doc_id", "size", "text_crc32", *law)


def sharded(docs: DataFrame, shards: int = 24, cells: int = CELLS) -> DataFrame:
    """The rows of `docs`, all columns as they were, with `shard` and `slot`; columns with these names are replaced.

    `docs` is read twice and must give the same rows in the same tasks, as a table does.
    """
    docs = docs.drop("shard", "slot")
    places = placed(docs.select("doc_id", "text"), shards, cells).select("_row", "shard", "slot")
    numbered = docs.toDF(*[f"_kept_{k}" for k in range(len(docs.columns))]).withColumn("_row", F.monotonically_increasing_id())
    return numbered.join(places, "_row").drop("_row").toDF(*docs.columns, "shard", "slot")
