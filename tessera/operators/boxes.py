"""Boxes on pages: merging those that touch until none do, and leaving out those that others cover."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.session import written

SIDES = ["x0", "y0", "x1", "y1"]


def cells(cell: int, gap: int = 0) -> Column:
    """The grid cells that a box covers with `gap` around it, as (cx, cy)."""
    across = F.sequence(F.floor((F.col("x0") - gap) / cell), F.floor((F.col("x1") + gap) / cell))
    down = F.sequence(F.floor((F.col("y0") - gap) / cell), F.floor((F.col("y1") + gap) / cell))
    return F.flatten(F.transform(across, lambda x: F.transform(down, lambda y: F.struct(x.alias("cx"), y.alias("cy")))))


def touching(boxes: DataFrame, others: DataFrame, gap: int, cell: int) -> DataFrame:
    """(page, a, b) of `boxes` and `others` (page, id, x0, y0, x1, y1) that overlap or lie at most `gap` apart, a pair once.

    They meet in grid cells. A pair that shares several is taken in the one that holds the lower corner of what the
    widened box and the other have in common, so that pairs needn't be made distinct.
    """
    a = boxes.withColumn("_c", F.explode(cells(cell, gap))).select("page", F.col("id").alias("a"), *[F.col(s).alias(f"a{s}") for s in SIDES], "_c")
    b = others.withColumn("_c", F.explode(cells(cell))).select(F.col("page").alias("_page"), F.col("id").alias("b"), *[F.col(s).alias(f"b{s}") for s in SIDES], F.col("_c").alias("_d"))
    near = (F.col("ax0") - gap <= F.col("bx1")) & (F.col("bx0") <= F.col("ax1") + gap) & (F.col("ay0") - gap <= F.col("by1")) & (F.col("by0") <= F.col("ay1") + gap)
    corner = (F.floor(F.greatest(F.col("ax0") - gap, F.col("bx0")) / cell) == F.col("_c.cx")) & (F.floor(F.greatest(F.col("ay0") - gap, F.col("by0")) / cell) == F.col("_c.cy"))
    return a.join(b, (F.col("page") == F.col("_page")) & (F.col("_c.cx") == F.col("_d.cx")) & (F.col("_c.cy") == F.col("_d.cy")) & near & corner).select("page", "a", "b")


def merged(boxes: DataFrame, gap: int = 24, cell: int = 256) -> DataFrame:
    """page, id (the least of its boxes'), x0, y0, x1, y1, parts: boxes that touch within `gap` as one, until none touch.

    What is left doesn't depend on the order of merging, as a box only grows. A page of at most FEW boxes is one row, whose
    boxes are merged one after the other; boxes of larger pages are merged in rounds, see `in_rounds`. Ids must differ
    within a page. Boxes with a null side are left out.
    """
    boxes = boxes.where(" AND ".join(f"{s} IS NOT NULL" for s in SIDES)).select("page", "id", *SIDES)
    page = W.partitionBy("page")
    sized = boxes.withColumns({"_n": F.count("*").over(page), "_ids": F.count("id").over(page)})
    few = F.col("page").isNotNull() & (F.col("_n") <= FEW) & (F.col("_ids") == F.col("_n"))
    listed = sized.where(few).groupBy("page").agg(F.collect_list(F.struct("id", *SIDES)).alias("b"))
    kinds = ", ".join(f"{c} {boxes.schema[c].dataType.simpleString()}" for c in ["page", "id", *SIDES])
    names = ["page", "id", *SIDES, "parts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column(1).flatten()
            found, start, at, out = list(zip(*[c.to_pylist() for c in flat.flatten()], strict=True)), 0, [], []
            for k, n in enumerate(pc.list_value_length(batch.column(1)).to_pylist()):
                left = settled([(*b, 1) for b in found[start : start + n]], gap)
                at += [k] * len(left)
                out += left
                start += n
            columns = [pa.array([b[c] for b in out], flat.type.field(c).type) for c in range(5)] if out else [pa.array([], flat.type.field(c).type) for c in range(5)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *columns, pa.array([b[5] for b in out], pa.int64())], names)

    return listed.mapInArrow(run, f"{kinds}, parts long").unionByName(in_rounds(sized.where(~few).select("page", "id", *SIDES), gap, cell))


#: Boxes of a page that is merged as one row.
FEW = 64


def settled(boxes: list[tuple], gap: int) -> list[tuple]:
    """Boxes (id, x0, y0, x1, y1, parts), those that touch within `gap` merged until none do."""
    out: list[tuple] = []
    for i, x0, y0, x1, y1, parts in boxes:
        k = 0
        while k < len(out):
            j, a0, b0, a1, b1, more = out[k]
            if x0 - gap <= a1 and a0 <= x1 + gap and y0 - gap <= b1 and b0 <= y1 + gap:
                i, x0, y0, x1, y1, parts = min(i, j), min(x0, a0), min(y0, b0), max(x1, a1), max(y1, b1), parts + more
                del out[k]
                k = 0  # the box grew, and may touch what it didn't
            else:
                k += 1
        out.append((i, x0, y0, x1, y1, parts))
    return out


def in_rounds(boxes: DataFrame, gap: int = 24, cell: int = 256) -> DataFrame:
    """As `merged`, for pages of any size, and boxes without a page, which touch none.

    Each round finds touching pairs in grid cells, gives each box the least id among itself and those it touches, goes on
    to that box's own, and makes one box of each id. Pages on which none touch are done, and leave the rounds.
    """
    left, done = written(boxes.select("page", "id", *SIDES, F.lit(1).cast("long").alias("parts"))), []
    while True:
        pairs = written(touching(left, left, gap, cell).where("a <> b"))
        if pairs.isEmpty():
            return reduce(DataFrame.unionByName, [left, *done])
        open_ = pairs.select("page").distinct()
        done.append(written(left.join(open_, "page", "left_anti")))
        least = pairs.groupBy("page", "a").agg(F.least(F.min("b"), F.first("a")).alias("to"))
        further = least.select("page", F.col("a").alias("to"), F.col("to").alias("next"))
        ends = least.join(further, ["page", "to"], "left").select("page", F.col("a").alias("id"), F.coalesce("next", "to").alias("to"))
        named = left.join(open_, "page", "left_semi").join(ends, ["page", "id"], "left").withColumn("id", F.coalesce("to", "id"))
        left = written(named.groupBy("page", "id").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"), F.sum("parts").alias("parts")))


def excluded(regions: DataFrame, others: DataFrame, of_region: float = 0.35, of_other: float = 0.55, cell: int = 256) -> DataFrame:
    """(page, id) of the regions of which another box covers `of_region` or more, or that cover `of_other` or more of it.

    Boxes that only share an edge cover nothing; regions without area are never excluded.
    """
    pairs = touching(regions, others, 0, cell)
    r = regions.select("page", F.col("id").alias("a"), *[F.col(s).alias(f"a{s}") for s in SIDES])
    o = others.select("page", F.col("id").alias("b"), *[F.col(s).alias(f"b{s}") for s in SIDES])
    wide = F.least("ax1", "bx1") - F.greatest("ax0", "bx0")
    high = F.least("ay1", "by1") - F.greatest("ay0", "by0")

    def area(p: str) -> Column:
        return (F.col(f"{p}x1") - F.col(f"{p}x0")) * (F.col(f"{p}y1") - F.col(f"{p}y0"))

    both = pairs.join(r, ["page", "a"]).join(o, ["page", "b"]).where((wide > 0) & (high > 0) & (area("a") > 0))
    return both.where((wide * high / area("a") >= of_region) | (wide * high / area("b") >= of_other)).select("page", F.col("a").alias("id")).distinct()
