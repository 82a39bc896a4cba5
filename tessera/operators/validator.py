"""Checks of a document's chunks: coverage, views, protected ranges and derived chunks, each fault a row."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: What stands between the blocks of a mixed chunk.
GAP = "\n\n"


def _faults(rows: DataFrame, rules: dict[str, Column], key: list[str]) -> DataFrame:
    """A row (key, fault) for each rule that holds of a row. An unknown condition counts as no fault."""
    found = F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules.items()]))
    return rows.select(*key, F.explode(found).alias("fault"))


def faults(elements: DataFrame, chunks: DataFrame, views: DataFrame, ranges: DataFrame) -> DataFrame:
    """Distinct (doc_id, chunk_id, fault) of all that is wrong with the chunks; chunk_id is null for a block that none holds.

    elements (doc_id, element_index, content), chunks (doc_id, chunk_id, kind: mixed or derived, content, source_id: of a
    derived chunk the mixed one, element_index: its block), views (doc_id, chunk_id, element_index, start, stop: where the
    block lies in the mixed chunk's content, end exclusive), ranges (doc_id, chunk_id, element_index, kind, start_line,
    end_line: what overlap mustn't cut).

    Rules: blocks are covered once; ids are unique; contents aren't blank; a mixed chunk has views, one after another with
    a blank line between and none beyond its content; a view's text is its block's; a protected range has a kind, lines in
    order and a block that the chunk views; a derived chunk's source is a mixed chunk of the document that views its block.
    Every rule is an equi-join or a window over one chunk's views, so that no document's chunks are compared pairwise.
    """
    key = ["doc_id", "chunk_id"]
    texts = elements.select(F.col("doc_id").alias("_d"), F.col("element_index").alias("_e"), F.col("content").alias("block"))
    mixed = chunks.where("kind = 'mixed'").select(*key, F.col("content").alias("whole"))
    of = [
        chunks.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").select(*key, F.lit("repeated id").alias("fault")),
        _faults(chunks, {"blank content": F.trim("content") == "", "unknown kind": ~F.coalesce(F.col("kind").isin("mixed", "derived"), F.lit(False))}, key),
    ]
    held = views.groupBy("doc_id", "element_index").agg(F.count("*").alias("times"))
    covered = elements.select("doc_id", "element_index").join(held, ["doc_id", "element_index"], "left")
    none = F.lit(None).cast(chunks.schema["chunk_id"].dataType)
    of.append(_faults(covered.withColumn("chunk_id", none), {"block in no chunk": F.col("times").isNull(), "block in several chunks": F.col("times") > 1}, key))
    of.append(mixed.join(views.select(*key).distinct(), key, "left_anti").select(*key, F.lit("no views").alias("fault")))
    order = W.partitionBy(*key).orderBy("start", "element_index")
    seen = views.join(mixed, key, "left").join(texts, (F.col("doc_id") == F.col("_d")) & (F.col("element_index") == F.col("_e")), "left")
    seen = seen.withColumns({"before": F.lag("stop").over(order), "earlier": F.lag("element_index").over(order)})
    inside = (F.col("start") >= 0) & (F.col("stop") >= F.col("start")) & (F.col("stop") <= F.length("whole"))
    text = F.substring(F.col("whole"), F.col("start").cast("int") + 1, (F.col("stop") - F.col("start")).cast("int"))
    rules = {
        "view of no mixed chunk": F.col("whole").isNull(),
        "view of no block": F.col("_e").isNull(),
        "view beyond the content": ~inside,
        "view isn't its block": inside & (text != F.col("block")),
        "views out of place": F.coalesce(F.col("start") != F.col("before") + len(GAP), F.col("start") != 0),
        "views out of order": F.col("element_index") <= F.col("earlier"),
    }
    of.append(_faults(seen, rules, key))
    known = views.select(*key, "element_index", F.lit(True).alias("viewed")).distinct()
    kept = ranges.join(known, [*key, "element_index"], "left")
    of.append(_faults(kept, {"range without kind": F.coalesce(F.trim("kind"), F.lit("")) == "", "range lines": (F.col("start_line") < 0) | (F.col("end_line") < F.col("start_line")), "range of no viewed block": F.col("viewed").isNull()}, key))
    derived = chunks.where("kind = 'derived'").select(*key, F.col("source_id"), "element_index")
    sources = mixed.select(F.col("doc_id").alias("_d"), F.col("chunk_id").alias("_s"))
    viewed = known.select(F.col("doc_id").alias("_vd"), F.col("chunk_id").alias("_vs"), F.col("element_index").alias("_ve"), "viewed")
    linked = derived.join(sources, (F.col("doc_id") == F.col("_d")) & (F.col("source_id") == F.col("_s")), "left")
    linked = linked.join(viewed, (F.col("doc_id") == F.col("_vd")) & (F.col("source_id") == F.col("_vs")) & (F.col("element_index") == F.col("_ve")), "left")
    of.append(_faults(linked, {"derived without source": F.col("_s").isNull(), "derived block not in source": F.col("_s").isNotNull() & F.col("viewed").isNull()}, key))
    return reduce(DataFrame.unionByName, of).distinct()
