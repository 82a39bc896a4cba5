"""Heading-aware chunks from Markdown blocks, with derived table and image chunks and neighbour context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.functions.text import estimate_tokens, table_shape

LEAST_TOKENS, DYNAMIC_LEVELS, OVERLAP = 128, 5, 64
INLINE = {"tokens": 256, "rows": 12, "cols": 5}


def boundaries(levels: Column, tokens: Column, least: int = LEAST_TOKENS) -> Column:
    """The chunk of each visible block of a document, from heading levels (null for others) and token estimates.

    A chunk ends only before a heading, and never while it holds nothing but headings: if it has `least` tokens, or if
    the heading isn't below the last one, unless both are the document's deepest.
    """
    deepest = F.array_max(F.filter(levels, lambda x: x <= DYNAMIC_LEVELS))
    zero = F.struct(F.lit(0).alias("chunk"), F.lit(0).cast("long").alias("size"), F.lit(None).cast("int").alias("last"), F.lit(True).alias("bare"), F.array().cast("array<int>").alias("out"))

    def step(a: Column, x: Column) -> Column:
        heading = x["level"].isNotNull()
        near = (x["level"] <= DYNAMIC_LEVELS) & a["last"].isNotNull()
        returns = near & (x["level"] <= a["last"]) & ~((x["level"] == a["last"]) & (x["level"] == deepest))
        cut = heading & ~a["bare"] & ((a["size"] >= least) | F.coalesce(returns, F.lit(False)))
        chunk = a["chunk"] + F.when(cut, 1).otherwise(0)
        last = F.when(heading & (x["level"] <= DYNAMIC_LEVELS), x["level"]).when(cut, F.lit(None).cast("int")).otherwise(a["last"])
        return F.struct(
            chunk.alias("chunk"), (F.when(cut, 0).otherwise(a["size"]) + x["tokens"]).cast("long").alias("size"), last.alias("last"),
            (F.when(cut, True).otherwise(a["bare"]) & heading).alias("bare"), F.concat(a["out"], F.array(chunk)).alias("out"),
        )

    return F.aggregate(F.zip_with(levels, tokens, lambda v, t: F.struct(v.cast("int").alias("level"), t.cast("long").alias("tokens"))), zero, step)["out"]


def assign(elements: DataFrame, key: str = "doc_id", least: int = LEAST_TOKENS) -> DataFrame:
    """Visible blocks with their chunk. A last chunk of headings alone goes to the one before.

    The fold needs a document's blocks together, as small structs without their content; content joins by position.
    """
    shown = elements.where(~F.col("type").isin("front_matter", "hr"))
    small = shown.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("element_index", "heading_level", estimate_tokens(F.col("content")).alias("t")))).alias("e"))
    cut = small.select(key, F.col("e.element_index").alias("i"), F.col("e.heading_level").alias("l"), boundaries(F.col("e.heading_level"), F.col("e.t"), least).alias("c"))
    last = F.element_at("c", -1)
    tail = F.filter(F.arrays_zip("l", "c"), lambda x: x["c"] == last)
    merged = F.when((last > 0) & F.forall(tail, lambda x: x["l"].isNotNull()), F.transform("c", lambda x: F.least(x, last - 1))).otherwise(F.col("c"))
    placed = cut.select(key, F.explode(F.arrays_zip("i", merged.alias("c"))).alias("x")).select(key, F.col("x.i").alias("element_index"), F.col("x.c").alias("chunk"))
    return shown.join(placed, [key, "element_index"])


def trails(assigned: DataFrame, key: str = "doc_id") -> DataFrame:
    """Blocks with their heading trail: the headings above, a heading itself included; a shallower one ends the deeper."""
    w = W.partitionBy(key).orderBy("element_index")
    out = assigned
    for n in range(1, 7):
        out = out.withColumn(f"_h{n}", F.last(F.when(F.col("heading_level") == n, F.struct("element_index", "heading_text")), ignorenulls=True).over(w))
        out = out.withColumn(f"_s{n}", F.max(F.when(F.col("heading_level") < n, F.col("element_index"))).over(w))
    live = [F.when(F.col(f"_h{n}").isNotNull() & (F.col(f"_s{n}").isNull() | (F.col(f"_s{n}") < F.col(f"_h{n}.element_index"))), F.col(f"_h{n}.heading_text")) for n in range(1, 7)]
    return out.withColumn("trail", F.array_compact(F.array(*live))).drop(*[f"_{k}{n}" for n in range(1, 7) for k in "hs"])


def mixed_chunks(assigned: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row a chunk: content, lines, types, source blocks, distinct heading trails in order, tokens, protection."""
    listed = trails(assigned, key).groupBy(key, "chunk").agg(F.array_sort(F.collect_list(F.struct("element_index", "content", "type", "start_line", "end_line", "trail"))).alias("e"))
    content = F.array_join(F.transform("e", lambda x: x["content"]), "\n\n")
    kinds = F.array_distinct("e.type")
    return listed.select(
        key, F.col("chunk").alias("chunk_index"), content.alias("content"), F.array_min("e.start_line").alias("start_line"), F.array_max("e.end_line").alias("end_line"), kinds.alias("element_types"),
        F.col("e.element_index").alias("source_element_indexes"), F.array_distinct(F.filter("e.trail", lambda t: F.size(t) > 0)).alias("heading_trails"), estimate_tokens(content).alias("token_count"),
        F.exists(kinds, lambda k: k.isin("code_block", "math_block", "table", "image")).alias("protected"),
    )


def derived_chunks(assigned: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row for each table and image: id by kind, its text with heading path and neighbours, and for tables whether it stays inline."""
    rows, cols = table_shape(F.col("content"))
    w, kind = W.partitionBy(key).orderBy("element_index"), W.partitionBy(key, "type").orderBy("element_index")
    beside = lambda f: F.substring(F.coalesce(f("content").over(w), F.lit("")), 1, OVERLAP * 4)
    near = trails(assigned, key).withColumns({"before": beside(F.lag), "after": beside(F.lead)})
    context = F.concat_ws("；", F.array_compact(F.array(F.when(F.col("before") != "", F.col("before")), F.when(F.col("after") != "", F.col("after")))))
    kept = near.where(F.col("type").isin("table", "image")).withColumns({"table_rows": rows, "table_cols": cols, "tokens": estimate_tokens(F.col("content"))})
    inline = (F.col("type") == "table") & (F.col("tokens") <= INLINE["tokens"]) & (F.col("table_rows") <= INLINE["rows"]) & (F.col("table_cols") <= INLINE["cols"])
    return kept.select(
        key, F.col("chunk").alias("source_chunk_index"), F.concat("type", F.lit("_"), F.lpad(F.row_number().over(kind).cast("string"), 3, "0")).alias("element_id"), "element_index",
        F.concat_ws("\n", F.array_join("trail", " > "), "content", context).alias("content"), inline.alias("inline"), "table_rows", "table_cols",
    )


def with_neighbours(chunks: DataFrame, key: str = "doc_id", overlap: int = OVERLAP) -> DataFrame:
    """Chunks with what fits of the end of the eligible chunk before and the start of the one after; protected ones stay."""
    chars = min(overlap, OVERLAP) * 4
    w = W.partitionBy(key).orderBy("chunk_index")
    free = chunks.where(~F.col("protected")).withColumns({"_p": F.lag("content").over(w), "_n": F.lead("content").over(w)})
    tail, head = F.ltrim(F.right("_p", F.lit(chars))), F.rtrim(F.substring("_n", 1, chars))
    composed = F.concat_ws("\n\n", tail, F.col("content"), head)
    changed = free.select(key, "chunk_index", composed.alias("with_context"), F.coalesce(estimate_tokens(tail), F.lit(0)).alias("context_prev_tokens"), F.coalesce(estimate_tokens(head), F.lit(0)).alias("context_next_tokens"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return chunks.join(changed, [key, "chunk_index"], "left").select(*chunks.columns, F.coalesce("with_context", "content").alias("with_context"), zero("context_prev_tokens"), zero("context_next_tokens"))


def uncovered(elements: DataFrame, chunks: DataFrame, key: str = "doc_id") -> DataFrame:
    """Visible blocks that no chunk holds: none, if the chunker is right."""
    held = chunks.select(key, F.explode("source_element_indexes").alias("element_index"))
    return elements.where(~F.col("type").isin("front_matter", "hr")).select(key, "element_index").join(held, [key, "element_index"], "left_anti")
