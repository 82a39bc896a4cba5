"""Mixing of sources to target weights by capped water-filling and seeded repetitions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.llm.common import cut_lineage, shielded

#: Buckets of the sampling hash whose totals find where a source's fractional repetition ends.
BUCKETS = 4096
#: A document with more than this part of its source's words is drawn apart from the others.
LARGE = 200
#: So many sources at most are broadcast (some 100 bytes each); more are joined by a shuffle.
BROADCAST_SOURCES = 100_000


def words(text: Column) -> Column:
    """Number of runs of characters other than ASCII white space; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sources: DataFrame, max_epochs: float = 3.0, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """`sources` (source, source_size) with weight and target.

    Sources in code point order, null last, get `weights` in turn and share the sum of all sizes by weight. A target
    stops at max_epochs times the size; the excess goes to the others by weight until none is above. The level at which
    that ends is found in one pass over the sources by cap / weight: the first one whose cap lies above its share of
    what the earlier ones leave, is not clamped, nor are those after it.
    """
    named = sources.withColumn("rank", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())))
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.col("rank") - 1) % len(weights) + 1).cast("int"))
    weighed = named.withColumn("weight", turn).withColumn("cap", F.col("source_size") * F.lit(float(max_epochs)))
    by = W.orderBy(F.col("cap") / F.col("weight"), "rank")
    shared = (
        weighed.withColumn("total", F.sum("source_size").over(W.partitionBy()))
        .withColumn("left", F.col("total") - F.coalesce(F.sum("cap").over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("level", F.col("left") / F.sum("weight").over(by.rowsBetween(0, W.unboundedFollowing)))
        .withColumn("clamped", F.col("cap") <= F.col("level") * F.col("weight"))
        .withColumn("final", F.min(F.when(~F.col("clamped"), F.struct(F.row_number().over(by), "level"))).over(W.partitionBy())["level"])
    )
    return shared.select("source", "source_size", "weight", F.when(F.col("clamped") | F.col("final").isNull(), F.col("cap")).otherwise(F.col("final") * F.col("weight")).alias("target"))


def _take_large(aims: DataFrame, sized: DataFrame, by_bucket: DataFrame) -> DataFrame:
    """`aims` with the large documents that the fractional repetition takes, and the part that is left for the others.

    In the order of their draws, each is taken if it still fits in the large documents' share of the fraction.
    """
    others = by_bucket.groupBy(F.col("source").alias("os")).agg(F.sum("words").alias("others"))
    listed = sized.where("large").groupBy(F.col("source").alias("ls")).agg(F.array_sort(F.collect_list(F.struct(F.col("_draw").alias("draw"), F.col("_row").alias("row"), F.col("_words").alias("size")))).alias("listed"))
    both = aims.join(others, F.col("source").eqNullSafe(F.col("os")), "left").join(listed, F.col("source").eqNullSafe(F.col("ls")), "left")
    share = F.col("rest") - F.coalesce("others", F.lit(0)) * F.when(F.col("source_size") > 0, F.col("rest") / F.col("source_size")).otherwise(0.0)
    none = F.struct(F.lit(0).cast("long").alias("words"), F.array().cast("array<long>").alias("rows"))
    taken = F.aggregate(
        F.coalesce("listed", F.array().cast("array<struct<draw:long,row:long,size:long>>")),
        none,
        lambda a, x: F.when(a["words"] + x["size"] <= share, F.struct((a["words"] + x["size"]).alias("words"), F.concat(a["rows"], F.array(x["row"])).alias("rows"))).otherwise(a),
    )
    got = both.withColumn("got", taken)
    return cut_lineage(got.select("source", "source_size", "target", "whole", (F.col("rest") - F.col("got.words")).alias("part"), F.col("got.rows").alias("taken_large")))


def _drawn(docs: DataFrame, seed: int) -> dict[str, Column]:
    """What decides about a row: its words, its draw and the range that the draw is in."""
    draw = F.xxhash64(F.lit(seed), "doc_id", "text")
    return {"_words": words(F.col("text")), "_draw": draw, "_bucket": F.shiftrightunsigned(draw, 64 - (BUCKETS.bit_length() - 1)).cast("int")}


def plan(docs: DataFrame, max_epochs: float = 3.0, weights: tuple[int, ...] = (1, 2, 3), seed: int = 7) -> DataFrame:
    """One row for each source of `docs`: its size, target, whole repetitions, and where its fractional one ends."""
    sized = cut_lineage(docs.select(F.col("source").alias("_source"), "_row", *[c.alias(k) for k, c in _drawn(docs, seed).items()]))
    aims = (
        targets(sized.groupBy(F.col("_source").alias("source")).agg(F.sum("_words").alias("source_size")), max_epochs, weights)
        .withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
        .withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    )
    aims = cut_lineage(aims)
    small = _small(aims)
    sized = sized.join(small(aims.select("source", F.col("source_size").alias("_all"))), F.col("_source").eqNullSafe(F.col("source"))).drop("_source")
    sized = sized.withColumn("large", F.col("_words") > F.col("_all") / LARGE)
    by_bucket = cut_lineage(sized.where("not large").groupBy("source", "_bucket").agg(F.sum("_words").alias("words")))
    aims = _take_large(aims, sized, by_bucket)
    passes = (
        by_bucket.withColumn("upto", F.sum("words").over(W.partitionBy("source").orderBy("_bucket")))
        .join(small(aims.select(F.col("source").alias("of"), "part")), F.col("source").eqNullSafe(F.col("of")))
        .where((F.col("upto") > F.col("part")) & (F.col("upto") - F.col("words") <= F.col("part")))
        .groupBy("of")
        .agg(F.min(F.struct("_bucket", (F.col("upto") - F.col("words")).alias("before"), "part")).alias("at"))
        .select(F.col("of"), F.col("at._bucket").alias("at"), "at.before", "at.part")
    )
    passes = cut_lineage(passes)
    near = sized.where("not large").join(small(passes), F.col("source").eqNullSafe(F.col("of")) & (F.col("_bucket") == F.col("at")))
    draws = near.groupBy("source", "_draw").agg(F.sum("_words").alias("words"), F.count("*").alias("n"), F.first("before").alias("before"), F.first("part").alias("part"))
    within = W.partitionBy("source").orderBy("_draw").rangeBetween(W.unboundedPreceding, 0)
    fits = F.when(F.col("n") == 1, F.col("upto") - F.col("words") / 2 <= F.col("part")).otherwise(F.col("upto") <= F.col("part"))
    first = F.min(F.when(~F.col("fits"), F.struct("_draw", "n", ((F.col("part") - F.col("upto") + F.col("words")) * F.col("n") / F.col("words")).alias("of"))))
    ends = (
        draws.withColumn("upto", F.sum("words").over(within) + F.col("before"))
        .withColumn("fits", fits)
        .groupBy("source")
        .agg(F.max(F.when(F.col("fits"), F.col("_draw"))).alias("last"), first.alias("next"))
        .select(F.col("source").alias("ended"), "last", F.when(F.col("next.n") > 1, F.col("next._draw")).alias("tie"), F.round(F.greatest(F.least(F.col("next.of"), F.col("next.n")), F.lit(0))).cast("long").alias("k"))
    )
    ends = cut_lineage(ends)
    cut = aims.join(passes.select("of", "at"), F.col("source").eqNullSafe(F.col("of")), "left").join(ends.select("ended", "last"), F.col("source").eqNullSafe(F.col("ended")), "left")
    cut = cut.join(_ties(near, ends, small), F.col("source").eqNullSafe(F.col("tied")), "left")
    return cut_lineage(cut.select("source", "source_size", "target", "whole", "part", "taken_large", "at", "last", "tie", "tie_row"))


def _ties(near: DataFrame, ends: DataFrame, small: Callable) -> DataFrame:
    """(tied, tie, tie_row): of the equal rows among which a source's fraction ends, those up to tie_row are taken, `k` of them.

    They are counted by the partition that holds them, and only those of the one partition where the count is reached are
    numbered, so that many equal rows never meet in one task.
    """
    asked = ends.where("tie is not null and k > 0").select("ended", "tie", "k")
    equal = near.join(small(asked), F.col("source").eqNullSafe(F.col("ended")) & (F.col("_draw") == F.col("tie"))).select("ended", "tie", "k", "_row", F.shiftright("_row", 33).alias("_in"))
    counts = equal.groupBy("ended", "_in").agg(F.count("*").alias("n"), F.first("k").alias("k"))
    upto = counts.withColumn("upto", F.sum("n").over(W.partitionBy("ended").orderBy("_in")))
    found = upto.where((F.col("upto") >= F.col("k")) & (F.col("upto") - F.col("n") < F.col("k"))).select(F.col("ended").alias("tied"), F.col("_in").alias("_at"), (F.col("k") - F.col("upto") + F.col("n")).alias("m"))
    inside = equal.join(small(found), F.col("ended").eqNullSafe(F.col("tied")) & (F.col("_in") == F.col("_at"))).withColumn("r", F.row_number().over(W.partitionBy("ended", "_in").orderBy("_row")))
    return inside.where("r = m").select("tied", "tie", F.col("_row").alias("tie_row"))


def _small(sources: DataFrame) -> Callable:
    """Broadcasting, if there are few enough sources."""
    return F.broadcast if sources.count() <= BROADCAST_SOURCES else (lambda x: x)


def with_times(docs: DataFrame, planned: DataFrame, seed: int = 7) -> DataFrame:
    """`docs` with _words, and what `planned` says: _source_size, _target, and how often to take the row, _times."""
    of = planned.select(*[F.col(c).alias(f"_{c}") for c in planned.columns])
    rows = docs.withColumns(_drawn(docs, seed)).join(_small(planned)(of), docs["source"].eqNullSafe(of["_source"]))
    at_end = (F.col("_bucket") == F.col("_at")) & F.coalesce(F.col("_draw") <= F.col("_last"), F.lit(False))
    in_tie = F.coalesce((F.col("_draw") == F.col("_tie")) & (F.col("_row") <= F.col("_tie_row")), F.lit(False))
    first = (F.col("_part") > 0) & (F.col("_at").isNull() | (F.col("_bucket") < F.col("_at")) | at_end | in_tie)
    more = F.when(F.col("_words") > F.col("_source_size") / LARGE, F.array_contains("_taken_large", F.col("_row"))).otherwise(first)
    rows = rows.withColumn("_times", (F.col("_whole") + F.when(more, 1).otherwise(0)).cast("int"))
    return rows.select(*[docs[c] for c in docs.columns], "_words", "_source_size", "_target", "_times")


def mix(docs: DataFrame, max_epochs: float = 3.0, weights: tuple[int, ...] = (1, 2, 3), seed: int = 7) -> DataFrame:
    """Every row of `docs` with how often the mix takes it: doc_id, source, size, source_size, target, times, taken.

    A source is repeated floor(target / size) times whole. The fraction that is left is a seeded sample: documents in
    the order of a hash of seed, doc_id and text, up to the one where the running sum of sizes comes nearest to the
    fraction. The place is found from totals of `BUCKETS` ranges of the hash for each source, then in the one range where
    the sum passes, so that no source is gathered in one task. Documents of over 1/`LARGE` of their source, `LARGE` at
    most, would make that sum coarse; they are drawn first, for their share of the fraction, and the others fill it up.

    Null text: size 0, taken 0. Null source: a source of its own, last. Null doc_id: an ordinary row. Of equal
    rows as many are taken as come nearest to the fraction. Sizes all 0: targets 0. Empty input: empty result. Further columns of `docs` are ignored.
    `docs` is read twice and must give the same rows in the same tasks, as a table does.
    """
    docs = docs.select("doc_id", "source", "text", F.monotonically_increasing_id().alias("_row"))
    rows = with_times(docs, plan(docs, max_epochs, weights, seed), seed)
    return rows.select(
        "doc_id", "source", F.col("_words").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"),
        F.col("_times").alias("times"), (F.col("_words") * F.col("_times")).alias("taken"),
    )


def mixed(docs: DataFrame, max_epochs: float = 3.0, weights: tuple[int, ...] = (1, 2, 3), seed: int = 7) -> DataFrame:
    """The mix itself: the rows of `docs`, all columns as they were, each as often as `mix` takes it."""
    docs, restored = shielded(docs, "doc_id", "source", "text")
    docs = docs.withColumn("_row", F.monotonically_increasing_id())
    rows = with_times(docs, plan(docs, max_epochs, weights, seed), seed).where("_times > 0")
    return restored(rows.select(*docs.columns, F.explode(F.sequence(F.lit(1), F.col("_times"))).alias("_turn")))
