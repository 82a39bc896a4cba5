"""A kept BM25 index: postings in a table by term bucket, statistics in small tables that appends add to."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.retrieval import K1, check_request, in_scope, matched, okapi, portions, small_side
from tessera.session import written

#: Buckets of terms, and the bucket of the rows that tell a part's chunks.
BUCKETS, CHUNKS = 64, -1
#: Terms of a part, over all fields.
PART = 1 << 21
POSTINGS = "field string, term string, part long, at array<int>, tf array<int>, dataset_id array<long>, doc_id array<long>, chunk_id array<string>"


def bucket(term: Column) -> Column:
    """The bucket of a term."""
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def _inverted(names: list[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From chunks (a list of terms for each of `names`, dataset_id, doc_id, chunk_id) to rows of POSTINGS, a part at a time."""
    columns = [c.split()[0] for c in POSTINGS.split(", ")]
    ints, longs = pa.list_(pa.int32()), pa.list_(pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId() << 32
        for batch in batches:
            for rows in portions(batch, len(names), PART):
                size = rows.num_rows
                ids = [pa.ListArray.from_arrays(pa.array([0, size], pa.int32()), c) for c in rows.columns[len(names) :]]
                for name, lists in zip(names, rows.columns, strict=False):
                    lengths = pc.fill_null(pc.list_value_length(lists), 0).cast(pa.int32())
                    told = [pa.array([name]), pa.array([None], pa.string()), pa.array([part]), pa.array([None], ints), pa.ListArray.from_arrays(pa.array([0, size], pa.int32()), lengths), *ids]
                    yield pa.RecordBatch.from_arrays(told, columns)
                    of, terms = pc.list_parent_indices(lists), lists.flatten()
                    if terms.null_count:
                        of, terms = of.filter(terms.is_valid()), terms.drop_null()
                    coded = terms.dictionary_encode()  # numbered as they come, so that every number has postings
                    pairs = coded.indices.to_numpy().astype(np.int64)
                    pairs *= size
                    pairs += of.to_numpy()
                    pairs.sort()
                    first = np.flatnonzero(np.r_[True, pairs[1:] != pairs[:-1]][: len(pairs)])
                    n, pairs = np.diff(np.r_[first, len(pairs)]), pairs[first]
                    ends = pa.array(np.searchsorted(pairs, np.arange(len(coded.dictionary) + 1) * size), pa.int32())
                    at = pairs % size
                    lists = [pa.ListArray.from_arrays(ends, pa.array(v, pa.int32())) for v in (at, n)]
                    k = len(coded.dictionary)
                    yield pa.RecordBatch.from_arrays([pa.repeat(name, k), coded.dictionary, pa.repeat(part, k), *lists, pa.nulls(k, longs), pa.nulls(k, longs), pa.nulls(k, pa.list_(pa.string()))], columns)
                part += 1

    return run


def append(path: str, chunks: DataFrame, fields: dict[str, Column], batch: str) -> None:
    """Add `chunks` (dataset_id, doc_id, chunk_id and what `fields` name) to the index at `path` as one batch.

    Two tables: postings, by batch and bucket, and batches, which has a row for each field of a whole batch and is written
    last. So a batch counts once it is whole; repeating an append that broke off replaces what it left. A chunk belongs in
    one batch. A text is dealt out and made into terms once; they are counted in Arrow batches, a part of PART terms or of
    one text at a time, and a row of postings is a term's chunks in a part (`at`, their places) with its occurrences (`tf`).
    What a part's chunks are, and their lengths (as `tf`), is a row without a term for each field, in the bucket CHUNKS.
    """
    spark, kept = chunks.sparkSession, f"{path}/postings/batch={batch}"
    ids = [F.col("dataset_id").cast("long"), F.col("doc_id").cast("long"), F.col("chunk_id").cast("string")]
    dealt = chunks.withColumn("_row", F.monotonically_increasing_id()).repartition("_row")
    terms = dealt.select(*[t.alias(f"_{k}") for k, t in enumerate(fields.values())], *ids)
    listed = terms.mapInArrow(_inverted(list(fields)), POSTINGS).withColumn("bucket", F.when(F.col("term").isNull(), CHUNKS).otherwise(bucket(F.col("term"))))
    listed.write.mode("overwrite").partitionBy("bucket").parquet(kept)
    told = spark.read.schema(f"{POSTINGS}, bucket int").parquet(kept).where(F.col("bucket") == CHUNKS).select("field", F.explode("tf").alias("len"))
    whole = told.where("len > 0").groupBy("field").agg(F.count("*").alias("n"), F.sum("len").alias("total"))
    whole.coalesce(1).write.mode("overwrite").parquet(f"{path}/batches/batch={batch}")


def _read(spark: SparkSession, path: str, name: str, batches: list[str], buckets: list[int]) -> DataFrame:
    schema = {"postings": POSTINGS}[name]
    return spark.read.schema(f"{schema}, batch string, bucket int").parquet(f"{path}/{name}").where(F.col("batch").isin(batches) & F.col("bucket").isin(buckets))


def _by_chunk(found: pa.Table, told: pa.Table) -> pa.Table:
    """The postings of one part's terms (f, t, at, tf) as rows of its chunks (f, tf for the lengths, and ids): ids and p, see retrieval.matched."""
    lengths = {f: v.values.to_numpy() for f, v in zip(told["f"].to_pylist(), told["tf"], strict=True)}
    f, t = (found[c].to_numpy() for c in ("f", "t"))
    at, tf = (found[c].combine_chunks() for c in ("at", "tf"))
    times, at, tf = pc.list_value_length(at).to_numpy(), at.flatten().to_numpy(), tf.flatten().to_numpy()
    order = np.argsort(at, kind="stable")
    f, t, at, tf = np.repeat(f, times)[order], np.repeat(t, times)[order], at[order], tf[order]
    length = np.zeros(len(at), np.int32)
    for k, v in lengths.items():
        length[f == k] = v[at[f == k]]
    start = np.flatnonzero(np.r_[True, at[1:] != at[:-1]][: len(at)])
    parts = pa.StructArray.from_arrays([pa.array(f, pa.int32()), pa.array(t), pa.array(tf, pa.float64()), pa.array(length)], ["f", "t", "v", "len"])
    p = pa.ListArray.from_arrays(pa.array(np.r_[start, len(at)], pa.int32()), parts)
    ids = [told[c][0].values.take(pa.array(at[start])) for c in ("chunk_id", "doc_id", "dataset_id")]
    return pa.table([*ids, p], ["chunk_id", "doc_id", "dataset_id", "p"])


def search(
    spark: SparkSession, path: str, queries: DataFrame, boosts: dict[str, float], top_k: int = 20, by: tuple[str, ...] = ("dataset_id",),
    dataset_ids: list[int] | None = None, doc_ids: list[int] | None = None,
) -> DataFrame:
    """Best `top_k` chunks of each query (query_id, terms), as retrieval.bm25 finds them over all chunks of the index.

    Only the asked terms' buckets are read, and no text. Statistics are those of the whole index, whatever the scope. The
    asked postings are found once; those of a part are brought together as they are kept, an array for each term, and
    written as a row for each chunk, from which frequencies and scores come, see retrieval.matched: what is shuffled
    follows the postings, not chunks times queries. Empty index or no known term: no hits.
    """
    check_request(top_k)
    names = list(boosts)
    asked = queries.select("query_id", F.explode("terms").alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))
    asked = written(asked.withColumn("bucket", bucket(F.col("term"))))
    sizes = spark.read.schema("field string, n long, total long, batch string").parquet(f"{path}/batches")
    batches = [r[0] for r in sizes.select("batch").distinct().collect()]  # one for each append
    buckets = [r.bucket for r in asked.select("bucket").distinct().collect()]  # BUCKETS at most
    number = F.create_map(*[x for k, n in enumerate(names) for x in (F.lit(n), F.lit(k))])
    stats = written(sizes.groupBy("field").agg(F.sum("n").alias("n"), (F.sum("total") / F.sum("n")).alias("mean")).withColumn("f", number[F.col("field")]).where("f is not null"))  # a row a field
    known = written(asked.select("term").distinct().withColumn("t", F.monotonically_increasing_id()))
    found, told = (_read(spark, path, "postings", batches, b).withColumn("f", number[F.col("field")]).where("f is not null") for b in (buckets, [CHUNKS]))
    found = found.join(small_side(known), "term").select("batch", "part", "f", "t", "at", "tf")
    told = told.select("batch", "part", "f", "tf", "dataset_id", "doc_id", "chunk_id")
    p = "p array<struct<f: int, t: long, v: double, len: int>>"
    listed = written(found.groupBy("batch", "part").cogroup(told.groupBy("batch", "part")).applyInArrow(_by_chunk, f"chunk_id string, doc_id long, dataset_id long, {p}"))
    frequency = listed.select(F.explode("p").alias("p")).groupBy("p.f", "p.t").agg(F.count("*").alias("df"))
    weights = asked.join(known, "term").join(frequency, "t").join(F.broadcast(stats), "f")  # one row a field
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weights = weights.select("query_id", "f", "t", (idf * F.col("times") * (K1 + 1)).alias("w"))
    return matched(in_scope(listed, None, dataset_ids, doc_ids), weights, [float(boosts[n]) for n in names], okapi(stats, len(names)), top_k, None, by)
