"""A kept dense index: vectors in lists by their nearest centroid, of which a query reads the nearest few."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.retrieval import BLOCK, Best, check_request, dense, hit_type, id_array, in_scope, merged_top, strips, unit

#: Rows that centroids are fitted to, lists at most, rounds of fitting.
SAMPLE, LISTS, ROUNDS = 16_384, 1024, 8
#: The recall that the number of probed lists is set for, of how many neighbours, by how many of the sample's rows as queries.
RECALL, NEIGHBOURS, TRIALS = 0.98, 20, 512
#: If a filter leaves at most so many rows, all of them are compared.
FEW = 10_000


def centroids(index: DataFrame, lists: int | None = None, sample: int = SAMPLE, seed: int = 7) -> tuple[np.ndarray, int]:
    """Directions about which the vectors lie, by spherical k-means on `sample` rows, and how many of their lists to probe.

    The sample is the rows with the lowest hash of seed and chunk_id; it bounds what comes to the driver, and every row is
    in the index. The number of lists is the square root of the rows, LISTS at most, unless it is given. Of TRIALS rows of
    the sample the nearest NEIGHBOURS others in it are found, and in which of the row's nearest lists they lie: as many
    lists are probed as hold RECALL of them. Vectors without clusters need many.
    """
    rows = index.select("vector").orderBy(F.xxhash64(F.lit(seed), "chunk_id")).limit(sample).collect()
    if not rows:
        return np.zeros((0, 0)), 0
    v = unit(np.array([r.vector for r in rows], np.float64))
    k = min(lists or max(1, min(LISTS, round(index.count() ** 0.5))), len(v))
    c = v[np.random.default_rng(seed).choice(len(v), k, replace=False)]
    for _ in range(ROUNDS):
        near = (v @ c.T).argmax(1)
        sums = np.zeros_like(c)
        np.add.at(sums, near, v)
        c = np.where(np.linalg.norm(sums, axis=1, keepdims=True) > 1e-10, unit(sums), c)
    tried, near = v[:TRIALS], (v @ c.T).argmax(1)
    likeness = tried @ v.T
    np.fill_diagonal(likeness, -2.0)
    others = np.argsort(-likeness, axis=1)[:, : max(1, min(NEIGHBOURS, len(v) - 1))]
    order = np.argsort(np.argsort(-(tried @ c.T), axis=1, kind="stable"), axis=1)
    ranks = np.take_along_axis(order, near[others], axis=1)
    return c, int(np.quantile(ranks, RECALL, method="higher")) + 1


def build(path: str, index: DataFrame, lists: int | None = None) -> None:
    """Write the index (chunk_id, doc_id, dataset_id, vector) as tables: vectors by list, centroids, and an empty one of its columns."""
    spark, (c, probes) = index.sparkSession, centroids(index, lists)
    spark.createDataFrame([(k, [float(x) for x in v], probes) for k, v in enumerate(c)], "list int, centroid array<double>, probes int").coalesce(1).write.mode("overwrite").parquet(f"{path}/centroids")
    shared = spark.sparkContext.broadcast(c)
    rows = index.select("chunk_id", "doc_id", "dataset_id", "vector").where(F.col("vector").isNotNull())
    names = [*rows.columns, "list"]
    rows.limit(0).coalesce(1).write.mode("overwrite").parquet(f"{path}/columns")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, v in strips(batches, 3):
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array((v @ shared.value.T).argmax(1), pa.int32())], names)

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    dealt = rows.mapInArrow(run, f"{kinds}, list int").repartition("list", F.pmod(F.xxhash64("chunk_id"), F.lit(8)))  # a common direction in several files
    dealt.write.mode("overwrite").partitionBy("list").parquet(f"{path}/vectors")


def search(
    spark: SparkSession, path: str, queries: DataFrame, top_k: int = 20, threshold: float = 0.0, by: tuple[str, ...] = ("dataset_id",), probes: int | None = None,
    dataset_ids: list[int] | None = None, doc_ids: list[int] | None = None, few: int = FEW,
) -> DataFrame:
    """Best `top_k` by cosine of queries (query_id, vector) among the vectors of their `probes` nearest lists (the index's, if not given).

    Only the lists that some query asks for are read. Where a scope is given and leaves at most `few` rows, all of those
    are compared instead. Query vectors are broadcast in blocks, each with the lists it probes. With as many probes as
    there are lists the result is that of retrieval.dense. Empty index: no hits.
    """
    check_request(top_k, threshold, 1.0)
    columns = spark.read.parquet(f"{path}/columns").withColumn("list", F.lit(0)).schema
    stored = spark.read.schema(columns).parquet(f"{path}/vectors")
    visible = in_scope(stored, None, dataset_ids, doc_ids)
    if (dataset_ids is not None or doc_ids) and visible.limit(few + 1).count() <= few:
        return dense(queries, visible, top_k, threshold, by)
    listed = spark.read.parquet(f"{path}/centroids").orderBy("list").collect()  # LISTS at most
    c, probes = np.array([r.centroid for r in listed]), probes or (listed[0].probes if listed else 1)
    total, best = queries.count(), None
    blocks = max(1, -(-total // BLOCK))
    schema = hit_type(queries, stored)
    for b in range(blocks):
        rows = (queries if blocks == 1 else queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)).select("query_id", "vector").collect()  # a block
        if not rows or not len(c):
            continue
        q = unit(np.array([r.vector for r in rows], np.float64))
        near = np.argsort(-(q @ c.T), axis=1, kind="stable")[:, :probes]
        asked = {int(k): np.flatnonzero((near == k).any(1)) for k in np.unique(near)}
        shared = spark.sparkContext.broadcast((id_array([r.query_id for r in rows], schema["query_id"].dataType), q, asked))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            ids, q, asked = shared.value
            best = Best(ids, top_k)
            for part, v in strips(batches, 3):
                lists = part.column(4).to_numpy()
                for k in np.unique(lists):
                    at, mine = np.flatnonzero(lists == k), asked[int(k)]
                    scores = np.clip(v[at] @ q[mine].T, -1.0, 1.0)
                    best.add([c.take(pa.array(at)) for c in part.columns[:3]], scores, scores >= threshold, mine)
            yield from best.rows()

        found = visible.where(F.col("list").isin(sorted(asked))).select("chunk_id", "doc_id", "dataset_id", "vector", "list").mapInArrow(run, schema)
        best = found if best is None else best.unionByName(found)
    if best is None:
        return dense(queries, stored, top_k, threshold, by)
    return merged_top(best, top_k, by)
