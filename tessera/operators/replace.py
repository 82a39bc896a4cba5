"""Replacing documents in a stored table, by copying only the partitions that they touch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.retrieval import small_side
from tessera.session import written


def create(path: str, rows: DataFrame, by: str = "bucket_id") -> None:
    """Write `rows` as a table partitioned by `by`."""
    rows.repartition(by, F.pmod(F.xxhash64(*rows.columns), F.lit(8))).write.partitionBy(by).parquet(path)


def replace_documents(path: str, fresh: DataFrame, by: str = "bucket_id", doc: str = "doc_id") -> None:
    """Replace all rows of the documents that `fresh` holds, in the table at `path` partitioned by `by`.

    Only partitions that `fresh` touches are read and written; files of all others stay as they are. A document's partition
    is fixed, as a tenant's bucket is. The new partitions are written aside first, then put in the place of the old ones,
    each at once. If that breaks off, doing the whole again gives the same table, as it replaces by document. Documents
    not held before are added. Repeated rows of `fresh` stay repeated; null documents and partitions are ordinary ones.
    """
    spark = fresh.sparkSession
    old = spark.read.parquet(path)
    fresh = written(fresh.select(*old.columns))
    touched = [r[0] for r in fresh.select(by).distinct().collect()]  # as many as there are buckets, at most
    if not touched:
        return
    inside = F.lit(False)
    for x in touched:
        inside = inside | F.col(by).eqNullSafe(F.lit(x))
    gone = fresh.select(F.col(doc).alias("_gone")).distinct()
    kept = old.where(inside).join(small_side(gone), F.col(doc).eqNullSafe(F.col("_gone")), "left_anti")
    aside = written(kept.unionByName(fresh))
    dealt = aside.repartition(by, F.pmod(F.xxhash64(*aside.columns), F.lit(8)))
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)
