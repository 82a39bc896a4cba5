"""Shared helpers of the training-data operators."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. A local session (tests, a laptop) may do without it."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is not set: executors need a folder that they share")
    return (folder or "/tmp/checkpoints").rstrip("/")


def cut_lineage(df: DataFrame, options: dict | None = None) -> DataFrame:
    """`df`, written once as a table in the shared folder, with the writer's `options`, and read again.

    A lost executor then costs no more than a read, and later plans know the table's true size: checkpoint() would carry
    estimates on, which are multiplied by each join and, in a loop, grow beyond all memory. What an application wrote goes
    when it ends.
    """
    spark = df.sparkSession
    root = f"{shared_folder(spark)}/tessera-{spark.sparkContext.applicationId}"
    if root not in _ROOTS:
        _ROOTS.add(root)
        atexit.register(_remove, spark, root)
    path = f"{root}/{uuid.uuid4().hex}"
    df.write.options(**(options or {})).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_ROOTS: set[str] = set()


def _remove(spark: SparkSession, root: str) -> None:
    context = spark.sparkContext
    if context._jsc is not None and not context._jsc.sc().isStopped():
        path = context._jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def shielded(docs: DataFrame, *needed: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """`docs` with all columns but `needed` renamed, so that none clashes with an operator's own, and what undoes it."""
    names = [c if c in needed else f"_kept_{k}" for k, c in enumerate(docs.columns)]
    return docs.toDF(*names), lambda df: df.select(*names).toDF(*docs.columns)


def text_key(text: Column | str) -> list[Column]:
    """Columns that tell texts apart (96 hash bits and the length); null counts as empty."""
    whole = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    return [
        F.xxhash64(whole).alias("key_hash"),
        F.crc32(whole).alias("key_crc"),
        F.octet_length(whole).cast("long").alias("key_bytes"),
    ]
