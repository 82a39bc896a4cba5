"""Session helpers: local sessions for tests and benches, shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g", settings: dict[str, str] | None = None) -> SparkSession:
    """A local session with the settings that the tests and the bench use."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tessera")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config(map=settings or {})
        .getOrCreate()
    )


def fresh_folder(spark: SparkSession) -> str:
    """A new path in the folder that all executors share, spark.checkpoint.dir; a local session may do without that setting."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: executors need a folder that they share")
        root = tempfile.gettempdir()
    return f"{root.rstrip('/')}/tessera-tables-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """`df`, written once as a table in a fresh folder and read again, so that what follows computes it but once."""
    spark, path = df.sparkSession, fresh_folder(df.sparkSession)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
