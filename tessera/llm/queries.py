"""The registered queries of the training-data operators and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.alignment import alignment
from tessera.llm.common import read
from tessera.llm.decontamination import leaks
from tessera.llm.fingerprints import fingerprints
from tessera.llm.licenses import licences
from tessera.llm.mixing import mix
from tessera.llm.neardup import near_duplicates
from tessera.llm.pii import KINDS, digest, personal_data
from tessera.llm.quality import quality
from tessera.llm.resampling import resampled
from tessera.llm.secrets import secrets
from tessera.llm.sharding import shard_by_bytes
from tessera.llm.tokens import decoded, encoded
from tessera.llm.urls import judge_urls

#: Fixed values of the URL query: (host, path, verdict).
URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The secrets in all documents."""
    return secrets(read(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds a benchmark item, with the item and how much of it."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return leaks(docs, read(spark, sf_dir, "benchmark")).select("doc_id", F.explode("hits").alias("hit")).select("doc_id", "hit.*")


def op3_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of near duplicates of all documents, five words and a similarity of 0.8."""
    return near_duplicates(read(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards of equal bytes."""
    return shard_by_bytes(read(spark, sf_dir, "documents"), 24)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perplexity and quality decision of all documents, under a model of all that labels call good."""
    return quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all documents and of their edited texts."""
    return fingerprints(read(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, mixed to source weights 1, 2, 3 with three epochs at most."""
    return mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op8_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's url."""
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return judge_urls(read(spark, sf_dir, "pages"), rules)


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every whole text of documents."""
    found = personal_data(read(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        *[F.size(F.filter(F.col("base.kind"), (lambda k: lambda x: x == k)(k))).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)],
        F.sha2(digest(F.col("base")), 256).alias("base_sha256"),
        digest(F.concat("base", "added")).alias("spans"),
        F.size("added").alias("n_added"),
    )


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The licence families of all documents, and their paragraphs."""
    docs = licences(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select(
        "doc_id",
        F.array_join(F.array_sort(F.array_distinct("licences.family")), ",").alias("families"),
        F.size("licences").alias("n_paragraphs"),
        F.array_max("licences.probability").alias("probability"),
        F.array_max("licences.overlap").alias("overlap"),
        F.array_join(F.transform("licences", lambda x: F.concat_ws(":", x["family"], x["start"].cast("string"), x["stop"].cast("string"))), ",").alias("spans"),
    )


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the tokens of two vocabularies lie on each other in all documents, and how widely each document's links are shared."""
    return alignment(read(spark, sf_dir, "documents"))


def op12_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in ids of the byte-level vocabulary, and back."""
    tokens = encoded(read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "token_ids")
    back = decoded(tokens)
    ids = F.array_join(F.col("token_ids").cast("array<string>"), ",")
    return back.select("doc_id", F.size("token_ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter of all documents, drawn by how much their words speak for the benchmark's."""
    return resampled(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secrets": op1_secrets,
    "op2_decontamination": op2_decontamination,
    "op3_neardup": op3_neardup,
    "op4_sharding": op4_sharding,
    "op5_quality": op5_quality,
    "op6_fingerprints": op6_fingerprints,
    "op7_mixing": op7_mixing,
    "op8_urls": op8_urls,
    "op9_pii": op9_pii,
    "op10_licenses": op10_licenses,
    "op11_alignment": op11_alignment,
    "op12_bpe": op12_bpe,
    "op13_resampling": op13_resampling,
}

ORACLES: dict[str, str | None] = {
    "op8_urls": r"""
        WITH rules(rh, rp, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'),
            ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
        parts AS (SELECT page_id,
            coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
            coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages)
        SELECT page_id, host, path,
            (SELECT rh || rp FROM rules WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)
             ORDER BY length(rh || rp) DESC LIMIT 1) AS rule,
            coalesce((SELECT v FROM rules WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)
             ORDER BY length(rh || rp) DESC LIMIT 1), 'allow') AS verdict
        FROM parts""",
}
