"""Queries from web pages to chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import chunking, html, markdown
from tessera.session import table, written


def html_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as Markdown."""
    return html.pages_to_markdown(table(spark, sf_dir, "pages"))


def _elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written once, as chunks look at blocks several times and pages are costly to read."""
    return written(markdown.scan(html_markdown(spark, sf_dir).where("error is null"), "page_id", "markdown"))


def markdown_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The blocks of every page's Markdown."""
    return _elements(spark, sf_dir)


def document_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of every document by type."""
    return markdown.scan(table(spark, sf_dir, "documents")).groupBy("type").agg(F.count("*").alias("blocks"), F.countDistinct("doc_id").alias("documents"))


def page_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heading-aware chunks of every page, with neighbour context."""
    return chunking.with_neighbours(written(chunking.mixed_chunks(chunking.assign(_elements(spark, sf_dir), "page_id"), "page_id")), "page_id")


def chunk_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of every page that no chunk holds (none), and how many chunks and blocks there are."""
    found = _elements(spark, sf_dir)
    chunks = chunking.mixed_chunks(chunking.assign(found, "page_id"), "page_id")
    lost = chunking.uncovered(found, chunks, "page_id").agg(F.count("*").alias("uncovered"))
    held = chunks.agg(F.count("*").alias("chunks"), F.sum(F.size("source_element_indexes")).alias("blocks"))
    return lost.crossJoin(held)  # one row each


def rebuilt_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's Markdown put together from its blocks again."""
    pages = html_markdown(spark, sf_dir).where("error is null")
    return pages.join(markdown.rebuilt(markdown.scan(pages, "page_id", "markdown"), "page_id").withColumnRenamed("markdown", "again"), "page_id").select("page_id", F.length("markdown").alias("chars"), F.length("again").alias("again_chars"), F.sha2("again", 256).alias("again_sha256"))


QUERIES = {f.__name__: f for f in (html_markdown, markdown_elements, document_elements, page_chunks, chunk_coverage, rebuilt_markdown)}
#: Pages are parsed by small functions, which SQL can't express: the tests hold these queries against plain Python.
ORACLES: dict[str, str] = {}
