"""Queries over tables that the engine keeps: indexes, replaced documents, batches, intervals and boxes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.functions import text as T
from tessera.operators import batching, boxes, intervals, lexical_index, replace, vector_index
from tessera.plans import retrieval as R
from tessera.session import fresh_folder, table


def bm25_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 of every benchmark item from a kept index, to which the documents were added in two batches."""
    path, chunks = fresh_folder(spark), R._chunks(spark, sf_dir)
    fields = {"coarse": R.coarse(F.col("text")), "fine": T.lexical_terms(F.coalesce("text", F.lit("")))}
    tenth = F.pmod(F.xxhash64("chunk_id"), F.lit(10)) == 0
    lexical_index.append(path, chunks.where(~tenth), fields, "first")
    lexical_index.append(path, chunks.where(tenth), fields, "second")
    queries = R._asked(spark, sf_dir).select("query_id", R.coarse(F.col("text")).alias("terms"))
    return R._rounded(lexical_index.search(spark, path, queries, {"coarse": 2.0, "fine": 1.0}, R.TOP_K))


def dense_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine of every 20th vector over all vectors, from a kept index."""
    path, index = fresh_folder(spark), R._vectors(spark, sf_dir)
    vector_index.build(path, index)
    queries = index.where("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), "vector")
    return R._rounded(vector_index.search(spark, path, queries, R.TOP_K))


def replaced_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations as a kept table, after those of two partitions were replaced by a summary line each and a new one was added."""
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("long").alias("chunk_index"), F.coalesce("text", F.lit("")).alias("content"), (F.col("conv_id") % 16).alias("bucket_id"))
    path = fresh_folder(spark)
    replace.create(path, turns)
    fresh = turns.where("bucket_id IN (3, 5)").groupBy("doc_id", "bucket_id").agg(F.lit(0).cast("long").alias("chunk_index"), F.concat_ws(" ", F.lit("turns:"), F.count("*").cast("string")).alias("content"))
    replace.replace_documents(path, fresh)
    added = turns.agg((F.max("doc_id") + 1).alias("doc_id")).select("doc_id", F.lit(0).cast("long").alias("chunk_index"), F.lit("added").alias("content"), (F.col("doc_id") % 16).alias("bucket_id"))
    replace.replace_documents(path, added)
    return spark.read.parquet(path).select("doc_id", "chunk_index", F.sha2("content", 256).alias("content_sha256"))


def bulk_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy bulk batches of each conversation's turns: 3 at most, 600 bytes at most."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.octet_length(F.coalesce("text", F.lit(""))).alias("s"))
    return batching.batches(c, "conv_id", "turn", F.col("s"), 600, 3)


def corpus_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy bulk batches of each source's documents, in the order of doc_id: 50 at most, 64 KiB at most."""
    d = table(spark, sf_dir, "documents").select("source", "doc_id", F.octet_length(F.coalesce("text", F.lit(""))).alias("s"))
    return batching.batches(d, "source", "doc_id", F.col("s"), 1 << 16, 50)


def described_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of lines of every document, with the names of the nations whose numbers stand in lines of the run."""
    rows = intervals.lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    number = F.regexp_extract("content", "([0-9]+)", 1)
    images = rows.where(number != "").select("doc_id", "line", F.right(number, F.lit(2)).cast("long").cast("string").alias("url"))
    told = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("url"), F.col("n_name").alias("description"))
    found = intervals.described_blocks(images, intervals.blocks(rows), told)
    return found.select("doc_id", F.col("start").cast("long").alias("start"), F.col("stop").cast("long").alias("stop"), F.array_join("descriptions", ",").alias("descriptions"))


def merged_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of each order as boxes on its page, merged where they touch."""
    turn = F.row_number().over(W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity"))
    i = table(spark, sf_dir, "lineitem").withColumn("turn", turn)
    x, y = F.col("l_partkey") % 700, F.col("l_suppkey") * 13 % 900
    b = i.select(F.col("l_orderkey").alias("page"), F.col("turn").cast("long").alias("id"), x.alias("x0"), y.alias("y0"), (x + F.col("l_quantity").cast("long") * 4).alias("x1"), (y + 60).alias("y1"))
    return boxes.merged(b, 24).select("page", "x0", "y0", "x1", "y1", "parts")


QUERIES = {f.__name__: f for f in (bm25_stored, dense_stored, replaced_documents, bulk_batches, corpus_batches, described_blocks, merged_boxes)}

_GREEDY = """WITH RECURSIVE c AS (SELECT {by}, {order}, octet_length(encode(coalesce(text, ''))) AS s, row_number() OVER (PARTITION BY {by} ORDER BY {order}) AS k FROM {table}),
        r AS (SELECT {by}, {order}, k, CAST(0 AS BIGINT) AS batch, 1 AS n, s AS bytes FROM c WHERE k = 1
            UNION ALL SELECT r.{by}, c.{order}, c.k, CASE WHEN r.n >= {n} OR r.bytes + c.s > {most} THEN r.batch + 1 ELSE r.batch END, CASE WHEN r.n >= {n} OR r.bytes + c.s > {most} THEN 1 ELSE r.n + 1 END,
            CASE WHEN r.n >= {n} OR r.bytes + c.s > {most} THEN c.s ELSE r.bytes + c.s END FROM r JOIN c ON c.{by} = r.{by} AND c.k = r.k + 1)
        SELECT {by}, {order}, batch FROM r"""
ORACLES = {
    "bm25_stored": R.ORACLES["bm25_topk"],
    "replaced_documents": """WITH c AS (SELECT conv_id AS doc_id, turn, coalesce(text, '') AS content FROM conversations)
        SELECT doc_id, CAST(turn AS BIGINT) AS chunk_index, sha256(content) AS content_sha256 FROM c WHERE doc_id % 16 NOT IN (3, 5)
        UNION ALL SELECT doc_id, 0, sha256('turns: ' || count(*)) FROM c WHERE doc_id % 16 IN (3, 5) GROUP BY doc_id
        UNION ALL SELECT max(doc_id) + 1, 0, sha256('added') FROM c""",
    "bulk_batches": _GREEDY.format(by="conv_id", order="turn", table="conversations", n=3, most=600),
    "corpus_batches": _GREEDY.format(by="source", order="doc_id", table="documents", n=50, most=1 << 16),
    "described_blocks": r"""WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS content, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS line FROM documents),
        k AS (SELECT doc_id, line, line - row_number() OVER (PARTITION BY doc_id ORDER BY line) AS run FROM l WHERE regexp_matches(content, '[^\s\x0B\x85\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]')),
        b AS (SELECT doc_id, min(line) AS start, max(line) AS stop FROM k GROUP BY doc_id, run),
        i AS (SELECT doc_id, line, CAST(CAST(right(regexp_extract(content, '([0-9]+)', 1), 2) AS BIGINT) AS VARCHAR) AS url FROM l WHERE regexp_matches(content, '[0-9]')),
        m AS (SELECT b.doc_id, start, stop, n_name, min(line) AS first, min(url) AS url FROM b JOIN i ON i.doc_id = b.doc_id AND line BETWEEN start AND stop JOIN nation ON CAST(n_nationkey AS VARCHAR) = url GROUP BY ALL)
        SELECT doc_id, start, stop, string_agg(n_name, ',' ORDER BY first, url) AS descriptions FROM m GROUP BY doc_id, start, stop""",
}
