"""Queries over checks of chunks, lookups, orders without a reranker, and lists in pages."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tessera.functions import text as T
from tessera.operators import batching, chunks, evaluate, overlap, page_tables, rerank, validator
from tessera.plans import retrieval as R
from tessera.plans import tables
from tessera.session import table

#: Turns of a conversation in a chunk.
TURNS = 3


def chunk_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults of chunks of three turns each, of which some were made wrong: a view moved, a range turned, a source missing."""
    c = table(spark, sf_dir, "conversations").select("conv_id", F.row_number().over(W.partitionBy("conv_id").orderBy("turn")).alias("k"), F.coalesce("text", F.lit("")).alias("content"))
    elements = c.select(F.col("conv_id").alias("doc_id"), (F.col("k") - 1).alias("element_index"), "content").withColumn("chunk_id", F.floor(F.col("element_index") / TURNS).cast("string"))
    inner = W.partitionBy("doc_id", "chunk_id").orderBy("element_index").rowsBetween(W.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("content") + len(validator.GAP)).over(inner), F.lit(0))
    wrong = F.when((F.col("doc_id") % 7 == 3) & (F.col("element_index") == 1), 1).otherwise(0)
    views = elements.withColumn("start", start + wrong).select("doc_id", "chunk_id", "element_index", "start", (F.col("start") + F.length("content")).alias("stop"))
    views = views.where("NOT (doc_id % 7 = 4 AND element_index = 0)")
    listed = F.array_sort(F.collect_list(F.struct("element_index", "content")))  # TURNS at most
    mixed = elements.groupBy("doc_id", "chunk_id").agg(F.array_join(F.transform(listed, lambda x: x["content"]), validator.GAP).alias("content"))
    none = [F.lit(None).cast("string").alias("source_id"), F.lit(None).cast("long").alias("element_index")]
    derived = elements.where("element_index % 3 = 2").select("doc_id", F.concat(F.lit("d"), F.col("element_index").cast("string")).alias("chunk_id"), F.lit("derived").alias("kind"), F.concat(F.lit("about "), "content").alias("content"), F.when(F.col("doc_id") % 7 == 5, "none").otherwise(F.col("chunk_id")).alias("source_id"), F.col("element_index").cast("long"))
    made = mixed.select("doc_id", "chunk_id", F.lit("mixed").alias("kind"), "content", *none).unionByName(derived)
    ranges = elements.where("element_index % 3 = 2").select("doc_id", "chunk_id", "element_index", F.lit("table").alias("kind"), F.when(F.col("doc_id") % 7 == 6, 9).otherwise(2).alias("start_line"), F.lit(4).alias("end_line"))
    return validator.faults(elements.select("doc_id", "element_index", "content"), made, views, ranges).groupBy("doc_id", "fault").agg(F.count("*").alias("chunks"))


def carried_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The turns of every conversation, each with the end of what was made of the turn before."""
    c = table(spark, sf_dir, "conversations")
    return overlap.carried(c, 16, 64, "conv_id", "turn").select("conv_id", "turn", F.length("content").alias("chars"), F.sha2("content", 256).alias("content_sha256"))


def chunk_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second turns' chunks, looked up by id, in the order they are asked for; one id in each is unknown."""
    t = tables._settled(spark, sf_dir)
    ids = t.where("chunk_index = 1").select(F.col("doc_id").alias("position"), "chunk_id")
    return chunks.by_ids(t, ids.unionByName(ids.select((-F.col("position") - 1).alias("position"), F.lit("unknown").alias("chunk_id")))).select("position", "chunk_id", "content_hash")


def chunk_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents of a user's active chunks among those of even turns."""
    t = tables._settled(spark, sf_dir)
    return chunks.contents(t, t.where("chunk_index % 2 = 0").select("chunk_id"), 7).select("chunk_id", F.sha2("content", 256).alias("content_sha256"))


def degraded_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first eight dense hits of each query as they are served when the reranker fails, one JSON each, and the prompt's length."""
    hits = R._dense(spark, sf_dir).select("query_id", "chunk_id", "doc_id", F.col("source_rank").cast("long").alias("rrf_rank"))
    kept = rerank.rrf_order(hits, 8)
    whole = rerank.serialised(kept, ["chunk_id", "doc_id", "rrf_rank"])
    return whole.select("query_id", "json", F.length(rerank.prompt(F.col("json"), F.col("query_id").cast("string"))).cast("long").alias("prompt_chars"))


def median_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each customer's orders, as timed rounds, the one nearest to the median price."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("name"), F.col("o_orderkey").alias("round"), F.col("o_totalprice").cast("double").alias("ms"))
    return evaluate.median_round(o).select("name", "round", F.round("ms", 4).alias("ms"), F.round("median", 4).alias("median"))


def failure_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as failed writes, their ids listed by reason in pages of 500."""
    o = table(spark, sf_dir, "orders")
    text = T.reason(F.col("o_orderstatus"), F.col("o_orderpriority"), F.when(F.col("o_custkey") % 2 == 0, " ").otherwise(F.repeat("o_orderpriority", F.lit(60))))
    return batching.pages(o.select(text.alias("reason"), F.col("o_orderkey").alias("id")), "reason", "id", 500).select(
        F.sha2("reason", 256).alias("reason_sha256"), "page", F.size("ids").cast("long").alias("n"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256")
    )


def joined_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's lines as pipe tables under a header of their flag, with blanks and texts between some; those that belong together joined."""
    i = table(spark, sf_dir, "lineitem")
    cut = F.when(F.col("l_partkey") % 3 == 0, F.array(F.lit(""), F.lit(" "))).when(F.col("l_partkey") % 3 == 1, F.array(F.lit("text"))).otherwise(F.array().cast("array<string>"))
    own = F.array(F.concat(F.lit("| "), "l_returnflag", F.when(F.col("l_suppkey") % 2 == 0, " ").otherwise("<br>"), F.lit("| part |")), F.lit("|:--- | ---:|"), F.concat(F.lit(" | x | "), F.col("l_partkey").cast("string"), F.lit(" | ")))
    turns = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")
    sized = i.withColumn("above", F.coalesce(F.sum(F.size(F.concat(own, cut))).over(turns.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    lines = sized.select("l_orderkey", "above", F.posexplode(F.concat(own, cut)).alias("p", "content"))
    lines = lines.select("l_orderkey", (F.col("above") + F.col("p") + 1).cast("int").alias("line"), "content")
    kept = page_tables.merged(lines, "l_orderkey")
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "content"))), lambda x: x["content"]), "\n")  # an order's
    return kept.groupBy("l_orderkey").agg(F.count("*").alias("lines"), F.sha2(whole, 256).alias("text_sha256"))


QUERIES = {f.__name__: f for f in (joined_tables, chunk_faults, carried_overlap, chunk_lookup, chunk_contents, degraded_order, median_rounds, failure_pages)}

_SPACE = r"[\s\x{0b}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: Of the users that the chunk table has, their buckets, from zlib: DuckDB knows no crc32.
_BUCKETS = ", ".join(f"({u}, {zlib.crc32(str(u).encode()) % 128})" for u in range(100))
ORACLES = {
    "chunk_faults": """WITH e AS (SELECT conv_id AS doc_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, coalesce(text, '') AS content FROM conversations),
        c AS (SELECT doc_id, i // 3 AS chunk, count(*) AS n, string_agg(content, chr(10) || chr(10) ORDER BY i) AS whole FROM e GROUP BY ALL),
        v AS (SELECT e.*, i // 3 AS chunk, CAST(coalesce(sum(length(content) + 2) OVER (PARTITION BY doc_id, i // 3 ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) + CASE WHEN doc_id % 7 = 3 AND i = 1 THEN 1 ELSE 0 END AS start FROM e),
        k AS (SELECT v.*, start + length(content) AS stop FROM v WHERE NOT (doc_id % 7 = 4 AND i = 0)),
        s AS (SELECT k.*, whole, lag(stop) OVER (PARTITION BY k.doc_id, k.chunk ORDER BY start, i) AS before, lag(i) OVER (PARTITION BY k.doc_id, k.chunk ORDER BY start, i) AS earlier FROM k JOIN c ON c.doc_id = k.doc_id AND c.chunk = k.chunk),
        f AS (SELECT doc_id, CAST(chunk AS VARCHAR) AS id, 'view beyond the content' AS fault FROM s WHERE stop > length(whole)
            UNION SELECT doc_id, CAST(chunk AS VARCHAR), 'view isn''t its block' FROM s WHERE stop <= length(whole) AND substr(whole, start + 1, stop - start) <> content
            UNION SELECT doc_id, CAST(chunk AS VARCHAR), 'views out of place' FROM s WHERE coalesce(start <> before + 2, start <> 0)
            UNION SELECT doc_id, CAST(chunk AS VARCHAR), 'views out of order' FROM s WHERE i <= earlier
            UNION SELECT doc_id, NULL, 'block in no chunk' FROM e WHERE doc_id % 7 = 4 AND i = 0
            UNION SELECT doc_id, CAST(chunk AS VARCHAR), 'no views' FROM c WHERE doc_id % 7 = 4 AND chunk = 0 AND n = 1
            UNION SELECT doc_id, CAST(chunk AS VARCHAR), 'blank content' FROM c WHERE trim(whole) = ''
            UNION SELECT doc_id, 'd' || i, 'derived without source' FROM e WHERE doc_id % 7 = 5 AND i % 3 = 2
            UNION SELECT doc_id, CAST(i // 3 AS VARCHAR), 'range lines' FROM e WHERE doc_id % 7 = 6 AND i % 3 = 2)
        SELECT doc_id, fault, count(*) AS chunks FROM f GROUP BY ALL""",
    "joined_tables": r"""WITH l AS (SELECT l_orderkey AS k, turn * 10 + unnest([0, 1, 2, 3, 4]) AS pos,
            unnest(['| ' || l_returnflag || CASE WHEN l_suppkey % 2 = 0 THEN ' ' ELSE '<br>' END || '| part |', '|:--- | ---:|', ' | x | ' || l_partkey || ' | ',
            CASE l_partkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'text' END, CASE l_partkey % 3 WHEN 0 THEN ' ' END]) AS c
            FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag) AS turn FROM lineitem)),
        n AS (SELECT k, row_number() OVER (PARTITION BY k ORDER BY pos) AS line, c, starts_with(trim(c), '|') AS is_row, trim(c) <> '' AS is_full FROM l WHERE c IS NOT NULL),
        a AS (SELECT *, is_row AND NOT coalesce(lag(is_row) OVER o, false) AS begins, max(CASE WHEN is_full THEN line END) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS above,
            min(CASE WHEN is_full THEN line END) OVER (o ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS below FROM n WINDOW o AS (PARTITION BY k ORDER BY line)),
        b AS (SELECT *, sum(CASE WHEN begins THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY line) AS run FROM a),
        t AS (SELECT k, run, min(line) AS first, max(line) AS last, count(*) AS n, replace(replace(arg_min(c, line), '<br>', ''), ' ', '') AS head, arg_min(above, line) AS above FROM b WHERE is_row GROUP BY k, run),
        j AS (SELECT k, first FROM t QUALIFY lag(last) OVER (PARTITION BY k ORDER BY first) = above AND lag(head) OVER (PARTITION BY k ORDER BY first) = head),
        m AS (SELECT b.*, j.first FROM b LEFT JOIN t ON is_row AND t.k = b.k AND t.run = b.run LEFT JOIN j ON j.k = b.k AND j.first = CASE WHEN is_row THEN t.first WHEN NOT is_full THEN below END)
        SELECT k AS l_orderkey, count(*) AS lines, sha256(string_agg(c, chr(10) ORDER BY line)) AS text_sha256 FROM m WHERE first IS NULL OR (is_full AND line >= first + 2) GROUP BY k""",
    "chunk_lookup": f"WITH {tables._CH} SELECT doc_id AS position, chunk_id, content_hash FROM t WHERE chunk_index = 1",
    "chunk_contents": f"WITH {tables._CH} SELECT chunk_id, content_hash AS content_sha256 FROM t WHERE act AND user_id = 7 AND chunk_index % 2 = 0 AND trim(content) <> ''",
    "degraded_order": f"""WITH {R._VECTORS}, {R._dense_sql(R._EVERY)}, j AS (SELECT query_id, '{{"chunk_id":"' || chunk_id || '","doc_id":' || doc_id || ',"rrf_rank":' || source_rank || '}}' AS json FROM dense WHERE source_rank <= 8)
        SELECT query_id, json, length(json) + 2 + length(CAST(query_id AS VARCHAR)) AS prompt_chars FROM j""",
    "median_rounds": """WITH o AS (SELECT o_custkey AS name, o_orderkey AS round, CAST(o_totalprice AS DOUBLE) AS ms FROM orders), m AS (SELECT name, quantile_cont(ms, 0.5) AS median FROM o GROUP BY name)
        SELECT name, round, round(ms, 4) AS ms, round(median, 4) AS median FROM o JOIN m USING (name) QUALIFY row_number() OVER (PARTITION BY name ORDER BY round(abs(ms - median), 6), round) = 1""",
    "failure_pages": """WITH o AS (SELECT substr(o_orderstatus || '；' || o_orderpriority || CASE WHEN o_custkey % 2 = 0 THEN '' ELSE '；' || repeat(o_orderpriority, 60) END, 1, 512) AS reason, o_orderkey AS id FROM orders),
        p AS (SELECT reason, id, (row_number() OVER (PARTITION BY reason ORDER BY id) - 1) // 500 AS page FROM o)
        SELECT sha256(reason) AS reason_sha256, page, count(*) AS n, sha256(string_agg(CAST(id AS VARCHAR), ',' ORDER BY id)) AS ids_sha256 FROM p GROUP BY reason, page""",
    "chunk_delete": f"""WITH {tables._CH}, b(user_id, bucket_id) AS (VALUES {_BUCKETS}) SELECT bucket_id, count(*) AS chunks FROM t JOIN b USING (user_id) WHERE act AND chunk_index = 0 GROUP BY bucket_id""",
    "kgram_coverage": f"""WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '{_SPACE}+', '', 'g') AS a, regexp_replace(substr(coalesce(text, ''), 1, length(text) // 2), '{_SPACE}+', '', 'g') AS b FROM documents),
        g AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(length(a) - 11, 1) + 1), lambda i: substr(a, i, 12))) AS gram FROM d WHERE a <> ''),
        h AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(length(b) - 11, 1) + 1), lambda i: substr(b, i, 12))) AS gram FROM d WHERE b <> ''),
        n AS (SELECT g.doc_id, count(*) AS n, count(h.gram) AS m FROM g LEFT JOIN h ON h.doc_id = g.doc_id AND h.gram = g.gram GROUP BY ALL)
        SELECT d.doc_id, round(coalesce(m / n, 0.0), 9) AS coverage FROM d LEFT JOIN n USING (doc_id)""",
}
